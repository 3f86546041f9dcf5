"""Projections of large sweeps: what the optimizer makes of them stays short enough for the JVM to compile."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from latticore.operators import binning, rangeimage
from latticore.sources import sweeps

SF = "/root/testdata/sf0.001"


def test_filter_of_the_image_stays_above_what_made_the_points(spark):
    """Pushed below, it repeated the points' expressions in a method of 12042 bytes; beyond 8000 the JVM interprets."""
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        rangeimage.project(sweeps.pseudo_points(spark, SF)).explain("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", told.getvalue())]
    assert sizes and max(sizes) < 8000


def test_points_seen_earlier_are_not_shuffled(spark):
    """The tables of row elevations are known to be small, so that points stay where they are until they are pixels."""
    frames = sweeps.pseudo_frames(spark)
    seen = rangeimage.seen_earlier(binning.world(sweeps.pseudo_points(spark, SF), frames), frames)
    plan = seen._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_row_by_halving_is_row_of(spark):
    tables = {0: [30.0 - k * 0.9 for k in range(64)], 1: [5.0, 9.0, -1.0, -1.0, -4.0, 2.0, -9.0], 2: [1.0]}
    elevs = [v + d for t in tables.values() for v in t for d in (-0.45, -0.2, 0.0, 0.2, 0.45)] + [-90.0, 90.0, 31.0, None]
    for table in tables.values():
        df = spark.createDataFrame([(e, table) for e in elevs], "e double, table array<double>")
        got = rangeimage.with_row(df.withColumn("_falling", F.sort_array("table", False)), F.col("e"), len(table))
        for r in got.withColumn("want", rangeimage.row_of(F.col("e"), F.col("table"), len(table))).collect():
            assert r.row == r.want, (r.e, table)
