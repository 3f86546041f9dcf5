"""Sweeps of order keys beyond what a packed pid holds."""

import pytest
from pyspark.sql import functions as F

from latticore.plans import catalog, extras  # noqa: F401
from latticore.sources import sweeps

SF = "/root/testdata/sf0.001"
LONG = ["intensity_scaled", "feature_residual", "mutual_nearest", "overlay_sample", "overlay_points", "range_image_nearest", "rows_fixed", "rows_interpolated"]


@pytest.fixture(scope="module")
def long_keys(spark, tmp_path_factory):
    """lineitem whose order keys exceed what a packed pid holds in every other row."""
    at = str(tmp_path_factory.mktemp("long"))
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    li.withColumn("l_orderkey", F.col("l_orderkey") + F.when(F.col("l_orderkey") % 2 == 0, 20011 << 20).otherwise(0)).write.parquet(f"{at}/lineitem.parquet")
    return at


@pytest.mark.parametrize("name", LONG)
def test_queries_of_long_keys(spark, long_keys, name):
    got = catalog.QUERIES[name](spark, long_keys).collect()
    assert len(got) > 0 and all(r.pid is not None for r in got)


def test_pids_of_long_keys(spark, long_keys):
    pts = sweeps.pseudo_points(spark, long_keys)
    own = sweeps.pseudo_points(spark, SF)
    assert pts.select("pid").distinct().count() == own.count() == pts.count()
    assert pts.filter("pid < 0").count() > 0 and own.filter("pid < 0").count() == 0
    assert pts.filter("pid >= 0").select("pid").exceptAll(own.select("pid")).count() == 0
