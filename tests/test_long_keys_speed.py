"""Order keys beyond a packed pid cost no more than others."""

import time

from pyspark.sql import functions as F

from latticore.sources import sweeps


def test_long_keys_take_no_longer(spark, tmp_path):
    """A row whose pid does not fit raises no error on its way: an error a row took ten times as long as the row itself."""
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    took = {}
    for name, shift in (("short", 0), ("long", 1 << 22)):
        at = str(tmp_path / name)
        li.withColumn("l_orderkey", F.col("l_orderkey") + shift).drop("_k").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
        times = []
        for _ in range(3):
            began = time.time()
            got = sweeps.pseudo_points(spark, at).agg(F.count("*"), F.sum(F.col("pid") % 2), F.count_if(F.col("pid") < 0)).first()
            times.append(time.time() - began)
        took[name] = min(times)
        assert got[0] == 5 * 60_000 and got[2] == (0 if name == "short" else got[0])
    assert took["long"] < 4 * took["short"] + 0.5, took


def test_pids_at_the_edge(spark, tmp_path):
    """Where the packed key fits a long it is that key, to the last one that does."""
    rows = [(o, p, 1, n, c / 100) for o in (0, 149_999, (1 << 21) - 1, 1 << 21) for p in (0, 32_767, 40_000) for n in (1, 7) for c in (0, 16_777_215)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double").withColumn("l_quantity", F.lit(1.0)).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = []
    for o, p, _, n, price in rows:
        pid = ((o * 8 + n) * 32768 + p) * 16777216 + round(price * 100)
        want.append(pid if pid < 1 << 63 else None)
    got = [r.pid for r in sweeps.pseudo_points(spark, str(tmp_path)).select("pid").collect()]
    assert sorted(v for v in got if v >= 0) == sorted(v for v in want if v is not None)
    assert len(got) == len(want) and len({v for v in got if v < 0}) == want.count(None)
