"""Quality learns from every labelled row that is not held out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticore.llm import quality
from latticore.llm.common import held_out


def test_a_block_is_the_sum_of_its_pairs():
    r = np.random.default_rng(2)
    a, b, w = r.normal(size=(700, 3)), r.normal(size=(5, 3)), r.normal(size=3)
    d = (a[:, None] - b[None]).reshape(-1, 3)
    p = 1 / (1 + np.exp(d @ w))
    g, h = quality._blocks(a, b, w)
    assert g == pytest.approx(-p @ d) and h == pytest.approx((d.T * (p * (1 - p))) @ d)


def test_every_labelled_row_stands_in_a_pair_and_moves_the_model(spark):
    rows = spark.range(15_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 150 == 0, "good words stand here").otherwise(F.concat(F.lit("bad mess "), F.col("id") % 97)).alias("text"))
    labels = rows.select("doc_id", F.when(F.col("doc_id") % 150 == 0, 1).otherwise(0).alias("quality"))
    learned = labels.filter(~held_out(F.col("doc_id")))
    known = learned.select("quality", F.col("doc_id").cast("string").cast("binary").alias("f"), F.xxhash64("doc_id").alias("h"))
    n1, n = learned.filter("quality = 1").count(), learned.count()
    dealt = quality._deal(known, n - n1, n1)
    assert dealt.filter("size(good) > 0").select(F.explode("bad")).distinct().count() == n - n1
    assert dealt.filter("size(bad) > 0").select(F.explode("good")).distinct().count() == n1
    model = quality.fit(rows, labels)
    assert len(set(map(float, model.mean))) > 3
    text = {r.text for r in rows.join(learned, "doc_id").select("text").collect()}
    by = {t: quality.features(t.encode()) for t in text}
    mean = np.mean([by[r.text] for r in rows.join(learned, "doc_id").collect()], axis=0)
    assert model.mean == pytest.approx(mean)  # of all 11000 or so rows, not of 6000 a label


def test_order_statistics_of_many_values(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003 / 3).alias("s")).union(spark.range(3000).select(F.lit(100.0)))
    want = sorted(r.s for r in df.collect())
    assert quality.order_statistics(df, "s", [0, 399, 2000, 7999], few=50) == [want[k] for k in (0, 399, 2000, 7999)]
