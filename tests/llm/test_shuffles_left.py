"""Rounds of components() leave no shuffles behind: on many small partitions their files outgrow the data."""

import time

from pyspark.sql import functions as F

from latticore.llm import graph


def shuffles(spark) -> int:
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def test_rounds_leave_no_shuffles(spark, monkeypatch):
    graph.release(spark)
    time.sleep(1)
    first, held = shuffles(spark), []

    def save(df, name, inner=graph.save):
        time.sleep(0.5)  # Spark's cleaner works beside the driver
        held.append(shuffles(spark) - first)
        return inner(df, name)

    monkeypatch.setattr(graph, "save", save)
    chain = spark.range(600).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = graph.components(chain).agg(F.count("*"), F.max("component")).first()
    assert tuple(got) == (601, 0)
    assert len(held) > 8  # four rounds or more
    assert max(held) <= 12, held
