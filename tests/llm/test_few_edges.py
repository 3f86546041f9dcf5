"""linked(): few edges take few tasks, and give what the rounds give."""

import numpy as np
from pyspark.sql import functions as F

from latticore.llm import graph


def edges(spark):
    rng = np.random.default_rng(5)
    own = [(int(a), int(b)) for a, b in rng.integers(-900, 900, (700, 2))]  # components of many sizes, loops among them
    chain = [(5000 + (k * 7919) % 3001, 5000 + ((k + 1) * 7919) % 3001) for k in range(3000)]
    star = [(20000, 20001 + k) for k in range(500)] + [(1 << 62, -(1 << 62)), (7, None), (None, 8)]
    return spark.createDataFrame(own + chain + star + own[:50], "u long, v long")


def test_one_task_agrees_with_the_rounds(spark):
    few = {tuple(r) for r in graph.linked(edges(spark)).collect()}
    assert few == {tuple(r) for r in graph.components(edges(spark)).collect()}
    assert len(few) == len({n for n, _ in few}) and (1 << 62, -(1 << 62)) in few


def test_many_edges_go_through_rounds(spark, monkeypatch):
    few = {tuple(r) for r in graph.linked(edges(spark)).collect()}
    monkeypatch.setattr(graph, "FEW", 100)
    assert {tuple(r) for r in graph.linked(edges(spark)).collect()} == few


def test_no_edge_gives_no_node(spark):
    assert graph.linked(spark.createDataFrame([(3, 3), (None, 4)], "u long, v long")).count() == 0


def test_few_edges_take_few_tasks(spark):
    """Each task costs some kB of log and files: the near-dedup stage on 211 partitions took over 0.7 GB of them."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few", "few edges")
    try:
        chain = spark.range(2000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
        graph.linked(chain).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("few")) < 10  # rounds take over 40
