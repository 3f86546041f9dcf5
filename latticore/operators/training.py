"""Training statistics and augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_weights(labels: DataFrame, n: int = 9) -> DataFrame:
    """labels(label) -> (cls, freq, weight): sqrt(total / freq), 0 for empty classes, divided by the mean of the positive ones."""
    f = labels.filter(F.col("label").between(0, n - 1)).groupBy(F.col("label").cast("int").alias("cls")).agg(F.count("*").alias("freq"))
    full = labels.sparkSession.range(n).select(F.col("id").cast("int").alias("cls")).join(f, "cls", "left").fillna(0, ["freq"])
    every = Window.partitionBy()
    w = full.withColumn("w", F.when(F.col("freq") > 0, F.sqrt(F.sum("freq").over(every) / F.greatest("freq", F.lit(1)))).otherwise(0.0))
    return w.select("cls", "freq", (F.col("w") / F.avg(F.when(F.col("w") > 0, F.col("w"))).over(every)).alias("weight"))


def positive_weight(labels: DataFrame) -> DataFrame:
    moving, static = F.count_if(F.col("gt_moving")), F.count_if(~F.col("gt_moving"))
    return labels.filter("label >= 0").agg(F.sqrt(F.least(F.lit(50.0), static / F.greatest(moving, F.lit(1)))).alias("pos_weight"), moving.alias("n_moving"), static.alias("n_static"))


def frame_sampling(labels: DataFrame, weights: DataFrame) -> DataFrame:
    """Probability of drawing each frame: its class-weighted mass over that of all."""
    per = labels.filter("label >= 0").groupBy("frame", F.col("label").cast("int").alias("cls")).agg(F.count("*").alias("n"))
    mass = per.join(weights, "cls").groupBy("frame").agg(F.sum(F.col("n") * F.col("weight")).alias("mass"))
    return mass.select("frame", (F.col("mass") / F.sum("mass").over(Window.partitionBy())).alias("p"))


def augment(points: DataFrame, seed: int = 0) -> DataFrame:
    """One scale (within 5 %) and one intensity gain (within 20 %) a frame, from a hash of seed and frame."""
    u = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("frame")), F.lit(1 << 20)) / float(1 << 20)
    s, g = 0.95 + 0.1 * u(1), 0.8 + 0.4 * u(2)
    return points.withColumns({"x": F.col("x") * s, "y": F.col("y") * s, "z": F.col("z") * s, "inten": F.least(F.col("inten") * g, F.lit(1.0))})


def label_statistics(points: DataFrame) -> DataFrame:
    """Per true class: labelled points, moving ones and static ones."""
    return points.filter("label >= 0").groupBy("label").agg(F.count("*").alias("n"), F.count_if("gt_moving").alias("n_moving"), F.count_if(~F.col("gt_moving")).alias("n_static"))
