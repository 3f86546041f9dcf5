"""Bounded samples of labelled rows and a small logistic-regression solver for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(rows: DataFrame, key: str, most: int) -> list:
    """At most `most` rows: those with the least md5 of the key, the same in every run."""
    return rows.withColumn("_o", F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")))).orderBy("_o", key).limit(most).drop("_o").collect()


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, intercept: bool = True, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept (0 without one)."""
    x = np.hstack([x, np.full((len(x), 1), 1.0 if intercept else 0.0)])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], l2)
    keep[-1] = 1e-6 if intercept else l2
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + keep * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w
