"""Document quality by Bradley-Terry pairwise ranking.

Preference pairs put a document of label 1 before one of label 0.  Under Bradley-Terry the chance
that a is preferred to b is sigmoid(w . (f(a) - f(b))), so w is learned by logistic loss on feature
differences.  A document's strength w . f(d) then ranks all documents; the acceptance threshold is
a quantile of the strengths of the learned documents: the one that cuts off as large a share as
the labels reject.  The published score maps that threshold to `accept` (0.7) on a logistic scale.

Features look only at the text, and at all of it: shares of character kinds, word lengths and
repetition, and what share of its words falls into each of 32 classes by a hash (lexical: the words
that good or bad documents prefer move the classes they stand in).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, held_out, save, slices
from .sample import fit_logistic, sigmoid

_KIND = np.zeros(256, np.int64)  # 0 other ASCII signs, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 .,;:' 7 !? 8 UTF-8 lead or tail bytes
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 11, 12, 32]] = 4
_KIND[[10, 13]] = 5
_KIND[[ord(c) for c in ".,;:'\"-()"]] = 6
_KIND[[ord(c) for c in "!?"]] = 7
_KIND[128:] = 8
CLASSES = 32
PAIRS = 40_000
L2 = 2.0
N_FEATURES = 19 + CLASSES


def features(text: bytes | None) -> np.ndarray:
    """Feature vector of a whole text (UTF-8); null is as empty."""
    text = text or b""
    out = np.zeros(N_FEATURES)
    n = len(text)
    if not n:
        out[18] = 1.0
        return out
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=9)
    out[:9] = kinds / n
    words = text.split()
    k = max(len(words), 1)
    seen = len(set(words))
    lines = text.split(b"\n")
    out[9] = np.log1p(len(words)) / 10
    out[10] = seen / k
    out[11] = np.log1p(k / max(seen, 1))
    out[12] = min((n - kinds[4] - kinds[5]) / k, 40) / 10
    out[13] = kinds[2] / max(kinds[1] + kinds[2], 1)
    out[14] = len(set(lines)) / len(lines)
    out[15] = min(kinds[0] / k, 4)
    out[16] = min(kinds[7] / k, 4)
    out[17] = n / max(len(zlib.compress(text, 1)), 1) / 10 if len(words) > 1 else 0.0
    if words:
        kind = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & np.uint32(CLASSES - 1)
        out[19:] = np.sqrt(np.bincount(kind, minlength=CLASSES) / k)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    unit: float
    accept: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        base = np.log(self.accept / (1 - self.accept))
        return sigmoid(base + (self.strength(x) - self.threshold) / self.unit)


def preferences(diff: np.ndarray, won: np.ndarray, l2: float = L2) -> np.ndarray:
    """Weights of least Bradley-Terry loss, sum of log(1 + exp(-+ diff . w)), plus l2 / 2 * |w|^2."""
    return fit_logistic(diff, won, l2=l2, intercept=False)[:-1]


def _blocks(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the loss, log(1 + exp(-w . (x - y))), summed over all pairs of rows x of a and y of b."""
    g, h = np.zeros(len(w)), np.zeros((len(w), len(w)))
    for i in range(0, len(a), 512):
        for j in range(0, len(b), 512):
            x, y = a[i : i + 512], b[j : j + 512]
            lost = sigmoid((y @ w)[None, :] - (x @ w)[:, None])
            both = lost * (1 - lost)
            g -= lost.sum(1) @ x - lost.sum(0) @ y
            cross = x.T @ both @ y
            h += (x.T * both.sum(1)) @ x + (y.T * both.sum(0)) @ y - cross - cross.T
    return g, h


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, N_FEATURES)


def _sums(df: DataFrame, run) -> np.ndarray:
    """Sum over all tasks of the arrays that run(batches) gives, one a task."""
    tasks = df.mapInArrow(lambda batches: iter([pa.RecordBatch.from_arrays([pa.array([run(batches).tobytes()], pa.binary())], ["v"])]), "v binary").collect()
    return sum(np.frombuffer(r.v, np.float64) for r in tasks)


def _deal(known: DataFrame, n0: int, n1: int) -> DataFrame:
    """known(quality, f, h) -> (good, bad): lists of features to compare, all with all, such that every row stands in one.

    About 128 rows of the rarer label meet up to 1024 or so of the other; where that has more, the rarer rows meet each part of them."""
    rare = 1 if n1 <= n0 else 0
    k = max(1, min(n0, n1) // 128)
    parts = max(1, max(n0, n1) // (k * 1024))
    of = F.when(F.col("quality") == rare, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int")))
    dealt = known.select(F.pmod("h", F.lit(k)).alias("k"), F.explode(of).alias("part"), "quality", "f")
    side = lambda q, name: F.sort_array(F.collect_list(F.when(F.col("quality") == q, F.col("f")))).alias(name)
    return dealt.groupBy("k", "part").agg(side(1, "good"), side(0, "bad")).sortWithinPartitions("k", "part").select("good", "bad")


def order_statistics(values: DataFrame, col: str, ranks: list[int], few: int = 20_000) -> list[float]:
    """The values of these ranks (from 0) in rising order, exactly: ranges are narrowed by counts until few values are left."""
    out = []
    for rank in ranks:
        now = values
        while True:
            n, lo, hi = now.agg(F.count(col), F.min(col), F.max(col)).first()
            if n <= few or lo == hi:
                out.append(lo if lo == hi else sorted(r[0] for r in now.select(col).collect())[rank])
                break
            bin_ = F.least(F.floor((F.col(col) - lo) * (4096 / (hi - lo))), F.lit(4095))
            for r in sorted(now.groupBy(bin_.alias("b")).count().collect()):
                if rank < r["count"]:
                    now = now.filter(bin_ == r.b)
                    break
                rank -= r["count"]
    return out


def fit(docs: DataFrame, labels: DataFrame, accept: float = 0.7, rounds: int = 60) -> Model:
    """Learn from every labelled document that is not held out: each is compared with about 128 or more of the other label (see _deal).

    The pairs' mean loss counts as that of PAIRS pairs beside the ridge penalty.  Null labels are ignored; without both
    labels every document gets the accept score.  Rows of one id are learned from each."""
    marks = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(~held_out(F.col("doc_id")))

    @F.arrow_udf("binary")
    def featured(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()).tobytes() for t in texts], pa.binary())

    # features, not texts, meet the labels: they are smaller
    own = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", featured(F.col("text").cast("binary")).alias("f"))
    known = own.join(marks, "doc_id").select(F.col("quality").cast("int").alias("quality"), "f", F.xxhash64("doc_id", "f").alias("h"))
    known = save(known, "known")

    def moments(batches) -> np.ndarray:
        out = np.zeros((2, 1 + 2 * N_FEATURES))
        for b in slices(batches):
            x, q = _rows(b.column(0)), b.column(1).to_numpy()
            for k in (0, 1):
                out[k] += np.concatenate([[(q == k).sum()], x[q == k].sum(0), (x[q == k] ** 2).sum(0)])
        return out.ravel()

    first = np.reshape(_sums(known.select("f", "quality"), moments), (-1, 1 + 2 * N_FEATURES)) if known.take(1) else np.zeros((2, 1))
    n0, n1 = (int(n) for n in first[:, 0])
    if not n0 or not n1:
        drop(known)
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 1.0, accept)
    total = first.sum(0)[1:] / (n0 + n1)
    mean = total[:N_FEATURES]
    scale = np.maximum(np.sqrt(np.maximum(total[N_FEATURES:] - mean**2, 0)), 1e-6)
    pairs = save(_deal(known, n0, n1), "pairs")
    w = np.zeros(N_FEATURES)

    def step(batches) -> np.ndarray:
        out = np.zeros(1 + N_FEATURES + N_FEATURES**2)
        for b in slices(batches, 16):
            for good, bad in zip(b.column(0), b.column(1), strict=True):
                if len(good) and len(bad):
                    g, h = _blocks(_rows(good.values) / scale, _rows(bad.values) / scale, w)
                    out += np.concatenate([[len(good) * len(bad)], g, h.ravel()])
        return out

    for _ in range(rounds):
        got = _sums(pairs, step)
        share = PAIRS / max(got[0], 1)
        g = share * got[1 : 1 + N_FEATURES] + L2 * w
        h = share * got[1 + N_FEATURES :].reshape(N_FEATURES, -1) + (L2 + PAIRS * 1e-9) * np.eye(N_FEATURES)
        move = np.linalg.solve(h, g)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break

    def strengths(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(((_rows(b.column(1)) - mean) / scale) @ w)], ["quality", "s"])

    s = save(known.select("quality", "f").mapInArrow(strengths, "quality int, s double"), "strengths")
    # the threshold cuts off as many as the labels reject
    threshold = sum(order_statistics(s, "s", [n0 - 1, n0])) / 2
    median = lambda q, n: sum(order_statistics(s.filter(F.col("quality") == q), "s", [(n - 1) // 2, n // 2])) / 2
    unit = max((median(1, n1) - median(0, n0)) / 8, 1e-6)
    drop(known, pairs, s)
    return Model(mean, scale, w, float(threshold), float(unit), accept)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with one more column, the quality score from 0 to 1 of each whole text (never null).

    `out` replaces a column of that name; other columns pass as they are, rows that share an id too.
    Only the text crosses to Python, and only the score comes back."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py()) for t in texts]).reshape(-1, N_FEATURES)
        return pa.array(held.value.score(x))

    keep = [F.col(f"`{c}`") for c in docs.columns if c != out]
    return docs.select(*keep, rate(F.col(f"`{text_col}`").cast("binary")).alias(out))
