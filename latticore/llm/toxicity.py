"""Toxicity by a classifier chain.

Categories are predicted in turn: the model of each gets the text's features and the probabilities
of the categories before it.  For training these come out of fold (each document's earlier
probabilities from models that did not see it), so later models meet the errors they will meet.

The chain's categories are the columns of the labels: `low_quality` (quality 0) stands before
`toxic`.  Features are the presence of whole words and of word beginnings of 4 and 5 letters,
chosen in each training set by how much more often they stand in documents of the category; a
linear model weighs them.

Documents are learned from by their tokens: tasks count tokens over the whole texts of a bounded
sample of labelled documents, the CANDIDATES best go on, and of each document only which of these it
holds reaches the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices
from .sample import fit_logistic, hash_sample, sigmoid

_WORD = re.compile(r"[^\W\d_]+")
FOLDS = 4
STEMS = (4, 5)
CATEGORIES = ("low_quality", "toxic")
CANDIDATES = 5000  # tokens of all categories that the driver sees


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def tokens(text: str | None) -> set[str]:
    """Whole words, and word beginnings (with '-'), of a whole text in lower case."""
    found = words(text)
    return found.union(*({f"{w[:n]}-" for w in found if len(w) > n} for n in STEMS))


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 5


class Bags:
    """Token sets of training documents, as numbers of `names`, in one array with their rows."""

    def __init__(self, rows: list[list[int]], names: list[str]):
        self.n, self.names = len(rows), names
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.tok = np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)

    def evidence(self, use: np.ndarray, y: np.ndarray, most: int = 3000, least: int = 3) -> np.ndarray:
        """Per token its smoothed log odds where it stands in `least` positive rows of `use` and is at
        least 5 times likelier there, else 0: the `most` strongest, ties by token number."""
        pos = np.bincount(self.tok[(use & (y == 1))[self.row]], minlength=len(self.names))
        neg = np.bincount(self.tok[(use & (y == 0))[self.row]], minlength=len(self.names))
        n1, n0 = max((use & (y == 1)).sum(), 1), max((use & (y == 0)).sum(), 1)
        lo = np.log((pos + 0.1) / n1) - np.log((neg + 0.5) / n0)
        lo[(pos < least) | (lo <= 1.6)] = 0
        order = np.argsort(-lo * np.sqrt(pos), kind="stable")[:most]
        out = np.zeros(len(lo))
        out[order] = lo[order]
        return out

    def inputs(self, weight: np.ndarray) -> np.ndarray:
        hit = weight[self.tok]
        on = hit > 0
        total = np.bincount(self.row[on], weights=hit[on], minlength=self.n)
        top = np.zeros(self.n)
        np.maximum.at(top, self.row[on], hit[on])
        return np.stack([total / 10, top, np.log1p(np.bincount(self.row[on], minlength=self.n))], axis=1)


@dataclass
class Link:
    """One model of the chain: evidence of tokens, and weights of summed evidence, strongest
    evidence, hits, each earlier category's log odds, and the intercept."""

    name: str
    vocab: dict[str, float]
    weights: np.ndarray

    def __post_init__(self):
        self.whole = {t for t in self.vocab if t[-1] != "-"}
        self.stems = {n: {t[:-1] for t in self.vocab if t[-1] == "-" and len(t) == n + 1} for n in STEMS}

    def inputs(self, found: set[str]) -> tuple[float, float, float]:
        hits = [self.vocab[w] for w in found & self.whole]
        for n, stems in self.stems.items():
            if stems:
                hits += [self.vocab[f"{p}-"] for p in {w[:n] for w in found if len(w) > n} & stems]
        return (sum(hits) / 10, max(hits), np.log1p(len(hits))) if hits else (0.0, 0.0, 0.0)


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)
    threshold: float = 0.5

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probability of every category, one column a link."""
        sets = [words(t) for t in texts]
        got = np.zeros((len(sets), 0))
        for link in self.links:
            x = np.array([link.inputs(s) for s in sets]).reshape(-1, 3)
            p = sigmoid(np.hstack([x, odds(got), np.ones((len(x), 1))]) @ link.weights)
            got = np.hstack([got, p[:, None]])
        return got


def _weights(bags: Bags, use: np.ndarray, y: np.ndarray, before: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Linear weights over the rows of `use`, each row's evidence coming from the other folds."""
    x = np.zeros((bags.n, 3))
    for f in range(FOLDS):
        x[parts == f] = bags.inputs(bags.evidence(use & (parts != f), y))[parts == f]
    return fit_logistic(np.hstack([x, before])[use], y[use], l2=0.5)


def fit_chain(bags: Bags, y: np.ndarray, names: list[str], seed: int = 5) -> Chain:
    """y: one 0/1 column a category, in the order of the chain."""
    rng = np.random.default_rng(seed)
    parts, inner = rng.permutation(bags.n) % FOLDS, rng.permutation(bags.n) % FOLDS
    every = np.ones(bags.n, bool)
    before = np.zeros((bags.n, 0))
    links = []
    for k, name in enumerate(names):
        oof = np.zeros(bags.n)
        for f in range(FOLDS):
            own = parts == f
            w = _weights(bags, ~own, y[:, k], before, inner)
            x = np.hstack([bags.inputs(bags.evidence(~own, y[:, k])), before, np.ones((bags.n, 1))])
            oof[own] = sigmoid(x[own] @ w)
        final = bags.evidence(every, y[:, k])
        links.append(Link(name, {bags.names[i]: float(final[i]) for i in np.nonzero(final)[0]}, _weights(bags, every, y[:, k], before, parts)))
        before = np.hstack([before, odds(oof)[:, None]])
    p = 1 / (1 + np.exp(-before[:, -1] * 5))
    # the threshold that errs least out of fold, a clean document flagged counting double; ties to the middle
    grid = np.linspace(0.2, 0.9, 29)
    bad = np.array([2 * ((p >= g) & (y[:, -1] == 0)).sum() + ((p < g) & (y[:, -1] == 1)).sum() for g in grid])
    return Chain(links, float(np.median(grid[bad == bad.min()])))


def _candidates(sample: DataFrame, n: np.ndarray) -> list[str]:
    """The tokens of sample(text, low_quality, toxic) that tell a category best; n: rows, and rows of each category."""

    def run(batches):
        total: dict[str, list[int]] = {}
        for b in slices(batches):
            for t, *y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k in tokens(t):
                    held = total.setdefault(k, [0] * (1 + len(CATEGORIES)))
                    held[0] += 1
                    for i, v in enumerate(y):
                        held[1 + i] += v
        keys = list(total)
        for at in range(0, len(keys), 1 << 16):
            part = keys[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([total[k][i] for k in part], pa.int64()) for i in range(1 + len(CATEGORIES))]], ["token", "n", *[f"y{i}" for i in range(len(CATEGORIES))]])

    cols = [f"y{i}" for i in range(len(CATEGORIES))]
    sums = sample.mapInArrow(run, "token string, n long, " + ", ".join(f"{c} long" for c in cols)).groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", *cols)])
    lift = [F.when(F.col(c) >= 3, (F.log((F.col(c) + 0.1) / max(float(k), 1.0)) - F.log((F.col("n") - F.col(c) + 0.5) / max(float(n[0] - k), 1.0))) * F.sqrt(c)).otherwise(0.0) for c, k in zip(cols, n[1:], strict=True)]
    best = sums.withColumn("lift", F.greatest(*lift)).filter("lift > 0").orderBy(F.desc("lift"), "token").limit(CANDIDATES)
    return sorted(r.token for r in best.select("token").collect())


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000) -> Chain:
    """Learn from at most `most` labelled documents, half of them toxic where there are enough (least hash of doc_id first).

    Labels are read from rows with toxic 0 or 1; a doc_id labelled more than once counts as toxic if
    any row says so, and as of low quality if its least quality is 0 (null: not).  Of documents that share a doc_id
    each is learned from.  Without both toxic labels nothing is predicted toxic."""
    marks = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.coalesce((F.min("quality") == 0).cast("int"), F.lit(0)).alias("low_quality"))
    ids = [(r.doc_id, r.low_quality, r.toxic) for t in (0, 1) for r in hash_sample(marks.filter(F.col("toxic") == t), "doc_id", most // 2)]
    if len({t for *_, t in ids}) < 2:
        return Chain()
    wanted = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, low_quality int, toxic int"))
    sample = docs.select("doc_id", F.col("text").alias("_text")).join(wanted, "doc_id").select("_text", *CATEGORIES)
    n = np.array([len(ids), *np.sum([i[1:] for i in ids], axis=0)], float)
    names = _candidates(sample, n)
    known = docs.sparkSession.sparkContext.broadcast({k: i for i, k in enumerate(names)})

    def run(batches):
        for b in slices(batches):
            own = [sorted(known.value[k] for k in tokens(t) & known.value.keys()) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), *b.columns[1:]], ["own", *CATEGORIES])

    rows = sample.mapInArrow(run, "own array<int>, " + ", ".join(f"{c} int" for c in CATEGORIES)).collect()
    rows = sorted((list(r.own), *[r[c] for c in CATEGORIES]) for r in rows)
    y = np.array([r[1:] for r in rows], float).reshape(-1, len(CATEGORIES))
    if not len(y) or len(set(y[:, -1])) < 2:
        return Chain()
    return fit_chain(Bags([r[0] for r in rows], names), y, list(CATEGORIES))


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category> double for each category, score, predicted int) for every row.

    Null and empty texts score as texts without any evidence; of a chain that learned nothing all
    probabilities are 0.  Rows that share an id stay rows of their own; other columns do not matter."""
    held = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches):
        m = held.value
        for b in slices(batches):
            p = m.predict(b.column(1).to_pylist()) if m.links else np.zeros((b.num_rows, len(names)))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in p.T], pa.array(p[:, -1]), pa.array((p[:, -1] >= m.threshold).astype(np.int32))], ["id", *names, "score", "predicted"])

    schema = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema)
