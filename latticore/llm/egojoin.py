"""Embedding near-duplicates by an epsilon grid order join.

Cosine c of unit vectors is a Euclidean distance of sqrt(2 - 2c), so the threshold gives an
epsilon.  Vectors are projected on the leading principal axes (an orthonormal map: it never makes a
distance larger), cut into grid cells of side epsilon, and sorted by label and cell (the grid order,
over the first ORDER axes).  Consecutive rows form runs with bounding boxes over all AXES.  Two
runs meet only where their cells on the first axis are equal or neighbours, and are skipped where
their boxes lie farther apart than epsilon.  Inside a pair of runs both sequences are halved
recursively, again skipping intervals whose boxes are too far apart, down to small ones: those are
compared by a product in single precision, and what lies near the threshold again in double.

A run is shipped once for each run that it meets, as its vectors' own bytes.  Exact copies are one row with a
count from the start, so a very common vector costs nothing.  A pair of runs returns, per row, the
sum of its partners' counts and the root of its local component: links are counted, never listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_heavy, save, slices
from .graph import components

AXES = 16
ORDER = 6
RUN = 8192  # rows of a run
LEAF = 256


def _units(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # scaled first, so that no square over- or underflows
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def _axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal axes by vector length, from second moments summed over all rows: d * (d + 1) + 1 sums a task."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in slices(batches, 4096):
            dims = np.asarray(b.column(0).value_lengths())
            for d in np.unique(dims):
                u = _units(_matrix(b.column(0).filter(pa.array(dims == d))))
                m = np.concatenate([(u.T @ u).ravel(), u.sum(0), [len(u)]])
                total[int(d)] = total[int(d)] + m if int(d) in total else m
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), d), pa.int32()), pa.array(np.arange(len(m)), pa.int32()), pa.array(m)], ["dim", "i", "x"])

    sums = vectors.select("embedding").mapInArrow(run, "dim int, i int, x double").groupBy("dim", "i").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for d, own in sums.groupby("dim"):
        m = own.sort_values("i")["x"].to_numpy()
        mean = m[d * d : d * d + d] / m[-1]
        cov = m[: d * d].reshape(d, d) / m[-1] - np.outer(mean, mean)
        out[int(d)] = np.linalg.eigh(cov)[1][:, ::-1][:, :AXES]
    return out


class Side:
    """One sequence in grid order: nodes, their copies, unit vectors and projections."""

    def __init__(self, node: np.ndarray, copies: np.ndarray, vectors: np.ndarray, axes: np.ndarray):
        self.node, self.copies, self.u = node, copies, _units(vectors)
        self.single = self.u.astype(np.float32)
        self.p = self.u @ axes
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if (lo, hi) not in self.boxes:
            part = self.p[lo:hi]
            self.boxes[lo, hi] = part.min(0), part.max(0)
        return self.boxes[lo, hi]


def _propagate(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each node's component, of the graph with edges (a, b)."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            return least
        least = new


def interval_join(x: Side, y: Side | None, eps: float, least: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Link counts and roots of the rows of x, then y (None: x with itself), and how many of all pairs of small intervals were compared."""
    same = y is None
    y = x if same else y
    n, shift = len(x.u) + (0 if same else len(y.u)), 0 if same else len(x.u)
    links, lab, pending, held = np.zeros(n, np.int64), np.arange(n), [], 0
    margin = 1e-5 + 1e-6 * x.u.shape[1]
    compared = 0

    def fold():
        nonlocal lab, pending, held
        if pending:
            a, b = (np.concatenate(e) for e in zip(*pending, strict=True))
            lab = _propagate(n, a, b)[lab]
            pending, held = [], 0

    stack = [(0, len(x.u), 0, len(y.u))] if len(x.u) and len(y.u) else []
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if same and b1 <= a0:
            continue
        (al, ah), (bl, bh) = x.box(a0, a1), y.box(b0, b1)
        gap = np.maximum(0, np.maximum(al - bh, bl - ah))
        if gap @ gap > eps * eps:
            continue
        if a1 - a0 > LEAF or b1 - b0 > LEAF:
            am, bm = (a0 + a1) // 2, (b0 + b1) // 2
            for p in ((a0, am), (am, a1)) if a1 - a0 > LEAF else ((a0, a1),):
                stack += [(*p, *q) for q in (((b0, bm), (bm, b1)) if b1 - b0 > LEAF else ((b0, b1),))]
            continue
        compared += 1
        s = x.single[a0:a1] @ y.single[b0:b1].T
        hit = s >= least - margin
        if same:
            hit &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
        if not hit.any():
            continue
        i, j = np.nonzero(hit & (s <= least + margin))
        hit[i, j] = (x.u[a0 + i] * y.u[b0 + j]).sum(axis=1) >= least
        links[a0:a1] += hit @ y.copies[b0:b1]
        links[shift + b0 : shift + b1] += x.copies[a0:a1] @ hit
        i, j = np.nonzero(hit)
        i, j = lab[i + a0], lab[j + b0 + shift]
        apart = i != j
        if apart.any():
            pairs = np.unique(np.stack([i[apart], j[apart]]), axis=1)
            pending.append((pairs[0], pairs[1]))
            held += pairs.shape[1]
            if held > 1 << 16:
                fold()
    fold()
    leaves = lambda k: -(-k // LEAF)
    return links, lab, compared, leaves(len(x.u)) * (leaves(len(x.u)) + 1) // 2 if same else leaves(len(x.u)) * leaves(len(y.u))


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Rows compare only when labels are equal and not null and the vectors have one length.  A vector
    that is null, empty or zero or has a null or non-finite component links with nothing, and is a
    component of its own.  Rows that share an id stay rows of their own.  Other columns do not matter."""
    eps = float(np.sqrt(max(2 - 2 * least, 0))) + 1e-7
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("embedding"), F.col(label_col).alias("label"))
    good = F.expr("label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = save(rows.filter("good").groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    axes = vectors.sparkSession.sparkContext.broadcast(_axes(classes))

    def grid(batches):
        for b in slices(batches, 4096):
            e = b.column(0)
            dims = np.asarray(e.value_lengths())
            p = np.zeros((len(dims), ORDER))
            for d in np.unique(dims):
                own = dims == d
                a = axes.value[int(d)][:, :ORDER]
                p[own, : a.shape[1]] = _units(_matrix(e.filter(pa.array(own)))) @ a
            cell = (np.floor(p / eps) + (1 << 31)).astype(">u4")  # bytes that sort as the cells do
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims, pa.int32()), pa.array([c.tobytes() for c in cell], pa.binary())], [*b.schema.names, "dim", "cell"])

    kind = vectors.schema[vec_col].dataType.simpleString()
    lab = classes.schema["label"].dataType.simpleString()
    placed = classes.select("embedding", "node", "copies", "label").mapInArrow(grid, f"embedding {kind}, node long, copies long, label {lab}, dim int, cell binary")
    order = ["label", "dim", "cell"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order, "node")

    def pack(batches):
        from pyspark import TaskContext

        base, seq, held, size, mark = TaskContext.get().partitionId() << 32, 0, [], 0, None

        def out():
            nonlocal seq, held, size
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            v = _matrix(t.column(0))
            p = _units(v) @ axes.value[v.shape[1]]
            data = np.asarray(t.column(1), np.int64).tobytes() + np.asarray(t.column(2), np.int64).tobytes() + v.tobytes()
            b = pa.RecordBatch.from_arrays([pa.array([base + seq]), t.column(3)[:1], t.column(4)[:1], pa.array([len(v)], pa.int32()), pa.array([v.dtype.str]), pa.array([data], pa.binary()), pa.array([p.min(0).tolist()]), pa.array([p.max(0).tolist()])], ["run", "label", "dim", "n", "kind", "data", "lo", "hi"])
            seq, held, size = seq + 1, [], 0
            return b

        for b in batches:
            labels, dims = b.column(3).to_pylist(), b.column(4).to_pylist()
            i = 0
            while i < b.num_rows:
                key = (labels[i], dims[i])
                if held and (key != mark or size >= RUN):
                    yield out()
                mark, j = key, i
                while j < b.num_rows and (labels[j], dims[j]) == key and size + j - i < RUN:
                    j += 1
                held.append(b.slice(i, j - i))
                size, i = size + j - i, j
        if held:
            yield out()

    runs = save(placed.mapInArrow(pack, f"run long, label {lab}, dim int, n int, kind string, data binary, lo array<double>, hi array<double>"), "runs")
    cell = lambda c: F.floor(F.col(c)[0] / eps)
    boxes = runs.select("run", "label", "dim", "lo", "hi")
    a = boxes.select("label", "dim", F.col("run").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(F.sequence(cell("lo"), cell("hi"))).alias("c"))
    b = boxes.select("label", "dim", F.col("run").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.explode(F.sequence(cell("lo") - 1, cell("hi") + 1)).alias("c"))
    gap = F.expr(f"aggregate(zip_with(zip_with(alo, bhi, (x, y) -> greatest(x - y, 0D)), zip_with(blo, ahi, (x, y) -> greatest(x - y, 0D)), (x, y) -> greatest(x, y)), 0D, (s, g) -> s + g * g)")
    pairs = a.join(b, ["label", "dim", "c"]).filter(F.col("a") <= F.col("b")).filter(gap <= eps * eps).select("a", "b").distinct()
    data = lambda x: runs.select(F.col("run").alias(x), F.col("n").alias(f"{x}n"), F.col("data").alias(f"{x}data"))
    one = runs.select(F.col("run").alias("a"), "dim", "kind")
    own = pairs.filter("a = b").join(one, "a").join(data("a"), "a").select("a", "b", "dim", "kind", "an", "adata", F.lit(0).alias("bn"), F.lit(None).cast("binary").alias("bdata"))
    other = pairs.filter("a < b").join(one, "a").join(data("a"), "a").join(data("b"), "b").select("a", "b", "dim", "kind", "an", "adata", "bn", "bdata")

    def compare(batches):
        def side(raw, n, r):
            v = np.frombuffer(raw, np.dtype(r["kind"]), n * r["dim"], 16 * n).reshape(n, r["dim"])
            return Side(np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n), v, axes.value[r["dim"]])

        for b in slices(batches, 1):
            for r in b.to_pylist():
                x = side(r["adata"], r["an"], r)
                y = side(r["bdata"], r["bn"], r) if r["bdata"] is not None else None
                links, root, _, _ = interval_join(x, y, eps, least)
                node = x.node if y is None else np.concatenate([x.node, y.node])
                on = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(links[on]), pa.array(node[root[on]])], ["node", "links", "root"])

    tasks = own.union(other)
    spread = tasks.repartition(vectors.sparkSession.sparkContext.defaultParallelism * 4, "a", "b")
    found = save(spread.mapInArrow(compare, "node long, links long, root long"), "links")
    comp = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    per = found.groupBy("node").agg(F.sum("links").alias("links"))
    key = F.struct("label", "embedding").alias("key")
    full = classes.join(per, "node", "left").join(comp, "node", "left")
    full = save(full.select(key, "least", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("c")), "linked")
    first = full.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    total = full.agg(F.count("*"), F.sum("copies")).first()
    full = join_heavy(full, first, "c", "m", total[0]).select("key", "copies", "n_links", "component_id")
    linked = join_heavy(rows.filter("good").select("id", key), full, "key", "copies", total[1] or 0).select("id", "n_links", "component_id")
    alone = rows.filter("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    drop(runs)
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


#: DuckDB's form: all pairs of one label, and components by the least reachable id.
SQL = """
WITH RECURSIVE rated AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e,
         label IS NOT NULL AND coalesce(len(embedding), 0) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
  FROM embeddings),
unit AS (SELECT vec_id, label, [x / sqrt(list_inner_product(e, e)) FOR x IN e] AS u FROM rated WHERE good),
linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.u) = len(b.u) THEN list_inner_product(a.u, b.u) ELSE 0 END >= 0.93),
reach AS (SELECT vec_id AS id, vec_id AS least FROM rated UNION SELECT l.b, r.least FROM reach r JOIN linked l ON l.a = r.id WHERE l.b > r.least),
comp AS (SELECT id, min(least) AS component_id FROM reach GROUP BY id),
links AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT v.vec_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM rated v JOIN comp c ON c.id = v.vec_id LEFT JOIN links l ON l.a = v.vec_id
"""
