"""Near-duplicates by the exact Jaccard similarity of word shingles, 0.8 or more.

A text is the set of its five-word shingles (64-bit hashes); texts of one set are one node, whose
number is the set's own hash.  Sets are ordered alike everywhere: shingles of crowded hash buckets
last, else by hash.

Two sets of similarity 4/5 and sizes a <= b have at least c = ceil(4b/5) shingles in common.  The
l-th of these, in the common order, stands among the first n - ceil(4n/5) + l of either set.  A prefix
has 1 + n div 16 more than n - ceil(4n/5), so two similar sets share many of their prefixes: how many follows from
their sizes (see _may), about a seventh of either where these are equal.  Hence, without losing a pair, sets that share
fewer are no pair, and a set of whose prefix fewer stand in any other has no partner.  What is left
is compared in full.

Nothing lists all pairs of a group: a set is first compared with the hub of its buckets (the set that
has most of its prefix in common with most others), of these with the one it meets most; then, where
buckets hold sets of several components still, with a hub that stands apart (linear).  Components are labels, and only
sets of different labels are compared further: each with the one it meets most, then what that leaves apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import across, drop, join_heavy, marked, marks, release, save, slices
from .graph import linked
from .hashing import mix64

#: Buckets in which shingles are counted to tell the crowded ones.
BUCKETS = 1 << 18
SHARE = 16
ROUNDS = 2  # times that every set is compared with a hub of its buckets before what is left apart is


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text in UTF-8; of all words where these are fewer."""
    import xxhash

    words = (text or b"").lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(own) - size + 1
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix64(out, 0) + own[k : k + n]
    return np.unique(mix64(out, 1))


def node_of(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64)) if len(found) else 0


def _least(n: int) -> int:
    return (4 * n + 4) // 5


def _shared(n: int) -> int:
    """How many shingles the prefixes of a set of this size and of a similar one, not smaller, have in common."""
    return 1 + n // SHARE


def prefix(found: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order."""
    n = len(found)
    order = np.lexsort((found, crowd[(found & np.uint64(BUCKETS - 1)).astype(np.int64)]))
    return found[order][: n - _least(n) + _shared(n)]


def similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def histogram(found: np.ndarray) -> bytes:
    """Counts of a set's hashes by their top bits, a bin for about two: log2 of the bins, bytes of a count, counts."""
    bits = max(4, (len(found) // 2).bit_length())
    counts = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    kind = np.uint8 if counts.max(initial=0) < 256 else np.uint32
    return bytes([bits, np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def may_be_similar(a: bytes, b: bytes) -> bool:
    """No two sets of similarity 4/5 fail: they have at most the lesser count of each bin in common."""
    x, y = (np.frombuffer(v, np.uint8 if v[1] == 1 else np.uint32, offset=2).astype(np.int64) for v in (a, b))
    if len(x) < len(y):
        x, y = y, x
    x = x.reshape(len(y), -1).sum(axis=1)
    return bool(9 * np.minimum(x, y).sum() >= 4 * (x.sum() + y.sum()))


def _nodes(texts: DataFrame) -> DataFrame:
    """(id, node, n) of every row and, with null n, (bucket, null, null, count) of the task's distinct sets: one pass."""

    def run(batches):
        total, seen = np.zeros(BUCKETS, np.int64), set()
        names = ["id", "node", "n", "bucket", "count"]
        for b in slices(batches):
            nodes, sizes = [], []
            for t in b.column(1):
                found = shingles(t.as_py())
                node = node_of(found)
                if node not in seen:
                    seen.add(node)
                    total += np.bincount((found & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS) if len(found) > BUCKETS // 64 else 0
                    if len(found) <= BUCKETS // 64:
                        np.add.at(total, (found & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
                nodes.append(node)
                sizes.append(len(found))
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), none, none], names)
        at = np.nonzero(total)[0]
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(at), pa.array(total[at])], names)

    return texts.mapInArrow(run, "id long, node long, n long, bucket long, count long")


def crowded(counts: DataFrame) -> np.ndarray:
    """counts(bucket, count) -> level of each bucket: 0, or more the more shingles it holds above twice the mean."""
    sums = counts.groupBy("bucket").agg(F.sum("count").alias("n")).toArrow()  # a row a bucket, however many shingles
    bucket, n = (sums.column(k).to_numpy().astype(np.int64) for k in (0, 1))
    out = np.zeros(BUCKETS, np.uint8)
    high = n > 2 * n.sum() / BUCKETS + 8
    out[bucket[high]] = [int(k).bit_length() for k in n[high]]
    return out


def _prefixes(texts: DataFrame, crowd, only=None) -> DataFrame:
    """(token, node, n): the prefix of each set, those in the bit table `only` alone; a set that a task meets again is left out."""

    def run(batches):
        seen = set()
        for b in slices(batches, 200):
            out = []
            for t in b.column(1):
                found = shingles(t.as_py())
                node = node_of(found)
                if len(found) and node not in seen:
                    seen.add(node)
                    first = prefix(found, crowd.value)
                    if only is not None:
                        first = first[marked(only.value, first)]
                    out.append((first, np.full(len(first), node), np.full(len(first), len(found))))
            if out:
                token, node, n = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(node), pa.array(n)], ["token", "node", "n"])

    return texts.mapInArrow(run, "token long, node long, n long")


def _sets(texts: DataFrame, only) -> DataFrame:
    """(node, set, bins) of the nodes that the bit table holds, each once a task."""

    def run(batches):
        seen = set()
        for b in slices(batches, 200):
            nodes, sets, bins = [], [], []
            for t in b.column(1):
                found = shingles(t.as_py())
                node = node_of(found)
                if len(found) and node not in seen and marked(only.value, np.array([node]))[0]:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(found.tobytes())
                    bins.append(histogram(found))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary()), pa.array(bins, pa.binary())], ["node", "set", "bins"])

    return texts.mapInArrow(run, "node long, set binary, bins binary")


def _both(pairs: DataFrame, of: DataFrame, test) -> DataFrame:
    """pairs(u, v) for whose values in of(node, value) the test holds."""

    def run(batches):
        for b in slices(batches, 100):
            keep = [test(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(of.toDF("u", "su"), "u").join(of.toDF("v", "sv"), "v").select("u", "v", "su", "sv")
    return full.mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """pairs(u, v) whose sets have similarity 4/5 or more; sets move only where their histograms, a sixteenth of them, allow it."""
    close = save(_both(pairs, sets.select("node", "bins"), may_be_similar), "close")
    release(sets.sparkSession)
    own = close.select(F.col("u").alias("node")).union(close.select("v")).distinct()
    few = sets.select("node", "set").join(own, "node", "left_semi")
    out = save(_both(close, few, similar), name)
    drop(close)
    release(sets.sparkSession)
    return out


def _may(x: str, y: str, count: str) -> str:
    """SQL: sets of sizes x and y may have similarity 4/5 if their prefixes share `count` shingles (or fewer).

    Similar ones have o = ceil(4 (x + y) / 9) in common, of which the first p - size + o of either prefix lie in both."""
    spare = lambda k: f"(1 + {k} div {SHARE} - (4 * {k} + 4) div 5)"  # noqa: E731  prefix less size
    return f"(5 * least({x}, {y}) >= 4 * greatest({x}, {y}) and {count} >= least({spare(x)}, {spare(y)}) + (4 * ({x} + {y}) + 8) div 9)"


def _apart(held: DataFrame, times: int = 1) -> DataFrame:
    """held(token, node, n, label, ...) without tokens of one label, and without rows that no other of their bucket can go with:
    for that a set's tokens must be as many as the sizes in the bucket ask for.  What goes may free others, so `times` times."""
    for _ in range(times):
        bucket = held.groupBy("token").agg(F.min("label").alias("_p"), F.max("label").alias("_q"), F.collect_set("n").alias("_sizes")).filter("_p < _q").select("token", "_sizes")
        met = held.join(bucket, "token")
        own = met.groupBy("node").agg(F.count("*").alias("_c"))
        then = save(met.join(own, "node").filter(F.expr(f"exists(_sizes, m -> {_may('n', 'm', '_c')})")).drop("_sizes", "_c"), "apart")
        drop(held)
        held = then
        release(held.sparkSession)
    return held


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for every row of docs: components of the links of similarity 0.8 or more.

    component_id names the component and says nothing else.  Null texts and texts without words are
    one component.  Equal ids stay rows of their own; a null id is kept."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    found = save(_nodes(texts), "nodes")
    rows = found.filter("n is not null").select("id", "node")
    crowd = spark.sparkContext.broadcast(crowded(found.filter("n is null").select("bucket", "count")))
    # tokens of two sets, then the rows of those alone
    met = _prefixes(texts, crowd).groupBy("token").agg(F.min("node").alias("p"), F.max("node").alias("q")).filter("p < q").select("token")
    met = save(met, "met")
    release(spark)
    held = save(_prefixes(texts, crowd, marks(met, "token")).join(met, "token", "left_semi").dropDuplicates(["token", "node"]), "held")
    held = _apart(held.withColumn("label", F.col("node")), 2)
    only = marks(held, "node")
    sets = save(_sets(texts, only).groupBy("node").agg(F.first("set").alias("set"), F.first("bins").alias("bins")), "sets")
    release(spark)
    # the centre of a group of copies has the most of its prefix in common with the most others
    crowds = held.groupBy("token").agg(F.count("*").alias("c"))
    score = held.join(crowds, "token").groupBy("node").agg((F.sum("c") / F.expr(f"any_value(n) - (4 * any_value(n) + 4) div 5 + 1 + any_value(n) div {SHARE}")).alias("score"))
    now = save(held.join(score, "node"), "scored")
    links, hubs = None, None
    for k in range(ROUNDS):
        rest = now
        if hubs is not None:  # the next hub stands apart from those before
            past = hubs.join(labels.withColumnRenamed("node", "_n"), F.col("hub") == F.col("_n"), "left").select("token", F.coalesce("label", "hub").alias("label")).distinct()
            rest = now.join(past, ["token", "label"], "left_anti")
        top = rest.groupBy("token").agg(F.max(F.struct("score", "node", "n", "label")).alias("h")).select("token", "h")
        top = save(top, "top")
        star = now.join(top, "token").filter("label <> h.label").groupBy(F.col("node").alias("u"), "n", F.col("h.node").alias("v"), F.col("h.n").alias("m")).count().filter(_may("n", "m", "count"))
        found = _verified(star.groupBy("u").agg(F.max(F.struct("count", "v"))["v"].alias("v")), sets, f"stars{k}")
        hubs = top.select("token", F.col("h.node").alias("hub")) if hubs is None else hubs.union(top.select("token", F.col("h.node").alias("hub")))
        links = found if links is None else links.union(found)
        labels = linked(links).withColumnRenamed("component", "label")
        named = now.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        then = _apart(named)
        drop(now)
        now = then
    labelled = now.select("token", "node", "n", "label")
    more = across(labelled, "token", "label").groupBy(F.col("x.node").alias("u"), F.col("x.n").alias("a"), F.col("y.node").alias("v"), F.col("y.n").alias("b")).count().filter(_may("a", "b", "count"))
    more = save(more.select("u", "v", "count"), "more")
    release(spark)
    # the partner that a set meets most comes first; then only what these links leave apart
    links = links.union(_verified(more.groupBy("u").agg(F.max(F.struct("count", "v"))["v"].alias("v")), sets, "best"))
    found = linked(links)
    of = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    apart = more.join(of("u"), "u", "left").join(of("v"), "v", "left").filter(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")
    comp = linked(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(_verified(apart, sets, "links")))
    sizes = rows.groupBy("node").agg(F.count("*").alias("c")).join(comp, "node", "left").select("node", "c", F.coalesce("component", "node").alias("component_id"))
    total = rows.count()
    drop(sets, held, met, now, more)
    release(spark)
    return join_heavy(rows, sizes, "node", "c", total).select("id", "component_id")
