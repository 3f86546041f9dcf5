"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits, each a (shortened) word of
the perfect binary Golay code [23,12,7].  Decoding a word and its neighbours gives 12-bit codeword
indices, 1 or 6 of them: its fuzzy keys.  Two words 2 or fewer bits apart always share one.

Pigeonhole: 4 or fewer differing bits in 3 segments leave one of these, so that every such pair
shares a key, of 35 to 42 bits and at most 2^-30 likely for two fingerprints by chance:

- a segment without error and another with one at most: the first as it is, and two thirds of the other;
- a segment with two at most and one at most in each other: a fuzzy key, and two thirds of each other;
- a segment without error and two in each other: it as it is, a fuzzy key of one, a third of the last.

Nothing lists all pairs of a group: fingerprints that share a key of the first kind are linked to
the least one of their bucket if that lies within 4 bits (linear), components of these links are
labels, and only fingerprints of different labels are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import across, join_heavy, marked, marks, release, save, slices
from .graph import linked
from .hashing import mix64

SEGMENTS = (22, 21, 21)
#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the binary Golay code.
GENERATOR = 0b110001110101


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator."""
    rest = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
    return rest


def error_table() -> np.ndarray:
    """Error pattern of weight 3 at most for each of the 2048 syndromes: the code is perfect."""
    bit = [1 << i for i in range(23)]
    errors = [0] + bit + [bit[i] | bit[j] for i in range(23) for j in range(i)] + [bit[i] | bit[j] | bit[k] for i in range(23) for j in range(i) for k in range(j)]
    patterns = np.array(errors, np.uint32)
    out = np.zeros(2048, np.uint32)
    out[syndrome(patterns)] = patterns
    return out


def decode(words: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword within 3 bits of each 23-bit word."""
    return (words ^ errors[syndrome(words)]) >> 11


def fuzzy(words: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and index of every distinct fuzzy key, 1 or 6 a word.

    These are the codewords within 4 bits of a word 3 bits from its own codeword, else its own alone.
    Two words at most 2 bits apart always share one."""
    flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)
    found = np.sort(decode(words[:, None] ^ flips[None, :], errors), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, col = np.nonzero(new)
    return row, found[row, col]


def segments(fp: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for bits in SEGMENTS:
        out.append((fp >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.uint64))
        at += bits
    return out


def _thirds(segment: np.ndarray) -> list[np.ndarray]:
    """The three parts of a segment, of 7 bits (the last may have 8)."""
    low = np.uint64(127)
    return [segment & low, segment >> np.uint64(7) & low, segment >> np.uint64(14)]


def _join(tag: int, *parts: tuple[np.ndarray, int]) -> np.ndarray:
    """A uniform 64-bit hash (one to one) of the parts, each of so many bits at most, side by side under a tag."""
    key = np.full(len(parts[0][0]), tag, np.uint64)
    for part, bits in parts:
        key = key << np.uint64(bits) | part.astype(np.uint64)
    return mix64(key, 0).view(np.int64)


def exact_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): a segment as it is and two thirds of another, 18 a fingerprint, 35 bits or more."""
    parts = segments(fp)
    thirds = [_thirds(s) for s in parts]
    keys = []
    for x in range(3):
        for z in range(3):
            for i in range(3):
                if x != z:
                    a, b = (thirds[z][k] for k in range(3) if k != i)
                    keys.append(_join(x * 9 + z * 3 + i, (parts[x], 22), (a, 8), (b, 8)))
    return np.tile(np.arange(len(fp)), len(keys)), np.concatenate(keys)


def fuzzy_keys(fp: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key), 40 bits or more, about 190 a fingerprint: a fuzzy key of one segment with
    two thirds of each of the others (27), or with a whole segment and one third of the last (9)."""
    parts = segments(fp)
    thirds = [_thirds(s) for s in parts]
    rows, keys = [], []
    for y in range(3):
        row, near = fuzzy(parts[y].astype(np.uint32), errors)
        x, z = (k for k in range(3) if k != y)
        for i in range(3):
            for j in range(3):
                a, b = (thirds[x][k][row] for k in range(3) if k != i)
                c, d = (thirds[z][k][row] for k in range(3) if k != j)
                rows.append(row)
                keys.append(_join(32 + y * 9 + i * 3 + j, (near, 12), (a, 8), (b, 8), (c, 8), (d, 8)))
        whole, last = (x, z) if y == 0 else (z, x) if y == 1 else (x, z)
        # y fuzzy, `whole` clean, `last` with 2 errors at most: each segment is the clean one once
        for i in range(3):
            rows.append(row)
            keys.append(_join(64 + y * 3 + i, (near, 12), (parts[whole][row], 22), (thirds[last][i][row], 8)))
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of one text, in UTF-8."""
    import xxhash

    words = (text or b"").lower().split()  # of bytes: A-Z only, and the white space of the contract
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: len(words) - shingle]])
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long) for every row of docs; a null or wordless text has fingerprint 0."""

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64), pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "id long, fp long")


def _keys(fps: DataFrame, errors: bool, only=None) -> DataFrame:
    """(key, fp, label) of fps(fp, label): the exact keys, and the fuzzy ones with `errors`; those in the bit table `only` alone."""

    def run(batches):
        table = error_table()
        for b in slices(batches, 1000):
            fp, label = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            row, key = exact_keys(fp.view(np.uint64))
            if errors:
                row, key = (np.concatenate(x) for x in zip((row, key), fuzzy_keys(fp.view(np.uint64), table), strict=True))
            if only is not None:
                on = marked(only.value, key)
                row, key = row[on], key[on]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(label[row])], ["key", "fp", "label"])

    return fps.select("fp", "label").mapInArrow(run, "key long, fp long, label long")


def _close(a: str, b: str, most: int) -> F.Column:
    return F.expr(f"bit_count({a} ^ {b}) <= {most}")


def candidates(labelled: DataFrame) -> DataFrame:
    """(key, x, y): the fingerprints of different labels that share a key, before any is verified."""
    # nearly all keys are met once: they are dealt out as they are, without a sum in each task that would hold them all
    dealt = _keys(labelled, True).select("key", "label").repartition("key")
    several = dealt.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q")).filter("p < q").select("key")
    held = marks(several, "key")
    release(labelled.sparkSession)
    return across(_keys(labelled, True, held), "key", "label")


def link(fps: DataFrame, most: int = 4) -> DataFrame:
    """fps(fp) distinct -> (node, component) of every fingerprint, linked within `most` (4 at most) bits."""
    if most > 4:
        raise ValueError("the keys cover 4 differing bits")
    near = _keys(fps.select("fp", F.col("fp").alias("label")), False).select("key", "fp")
    hub = near.groupBy("key").agg(F.min("fp").alias("hub"), F.max("fp").alias("last")).filter("hub < last").select("key", "hub")
    stars = near.join(hub, "key").filter((F.col("fp") != F.col("hub")) & _close("fp", "hub", most))
    first = linked(stars.select(F.col("fp").alias("u"), F.col("hub").alias("v")))
    labelled = save(fps.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("label")), "labelled")
    pairs = candidates(labelled).filter(_close("x.fp", "y.fp", most)).select(F.col("x.label").alias("u"), F.col("y.label").alias("v"))
    second = linked(pairs)
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n"))
    names = sizes.join(second.withColumnRenamed("node", "label"), "label", "left").select("label", "n", F.coalesce("component", "label").alias("component"))
    return join_heavy(labelled, names, "label", "n", labelled.count()).select(F.col("fp").alias("node"), "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4, shingle: int = 4) -> DataFrame:
    """(id, fp, component_id) for every row of docs.

    Fingerprints link at `most` or fewer differing bits; component_id is the least id of the
    component.  Null and empty texts share fingerprint 0.  Rows with equal ids stay separate rows;
    a null id is kept and never is a component_id unless all ids of its component are null.

    Rows of one very common fingerprint, and fingerprints of one very large component, stay where
    they are: what is heavy is joined by broadcast (under 1000 keys)."""
    own = save(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    per = save(own.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    comp = save(link(per.select("fp"), most).withColumnRenamed("node", "fp"), "components")
    placed = save(per.join(comp, "fp"), "placed")
    first = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    found = join_heavy(placed, first, "component", "m", placed.count()).select("fp", "n", "component_id")
    return join_heavy(own, found, "fp", "n", own.count()).select("id", "fp", "component_id")
