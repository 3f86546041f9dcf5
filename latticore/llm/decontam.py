"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage of a document by k = floor(rate * m) edits.
Cut into k + 1 pieces, at least one piece then stands unchanged in the passage.  The pieces' first
8 characters (all of shorter ones) are looked up by a 64-bit hash of every window of the document:
one pass, a few array operations a text.  Around each hit Myers' bit-parallel algorithm computes
the least edit distance of larger and larger parts of the item (runs of p pieces, which may hold
p - 1 edits), for many hits at once while a part fits 64 bits, and of the item itself: k or fewer
is a match.  An item too short for an edit (under 10 characters at 10 %) must stand there as whole words.

Texts are compared in lower case with white space runs as one space.  All items up to BLOCK
characters are matched in one pass over the documents; a larger benchmark takes one for each block,
so that what a task holds does not grow with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, slices

RATE = 0.1
BLOCK = 1 << 25  # characters of items in a block
ANCHOR = 8
HITS = 4096  # hits that are verified at once
_MULT = np.uint64(0x9E3779B97F4A7C15)
_NONE, _END = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)
CHARS = 1 << 19  # characters of texts that are searched together


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def windows(cp: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of `size` characters, built from those of half the size."""
    if len(cp) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if size == 1:
            h = (cp.astype(np.uint64) + np.uint64(1)) * _MULT
            return h ^ (h >> np.uint64(29))
        left = size // 2
        a = windows(cp, left)
        b = a if size == 2 * left else windows(cp, size - left)
        n = len(cp) - size + 1
        h = a[:n] * np.uint64(2 * size + 1) + (b[left : left + n] ^ (b[left : left + n] >> np.uint64(31))) * _MULT
        return h ^ (h >> np.uint64(29))


def myers(item: str, text: str, most: int) -> tuple[int, int]:
    """(distance, end) of the substring of text nearest to item, the first of equals; distance most + 1 if none is near."""
    m = len(item)
    eq: dict[str, int] = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    for j, c in enumerate(text):
        e = eq.get(c, 0)
        xh = (((e & pv) + pv) ^ pv) | e | mv
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
            if not score:
                break
        ph = (ph << 1) & full  # no carry in: a match may start anywhere
        mh = (mh << 1) & full
        xv = e | mv
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best, end


def myers_many(patterns: np.ndarray, m: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Distance of the nearest substring of each row of texts to the row's pattern of m (1 to 64) characters.

    Rows are padded: patterns anyhow, texts with a character that no pattern has."""
    one, full = np.uint64(1), np.full(len(m), 2**64 - 1, np.uint64) >> (np.uint64(64) - m.astype(np.uint64))
    top = one << (m.astype(np.uint64) - one)
    bit = one << np.arange(patterns.shape[1], dtype=np.uint64)
    pv, mv, score = full.copy(), np.zeros(len(m), np.uint64), m.astype(np.int64)
    best = score.copy()
    with np.errstate(over="ignore"):
        for j in range(texts.shape[1]):
            e = ((patterns == texts[:, j : j + 1]) * bit).sum(axis=1, dtype=np.uint64) & full
            xh = (((e & pv) + pv) ^ pv) | e | mv
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            score += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
            np.minimum(best, score, out=best)
            ph, mh = (ph << one) & full, (mh << one) & full
            xv = e | mv
            pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str | None]], rate: float = RATE):
        self.items: list[tuple[int, str, int]] = []
        found: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        for item_id, text in items:
            t = plain(text)
            if not t:
                continue
            m, k = len(t), int(rate * len(t))
            size = min(m // (k + 1), ANCHOR)
            own = windows(codes(t), size)[[i * m // (k + 1) for i in range(k + 1)]]
            found.setdefault(size, []).append((own, len(self.items), k + 1))
            self.items.append((item_id, t, k))
        self.text = np.concatenate([codes(t) for _, t, _ in self.items]) if self.items else np.zeros(0, np.uint32)
        self.size = np.array([len(t) for _, t, _ in self.items], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.budget = np.array([k for _, _, k in self.items], np.int64)
        self.anchors = {}
        for size, uses in found.items():
            h = np.concatenate([u[0] for u in uses])
            item = np.repeat([u[1] for u in uses], [u[2] for u in uses])
            leaf = np.concatenate([np.arange(u[2]) for u in uses])
            order = np.argsort(h, kind="stable")
            bits = max(16, min(27, int(16 * len(h)).bit_length()))
            table = np.zeros(1 << bits, bool)
            table[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.anchors[size] = (h[order], item[order], leaf[order], table, np.uint64(64 - bits))

    def hits(self, cp: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, piece, where the item would start, where the anchor stands) of every anchor in the text."""
        out = []
        for size, (known, item, leaf, table, shift) in self.anchors.items():
            h = windows(cp, size)
            pos = np.flatnonzero(table[(h >> shift).astype(np.int64)])
            if not len(pos):
                continue
            low, high = np.searchsorted(known, h[pos]), np.searchsorted(known, h[pos], "right")
            n = high - low
            entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            which, piece = item[entry], leaf[entry]
            at = np.repeat(pos, n)
            out.append((which, piece, at - piece * self.size[which] // (self.budget[which] + 1), at))
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def near(self, cp: np.ndarray, item: np.ndarray, piece: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which hits have all parts around the piece, as far as they fit 64 characters, within the budget of each.

        Halving a run of p pieces with budget p - 1 again and again, one half of each always stays
        within its own count less one (else both would exceed it, and so would the run).  So a match has
        a piece that stands unchanged and whose every ancestor stays within its budget."""
        n, m = self.budget[item] + 1, self.size[item]
        lo, hi, levels = np.zeros(len(item), np.int64), n.copy(), []
        while True:
            levels.append((lo, hi))
            if (hi - lo <= 1).all():
                break
            mid = (lo + hi) // 2
            on = hi - lo > 1
            lo, hi = np.where(on & (piece >= mid), mid, lo), np.where(on & (piece < mid), mid, hi)
        keep = np.ones(len(item), bool)
        for lo, hi in levels[::-1]:
            a, b, e = lo * m // n, hi * m // n, hi - lo - 1
            row = np.flatnonzero(keep & (e > 0) & (b - a <= 64))
            for s in range(0, len(row), HITS):
                r = row[s : s + HITS]
                size, most = b[r] - a[r], e[r]
                pattern = self.text[np.minimum((self.at[item[r]] + a[r])[:, None] + np.arange(size.max()), len(self.text) - 1)]
                where = (start[r] + a[r] - most)[:, None] + np.arange((size + 2 * most).max())
                inside = (where >= 0) & (where < len(cp)) & (np.arange(where.shape[1]) < (size + 2 * most)[:, None])
                text = np.where(inside, cp[np.clip(where, 0, len(cp) - 1)], _NONE)
                keep[r] = myers_many(pattern, size, text) <= most
        return keep

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the plain text) of every item that the text holds."""
        return self.find_all([text])[0]

    def find_all(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """find() of each text; hits of many texts (about CHARS characters) are verified together."""
        out: list[list[tuple[int, int, int]]] = []
        held: list[str] = []
        size = 0
        for t in map(plain, texts):
            held.append(t)
            size += len(t)
            if size >= CHARS:
                out += self._find(held)
                held, size = [], 0
        return out + self._find(held)

    def _find(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not self.items or not any(texts):
            return out
        # one array, a character that nothing has after each text
        cp = np.concatenate([x for t in texts for x in (codes(t), [_END])]).astype(np.uint32)
        first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        item, piece, start, anchor = self.hits(cp)
        if not len(item):
            return out
        keep = self.near(cp, item, piece, start)
        doc = np.searchsorted(first, anchor[keep], "right") - 1
        found: dict[tuple[int, int], set[int]] = {}
        for k, n, s in zip(doc.tolist(), item[keep].tolist(), (start[keep] - first[doc]).tolist(), strict=True):
            found.setdefault((k, n), set()).add(s)
        for (k, n), starts in found.items():
            if hit := self._verify(texts[k], n, sorted(starts)):
                out[k].append(hit)
        return out

    def _verify(self, t: str, n: int, starts: list[int]) -> tuple[int, int, int] | None:
        item_id, pattern, k = self.items[n]
        m = len(pattern)
        whole = lambda s: k or ((s == 0 or t[s - 1] == " ") and (s + m == len(t) or t[s + m] == " "))
        exact = next((s for s in starts if s >= 0 and t.startswith(pattern, s) and whole(s)), None)
        if exact is not None:
            return item_id, 0, exact + m
        best = (k + 1, -1)
        i = 0
        while k and i < len(starts):
            # windows of starts that lie within the error budget of each other are searched as one
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= 2 * k:
                j += 1
            lo, hi = max(0, starts[i] - k), min(len(t), starts[j] + m + k)
            if hi - lo >= m - k:
                d, end = myers(pattern, t[lo:hi], k)
                best = min(best, (d, lo + end))
            i = j + 1
        return (item_id, *best) if best[0] <= k else None


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, distance, end_at): one row for each document row and item that it holds.

    Null and empty texts hold nothing; items that are null, empty or without an id match nothing;
    repeated items and repeated documents are reported one by one, a null id of a document is kept."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("t")).filter("item_id is not null and t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // BLOCK) or 1
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    out = None
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == k)  # about BLOCK characters
        held = spark.sparkContext.broadcast([(r.item_id, r.t) for r in own.orderBy("item_id", "t").collect()])

        def run(batches, held=held):
            m = Matcher(held.value, rate)
            for b in slices(batches):
                rows = [(i, *x) for i, own in zip(b.column(0).to_pylist(), m.find_all(b.column(1).to_pylist()), strict=True) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["id", "item_id", "distance", "end_at"])

        part = source.mapInArrow(run, "id long, item_id long, distance int, end_at int")
        if blocks > 1:  # one block's items are held at a time
            part = save(part, "matches")
            held.destroy()
        out = part if out is None else out.union(part)
    return out
