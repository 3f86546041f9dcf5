"""Language identification by interpolated Kneser-Ney character models.

Letters count as they are, in lower case; anything else is one class, runs of it once.  Counts of
4-grams cover all documents that may be learned from, but for a tenth kept to calibrate; lower orders are the
continuation counts that follow from them.  A language's model is sorted arrays: 64-bit hashes of
its 4-grams, and its 3-, 2- and 1-grams as they are (21 bits a character), each with its discounted
share, and contexts with their back-off weights.  Nothing is pruned, so a model grows with the
distinct 4-grams of its language.  Models are built by tasks, one a language, and stand as files
in the shared folder; the driver sees only their names.

A text goes to the language of the least cross-entropy per 4-gram.  `accepted` tells whether that
lies within the range of the language's own documents, and `score` is a softmax whose sharpness fits
best; both are calibrated on the documents that were not counted, by sums over all of them.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, new_path, save, slices
from .hashing import mix64

BITS = 21
ORDER = 4
#: Sharpness of the score that calibration chooses from.
SHARP = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
TABLE = 0x30000
_FOLDED: np.ndarray | None = None


def _fold(cp: int) -> int:
    c = chr(cp)
    return ord(c.lower()[0]) if c.isalpha() else 0


def letters(text: str | None) -> np.ndarray:
    """Each letter's code point in lower case, runs of other characters as one 0, with a 0 at both ends; empty without a letter."""
    global _FOLDED
    if _FOLDED is None:
        _FOLDED = np.array([_fold(c) if not 0xD800 <= c < 0xE000 else 0 for c in range(TABLE)], np.uint32)
    cp = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _FOLDED[np.minimum(cp, TABLE - 1)]
    if (high := cp >= TABLE).any():
        c[high] = [_fold(int(x)) for x in cp[high]]
    if not c.any():
        return np.zeros(0, np.int64)
    c = np.concatenate([[0], c, [0]]).astype(np.int64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    return c[keep]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(first character, the other three packed) of all 4-grams; a text too short for one is padded with 0."""
    c = letters(text)
    if len(c) and len(c) < ORDER:
        c = np.concatenate([c, np.zeros(ORDER - len(c), np.int64)])
    if not len(c):
        return c, c
    return c[:-3], c[1:-2] << (2 * BITS) | c[2:-1] << BITS | c[3:]


def key4(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of 4-grams."""
    with np.errstate(over="ignore"):
        return (mix64(a, 1) + mix64(b, 2)).view(np.int64)


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, a, b, n) of the 4-grams of all rows with a language: summed in each task, then by key."""

    def run(batches):
        held: dict[str, list] = {}
        total: dict[str, tuple] = {}
        size = 0

        def fold():
            for lang, got in held.items():
                a, b = (np.concatenate(x) for x in zip(*got, strict=True))
                n = np.ones(len(a), np.int64)
                if lang in total:
                    a, b, n = (np.concatenate(x) for x in zip((a, b, n), total[lang], strict=True))
                key, at, back = np.unique(key4(a, b), return_index=True, return_inverse=True)
                total[lang] = a[at], b[at], np.bincount(back, weights=n).astype(np.int64)
            held.clear()

        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = grams(text)
                held.setdefault(lang, []).append(g)
                size += len(g[0])
                if size > 1 << 22:
                    fold()
                    size = 0
        fold()
        for lang, (a, b, n) in total.items():
            for at in range(0, len(a), 1 << 16):
                s = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a[s]), pa.string()), pa.array(a[s]), pa.array(b[s]), pa.array(n[s])], ["lang", "a", "b", "n"])

    known = docs.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    return known.mapInArrow(run, "lang string, a long, b long, n long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))


class KneserNey:
    """Interpolated Kneser-Ney over 4-gram counts: sorted keys, and log probabilities by search."""

    def __init__(self, orders: list[tuple[np.ndarray, ...]]):
        self.orders = orders  # from the lowest: (keys, discounted share, context keys, back-off weights)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> KneserNey:
        key, ctx, low = key4(a, b), a << (2 * BITS) | b >> BITS, b
        n = n.astype(np.float64)
        orders = []
        for k in range(ORDER, 0, -1):
            once, twice = (n == 1).sum(), (n == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.5
            contexts, at = np.unique(ctx, return_inverse=True)
            total = np.bincount(at, weights=n)
            order = np.argsort(key)
            orders.append((key[order], (np.maximum(n - d, 0) / total[at])[order], contexts, d * np.bincount(at) / total))
            key, n = np.unique(low, return_counts=True)  # continuation: in how many contexts the shorter gram ends
            n = n.astype(np.float64)
            ctx, low = key >> BITS, key & ((1 << (BITS * max(k - 2, 0))) - 1)
        return cls(orders[::-1])

    def log_prob(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = np.full(len(a), 2.0**-BITS)
        for k, (key, mass, ctx, back) in enumerate(self.orders, 1):
            if k == ORDER:
                g, c = key4(a, b), a << (2 * BITS) | b >> BITS
            else:
                g = b & ((1 << (BITS * k)) - 1)
                c = g >> BITS
            i = np.minimum(np.searchsorted(key, g), len(key) - 1)
            j = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
            p = np.where(ctx[j] == c, np.where(key[i] == g, mass[i], 0.0) + back[j] * p, p)
        return np.log(p)

    def save(self, uri: str) -> None:
        from pyarrow import fs

        raw = io.BytesIO()
        np.savez(raw, **{f"x{k}_{i}": x for k, o in enumerate(self.orders) for i, x in enumerate(o)})
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as out:
            out.write(raw.getbuffer())

    @classmethod
    def load(cls, uri: str) -> KneserNey:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as got:
            return cls([tuple(got[f"x{k}_{i}"] for i in range(4)) for k in range(ORDER)])


@dataclass
class Model:
    langs: list[str]
    files: list[str]
    #: Per language: the largest cross-entropy that is accepted.
    sure: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sharp: float = 8.0

    def scorer(self):
        """A function from texts to cross-entropies, a column a language; infinite without a letter."""
        models = [KneserNey.load(f) for f in self.files]

        def entropies(texts: list[str | None]) -> np.ndarray:
            found = [grams(t) for t in texts]
            out = np.full((len(found), max(len(models), 1)), np.inf)
            full = [i for i, g in enumerate(found) if len(g[0])]
            if not full or not models:
                return out
            a, b = (np.concatenate([found[i][k] for i in full]) for k in (0, 1))
            n = np.array([len(found[i][0]) for i in full])
            _, at, back = np.unique(key4(a, b), return_index=True, return_inverse=True)
            h = np.stack([-m.log_prob(a[at], b[at]) for m in models], axis=1)
            out[full] = np.add.reduceat(h[back], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None]
            return out

        return entropies


def _calibrate(docs: DataFrame, model: Model, spread: float) -> Model:
    """Limits and sharpness from sums over all of docs (text, lang): no text leaves its task."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ["lang", "n", "s", "ss", *[f"l{k}" for k in range(len(SHARP))]]

    def run(batches):
        m = held.value
        look = m.scorer()
        place = {lang: k for k, lang in enumerate(m.langs)}
        for b in slices(batches, 2000):
            h = look(b.column(0).to_pylist())
            own = np.array([place.get(x, -1) for x in b.column(1).to_pylist()], np.int64)
            on = (own >= 0) & np.isfinite(h[:, 0])
            h, own = h[on], own[on]
            true = h[np.arange(len(h)), own]
            loss = [np.log(np.exp(-t * (h - true[:, None])).sum(axis=1)) for t in SHARP]
            cols = [[m.langs[k] for k in own], np.ones(len(h)), true, true * true, *loss]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.float64()) for i, c in enumerate(cols)], names)

    sums = docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, ", ".join(f"{n} {'string' if n == 'lang' else 'double'}" for n in names))
    got = {r["lang"]: r for r in sums.groupBy("lang").agg(*[F.sum(n).alias(n) for n in names[1:]]).collect()}
    for k, lang in enumerate(model.langs):
        if lang in got:
            n, s, ss = (got[lang][c] for c in ("n", "s", "ss"))
            model.sure[k] = s / n + spread * max(np.sqrt(max(ss / n - (s / n) ** 2, 0)), 0.05)
    if got:
        model.sharp = SHARP[int(np.argmin([sum(r[f"l{k}"] for r in got.values()) for k in range(len(SHARP))]))]
    return model


def fit(docs: DataFrame, spread: float = 4.0, kept: int = 10) -> Model:
    """Learn from all documents that may be learned from (not held out, lang not null).

    One in `kept` of them (by a hash of doc_id and text) is not counted but calibrates.  A language
    that calibration meets nowhere accepts everything."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    fold = F.pmod(F.xxhash64("doc_id", "text"), F.lit(kept)) == 0
    counts = save(gram_counts(known.filter(~fold)), "grams")
    folder = new_path(docs.sparkSession, "langid")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import uuid

        name = f"{folder}/{uuid.uuid4().hex}.npz"
        KneserNey.build(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["n"].to_numpy()).save(name)
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "file": [name]})

    files = sorted((r.lang, r.file) for r in counts.groupBy("lang").applyInPandas(build, "lang string, file string").collect())
    model = Model([x for x, _ in files], [x for _, x in files], np.full(len(files), np.inf))
    return _calibrate(known.filter(fold), model, spread) if files else model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted, entropy) for every row.

    A null text or one without a letter is `und` with score 0; ties go to the first language in
    code point order.  With no learned language all is `und`.  Rows that share an id stay rows of
    their own, and columns of docs other than the two do not matter."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        look = m.scorer()
        for b in slices(batches, 2000):
            h = look(b.column(1).to_pylist())
            best = h.argmin(axis=1)
            low = h[np.arange(len(h)), best]
            ok = np.isfinite(low)
            rest = np.where(ok[:, None], h - np.where(ok, low, 0)[:, None], 0)
            score = np.where(ok, 1 / np.exp(-m.sharp * rest).sum(axis=1), 0.0)
            sure = low <= m.sure[best] if m.langs else ok
            name = [m.langs[k] if o else "und" for k, o in zip(best, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name, pa.string()), pa.array(score), pa.array(ok & sure), pa.array(np.where(ok, low, np.nan), from_pandas=True)], ["id", "lang_pred", "score", "accepted", "entropy"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, lang_pred string, score double, accepted boolean, entropy double")
