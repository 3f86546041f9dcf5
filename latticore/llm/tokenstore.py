"""Token-id files with a minimal-perfect-hash index.

A shard file holds the raw ids of its documents in ascending id order (unsigned 16 or 32 bit,
little endian), then an index, then the index's length and a mark:

    payload | json length (u32) | json | arrays | index length (u64) | b"LATTOK02"

Arrays: `ends` (ids up to and with each document), the levels of the hash function (bit arrays),
and per slot the key's fingerprint (u32), its first row and how many rows it has.  Keys themselves
are not stored.  The manifest, a row a file, has the range of keys of each: a key goes to its file
(or files, where its rows fill several) by binary search, to its slot by a few probes, the
fingerprint tells keys that are not there (but for one in 2^32), and the row gives the offset:
constant time for a keyed read.  read() serves any set of keys this way, sorted by file, so that
payloads are read in long ranges.

Files are written by the tasks into the shared folder under names used once; only files of tasks
that succeeded stand in the manifest, so a lost executor costs its tasks and nothing else.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, save, slices
from .hashing import mix64

MARK = b"LATTOK02"
CHUNK = 1 << 21  # ids of the payload that are read at once
BLOCK = 1 << 16  # files whose key ranges are broadcast at once
CACHE = 1_000_000  # pieces a worker remembers; beyond, it starts anew
#: A space before white space or the end: there the plain cut would not be the tokenizer's.
_WHITE = re.compile(r"\s")
_ODD = re.compile(r" (?=\s|$)")
#: Letters of the Latin blocks, and signs of ASCII (no apostrophe): byte-level BPE cuts between them.
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39)
GAMMA = 2.0
GROUP = 48  # words that are learned in one text


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: level by level, the keys alone on a bit keep it."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, before = [], 0
        for bits in levels:
            self.ranks.append(before + np.concatenate([[0], np.cumsum(bits)]))
            before += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys.view(np.uint64)
        while len(left):
            size = int(GAMMA * len(left)) + 1
            at = (mix64(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has it; a key not built in may get any slot."""
        out, left, rows = np.full(len(keys), -1), keys.view(np.uint64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mix64(left, k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[rows[hit]] = self.ranks[k][at[hit]]
            left, rows = left[~hit], rows[~hit]
        return out


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.view(np.uint64), 1 << 20) >> np.uint64(32)).astype(np.uint32)


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Documents come in ascending order of their keys, null keys first."""

    def __init__(self, uri: str, wide: bool):
        self.fs, self.path = filesystem(uri)
        self.wide, self.ends, self.n = wide, [], 0
        self.keys: list[int] = []  # distinct, of rows that `first` gives
        self.first: list[int] = []
        self.nulls = 0
        self.out = self.fs.open_output_stream(self.path)

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        if key is None:
            self.nulls += 1
        elif not self.keys or self.keys[-1] != key:
            self.keys.append(key)
            self.first.append(len(self.ends))
        self.n += len(ids) // (4 if self.wide else 2)
        self.ends.append(self.n)

    def close(self) -> None:
        keys, first = np.array(self.keys, np.int64), np.array(self.first, np.int64)
        mph = PerfectHash.build(keys)
        slots = mph.slots(keys)
        prints, rows, counts = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        prints[slots], rows[slots] = _fingerprints(keys), first
        counts[slots] = np.diff(first, append=len(self.ends))
        arrays = {"ends": np.array(self.ends, np.int64), "prints": prints, "rows": rows, "counts": counts}
        arrays |= {f"level{k}": np.packbits(bits) for k, bits in enumerate(mph.levels)}
        head = json.dumps({"wide": self.wide, "nulls": self.nulls, "sizes": [len(b) for b in mph.levels], "arrays": [[n, a.dtype.str, len(a)] for n, a in arrays.items()]}).encode()
        index = len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays.values())
        self.out.write(index + len(index).to_bytes(8, "little") + MARK)
        self.out.close()


class Reader:
    """Keyed access to one shard file: the index is held, ids are read from the file by range."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MARK:
            raise ValueError(f"{path} is no token file")
        n = int.from_bytes(tail[:8], "little")
        index = self.file.read_at(n, size - 16 - n)
        head_n = int.from_bytes(index[:4], "little")
        head = json.loads(index[4 : 4 + head_n])
        at, got = 4 + head_n, {}
        for name, kind, count in head["arrays"]:
            got[name] = np.frombuffer(index, kind, count, at)
            at += got[name].nbytes
        self.type = np.dtype("<u4" if head["wide"] else "<u2")
        self.ends, self.prints, self.rows, self.counts = (got[k] for k in ("ends", "prints", "rows", "counts"))
        self.nulls = head["nulls"]
        self.mph = PerfectHash([np.unpackbits(got[f"level{k}"], count=c).astype(bool) for k, c in enumerate(head["sizes"])])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; 0 rows for keys that the file does not hold."""
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self.mph.slots(keys)
        there = (slot >= 0) & (self.prints[slot] == _fingerprints(keys))
        return np.where(there, self.rows[slot], 0), np.where(there, self.counts[slot], 0)

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(rows > 0, self.ends[np.maximum(rows - 1, 0)], 0), self.ends[rows]

    def ids(self, start: int, end: int) -> np.ndarray:
        size = self.type.itemsize
        return np.frombuffer(self.file.read_at((end - start) * size, start * size), self.type)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document with this key."""
        (first,), (n,) = self.find(np.array([key], np.int64))
        return [self.ids(int(a), int(b)) for a, b in zip(*self.bounds(np.arange(first, first + n)), strict=True)]

    def checks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and CRC-32 (of little-endian unsigned 32-bit ids) of rows, whose payload is read in long ranges."""
        starts, ends = self.bounds(rows)
        crc = np.zeros(len(rows), np.int64)
        order = np.argsort(starts, kind="stable")
        i = 0
        while i < len(order):
            j, low = i, int(starts[order[i]])
            # as long as the range stays short, and what is asked for fills a quarter of it
            asked = 0
            while j < len(order) and (j == i or (ends[order[j]] - low <= CHUNK and 4 * (asked + ends[order[j]] - starts[order[j]]) >= ends[order[j]] - low)):
                asked += int(ends[order[j]] - starts[order[j]])
                j += 1
            high = int(ends[order[i:j]].max())
            raw = memoryview(self.ids(low, high).astype("<u4").tobytes())
            for k in order[i:j].tolist():
                crc[k] = zlib.crc32(raw[4 * (int(starts[k]) - low) : 4 * (int(ends[k]) - low)])
            i = j
        return starts, ends, crc


class Store:
    """Keyed access across files on one machine: files is the manifest's (file, first_id, last_id), in their order."""

    def __init__(self, files: list[tuple[str, int | None, int | None]]):
        self.files = [f for f in files if f[1] is not None]
        self.first, self.last = (np.array([f[k] for f in self.files], np.int64) for k in (1, 2))
        self.open: dict[int, Reader] = {}

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key."""
        out = []
        for k in range(int(np.searchsorted(self.last, key)), int(np.searchsorted(self.first, key, "right"))):
            if k not in self.open:
                self.open[k] = Reader(self.files[k][0])
            out += self.open[k].get(key)
        return out


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Byte-level BPE cuts a text before every single space that stands before a character other than
    white space, and pieces do not depend on their neighbours.  So a text is cut there, and the
    library encodes each piece once; a bounded cache holds the ids.  Texts with white space in
    other places or with `<|` (special tokens) are cut at the safe places only, or encoded whole."""

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.wide = max(self.tok.get_vocab_size(), end_id + 1) > 1 << 16
        self.type = np.dtype("<u4" if self.wide else "<u2")
        self.end = np.array([end_id], self.type).tobytes()
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.code = "I" if self.wide else "H"
        self.words = self._words()
        self.known: dict[str, bytes] = {}  # pieces as they are
        self.spaced: dict[str, bytes] = {}  # pieces after one space

    def _words(self):
        """The same model behind a plain cut at line ends, and its letters for bytes; None for
        other kinds of tokenizer.  Words of one class of signs need no more than that."""
        from tokenizers import Tokenizer, pre_tokenizers

        cut = json.loads(self.tok.to_str())
        if self.line is None or cut["normalizer"] or cut["model"]["type"] != "BPE" or cut["truncation"] or cut["padding"]:
            return None
        kind = cut["pre_tokenizer"] or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex"):
            return None
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        table = {}
        for first in range(0x80, 0x250):  # every byte of the UTF-8 of these letters
            raw = chr(first).encode()
            table |= dict(zip(raw, level.pre_tokenize_str(chr(first))[0][0], strict=True))
        plain = Tokenizer(self.tok.model)
        space, line = (level.pre_tokenize_str(c)[0][0] for c in " \n")
        plain.pre_tokenizer = pre_tokenizers.Split(line, "isolated")
        return plain, table, space, line

    def _learn_words(self, new: list[str]) -> list[str]:
        """Learn Latin words after a space, with the signs that follow them, and words with line ends
        between them (one line end before a word is a cut and an id of its own); the pieces that are left."""
        plain, table, space, line = self.words
        lines = {p: c for p in new if "\n" in p and all(c := p.split("\n")) and "<|" not in p and not any(map(_WHITE.search, c))}
        if lines:
            self._learn(self.spaced, {c[0] for c in lines.values()}, " ")
            self._learn(self.known, {x for c in lines.values() for x in c[1:]}, "")
            end = np.array([self.line], self.type).tobytes()
            for p, c in lines.items():
                self.spaced[p] = end.join([self.spaced[c[0]], *[self.known[x] for x in c[1:]]])
            new = [p for p in new if p not in self.spaced]
        heads, signs, signed, left = set(), set(), [], []
        latin = _LATIN.fullmatch
        for p in new:
            word = p.rstrip(_SIGNS)
            if word.isalpha() and (word.isascii() or latin(word)):
                heads.add(word)
                if len(word) != len(p):
                    sign = p[len(word) :]
                    signs.add(sign)
                    signed += p, word, sign  # flat: no object for each
            else:
                left.append(p)
        heads = list(heads.difference(self.spaced))
        self._learn(self.known, signs, "")
        for at in range(0, len(heads), 16384):
            part = heads[at : at + 16384]
            turned = [space + w if w.isascii() else space + w.encode().decode("latin-1").translate(table) for w in part]
            # small groups, as the library's cost grows with a text; a line end after every word
            joined = [line.join(turned[i : i + GROUP]) + line for i in range(0, len(turned), GROUP)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in plain.encode_batch_fast(joined, add_special_tokens=False)), self.type)
            raw, size = ids.tobytes(), ids.itemsize
            ends = np.flatnonzero(ids == self.line) * size
            starts = np.concatenate([[0], ends[:-1] + size])
            self.spaced.update(zip(part, map(raw.__getitem__, map(slice, starts.tolist(), ends.tolist())), strict=True))
        for p, word, sign in zip(signed[::3], signed[1::3], signed[2::3], strict=True):
            self.spaced[p] = self.spaced[word] + self.known[sign]
        return left

    def pieces(self, text: str) -> list[str]:
        if "<|" in text:
            return [text]
        parts = text.split(" ")
        out = [parts[0]] if parts[0] else []
        for i in range(1, len(parts)):
            p = parts[i]
            if p and not p[0].isspace() and p[0] not in "\x1c\x1d\x1e\x1f":
                out.append(" " + p)
            elif out:
                out[-1] += " " + p
            else:
                out.append(" " + p)
        return out

    def _learn(self, known: dict[str, bytes], wanted: set[str], before: str) -> None:
        """Pieces of one word are encoded many to a text, a line end between them: the tokenizer cuts
        there, the line end is one id, and no such piece holds it.  Others are encoded alone."""
        new = list(wanted.difference(known))
        if before and self.words:
            new = self._learn_words(new)
        plain = [p for p in new if p and self.line is not None and not _WHITE.search(p) and "<|" not in p]
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            groups = [part[i : i + 256] for i in range(0, len(part), 256)]
            for g, e in zip(groups, self.tok.encode_batch_fast([before + f"\n{before}".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids, k = [], 0
                for i in e.ids:
                    if i == self.line:
                        known[g[k]] = array(self.code, ids).tobytes()
                        ids, k = [], k + 1
                    else:
                        ids.append(i)
                known[g[k]] = array(self.code, ids).tobytes()
                if k != len(g) - 1:
                    raise ValueError("the tokenizer does not cut at line ends")
        rest = [p for p in new if p not in known] if len(plain) < len(new) else []
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for p, e in zip(part, self.tok.encode_batch_fast([before + p for p in part], add_special_tokens=False), strict=True):
                known[p] = array(self.code, e.ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with the end id, as bytes."""
        for known in (self.known, self.spaced):
            if len(known) > CACHE:
                known.clear()
        out: list[bytes] = [self.end] * len(texts)
        odd = [k for k, t in enumerate(texts) if t and ("<|" in t or _ODD.search(t))]
        cut = [self.pieces(texts[k]) for k in odd]
        self._learn(self.known, set().union(*cut), "")
        for k, pieces in zip(odd, cut, strict=True):
            out[k] = b"".join(map(self.known.__getitem__, pieces)) + self.end
        rest = set(odd)
        rest = [k for k, t in enumerate(texts) if t and k not in rest]
        if rest:
            for k, ids in zip(rest, self._encode_plain([texts[k] for k in rest]), strict=True):
                out[k] = ids
        return out

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Texts in which a plain cut at spaces is the tokenizer's: Arrow cuts them and finds the distinct
        pieces, only these are looked up, and one gather lays out the ids of all texts."""
        import pyarrow.compute as pc

        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends = np.asarray(lists.offsets)[1:].astype(np.int64)
        heads = np.concatenate([[0], ends[:-1]])
        coded = lists.values.dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        first = [distinct[k] for k in index[heads].tolist()]
        self._learn(self.known, set(first), "")
        inner = np.zeros(len(distinct), bool)
        follows = np.ones(len(index), bool)
        follows[heads] = False
        inner[index[follows]] = True
        missing = {p for p, on, ids in zip(distinct, inner.tolist(), map(self.spaced.get, distinct), strict=True) if on and ids is None}
        if missing:
            self._learn(self.spaced, missing, " ")
        pieces = [self.spaced[p] if on else b"" for p, on in zip(distinct, inner.tolist(), strict=True)]
        pieces += map(self.known.__getitem__, first)
        pieces.append(self.end)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.type.itemsize
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(pieces), self.type)
        index[heads] = len(distinct) + np.arange(len(texts))
        index = np.insert(index, ends, len(pieces) - 1)  # the end id after each text's last piece
        n = size[index]
        upto = np.cumsum(n)
        ids = flat[np.repeat(start[index] - (upto - n), n) + np.arange(upto[-1])].tobytes()
        last = upto[ends + np.arange(len(texts))] * self.type.itemsize
        return [ids[a:b] for a, b in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]


_ENCODERS: dict[tuple, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write(docs: DataFrame, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, most_ids: int = 1 << 26) -> DataFrame:
    """Encode and write all rows in ascending id order; -> the manifest, one row a shard file:
    part, piece (their order is the files' order), file, n_docs, n_tokens, n_null, first and last id.

    Null texts are as empty (the end id alone).  Null ids come first and have no key.  Rows with one
    id keep all their ids, ordered by a hash of the text, then the text, so that however many share an
    id (or have none), several tasks write them."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)

    def run(batches):
        import uuid

        from pyspark import TaskContext

        key = (path or default_path(), end_id)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(*key)
        enc = _ENCODERS[key]
        part = TaskContext.get().partitionId()
        out, piece, name = None, 0, ""

        def done():
            out.close()
            cols = [[part], [piece], [name], [len(out.ends)], [out.n], [out.nulls], [min(out.keys, default=None)], [max(out.keys, default=None)]]
            kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "piece", "file", "n_docs", "n_tokens", "n_null", "first_id", "last_id"])

        for b in slices(batches, 4000):
            for k, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                if out is None:
                    name = f"{folder}/shard-{part:06d}-{piece:04d}-{uuid.uuid4().hex[:10]}.bin"
                    out = Writer(name, enc.wide)
                out.add(k, ids)
                if out.n >= most_ids:
                    yield done()
                    out, piece = None, piece + 1
        if out is not None:
            yield done()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "t").select("id", "t")
    return save(rows.mapInArrow(run, "part int, piece int, file string, n_docs long, n_tokens long, n_null long, first_id long, last_id long"), "manifest")


def read(manifest: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document whose id stands in keys, through the files' indexes.

    Each distinct key is looked up once and gives all its documents; a null among the keys gives the
    documents without an id; keys that no file holds give nothing.  Key ranges of 65,536 files are
    broadcast at once (a few MB); a larger store is read in blocks of that many."""
    order = Window.orderBy("part", "piece")  # a row a file
    files = manifest.withColumn("base", F.sum("n_tokens").over(order) - F.col("n_tokens")).withColumn("k", F.row_number().over(order) - 1)
    files = save(files.select("k", "file", "base", "n_null", "first_id", "last_id"), "files")
    asked = save(keys.select(F.col(id_col).cast("long").alias("id")).distinct(), "asked")
    spark = manifest.sparkSession
    out = None
    for at in range(0, max(files.count(), 1), BLOCK):
        block = files.filter(F.col("k").between(at, at + BLOCK - 1)).orderBy("k").collect()
        held = spark.sparkContext.broadcast([(r.file, r.base, r.n_null, r.first_id, r.last_id) for r in block])
        part = _read(asked, held, spark.sparkContext.defaultParallelism * 4)
        out = part if out is None else out.union(part)
    return out


def _read(asked: DataFrame, held, tasks: int) -> DataFrame:
    def route(batches):
        keyed = [k for k, f in enumerate(held.value) if f[3] is not None]
        first, last = (np.array([held.value[k][c] for k in keyed], np.int64) for c in (3, 4))
        at = np.array(keyed, np.int64)
        none = np.array([k for k, f in enumerate(held.value) if f[2]], np.int64)
        for b in batches:
            null = np.asarray(b.column(0).is_null())
            ids = b.column(0).drop_null().to_numpy()
            low, high = np.searchsorted(last, ids), np.searchsorted(first, ids, "right")
            n = np.maximum(high - low, 0)
            row = np.repeat(np.arange(len(ids)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            file = np.concatenate([at[low[row] + step], none if null.any() else none[:0]])
            yield pa.RecordBatch.from_arrays([pa.array(file), pa.array(np.concatenate([ids[row], np.zeros(len(file) - len(row), np.int64)]), mask=np.arange(len(file)) >= len(row))], ["k", "id"])

    def serve(batches):
        mark, r = None, None
        for b in batches:
            file, ids, null = b.column(0).to_numpy(), b.column(1).fill_null(0).to_numpy(), np.asarray(b.column(1).is_null())
            cuts = np.flatnonzero(np.diff(file, prepend=-1))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(file)), strict=True):
                name, base = held.value[file[lo]][:2]
                if mark != file[lo]:
                    mark, r = file[lo], Reader(name)
                own, none = ids[lo:hi], null[lo:hi]
                first, n = r.find(own)
                first, n = np.where(none, 0, first), np.where(none, r.nulls, n)
                for s in range(0, len(own), 4096):
                    f, c = first[s : s + 4096], n[s : s + 4096]
                    row = np.repeat(f, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    who, empty = np.repeat(own[s : s + 4096], c), np.repeat(none[s : s + 4096], c)
                    for t in range(0, len(row), 1 << 16):
                        start, end, crc = r.checks(row[t : t + (1 << 16)])
                        yield pa.RecordBatch.from_arrays([pa.array(who[t : t + (1 << 16)], mask=empty[t : t + (1 << 16)]), pa.array(base + start), pa.array(end - start), pa.array(crc)], ["id", "start", "n_tokens", "ids_crc32"])

    routed = asked.mapInArrow(route, "k long, id long").repartition(tasks, "k").sortWithinPartitions("k", "id")
    return routed.mapInArrow(serve, "id long, start long, n_tokens long, ids_crc32 long")
