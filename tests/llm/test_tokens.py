import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from latticore.llm import tokenstore, viterbi

TEXTS = [None, "", " ", "  ", "a", "Hello, world! It's 10 o'clock.\n\n  New  line \t tab x", "ñandú çé — 漢字 😀😀", "<|endoftext|> a <|endoftext|>", "x " * 30000, "\n \n \ny \r\n z", "a \x1c b　c"]
odd = st.text(alphabet=st.sampled_from("ab '\n\t .,1é漢<|\x1c "), max_size=40)


@pytest.fixture(scope="module")
def encoder():
    return tokenstore.Encoder(tokenstore.default_path(), 2)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def ids(enc, text):
    return np.frombuffer(enc.encode([text])[0], enc.type).tolist()


@settings(max_examples=600, deadline=None)
@given(odd)
def test_encoder_is_the_library(encoder, library, text):
    assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids + [2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abz.,'!1é漢😀\n\u0085"), min_size=1, max_size=9), max_size=40))
def test_words_are_the_library(encoder, library, words):
    encoder.spaced.clear()
    text = "x " + " ".join(words)
    assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("text", [
    "Ä ö ß, ñandú: x' y's a's! Ǆ ɏ× ÷a ªº µ b<|endoftext|> c", "a.\nB c\n\nd e\n f\ng h\n", "x\n\x1cy z\r\nw q\u2028r s\x85t",
    "a b\nc\nd é\nÉ.\n<|endoftext|> x", ", a !! b?! c) d\" e_f g_ h- -i", "don't can't'll we'll' it''s", "Ünïcödé\u0301 x\u0301 naïve. ſ K Å",
    "a " + " ".join(chr(c) + "x," for c in range(0xC0, 0x250)),
])
def test_latin_words_signs_and_lines_are_the_library(encoder, library, text):
    assert encoder.words is not None
    encoder.spaced.clear()
    encoder.known.clear()
    assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids + [2]


def test_store_round_trip(spark, library):
    rows = [(i * 7 - 20, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, None), (1, "same"), (1, "id"), (1, "same")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    manifest = tokenstore.write(df, most_ids=5000)
    got = sorted(tokenstore.read(manifest, df).collect(), key=lambda r: r.start)
    x = {t: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t in rows}
    key = lambda i, n, c: (i is not None, i or 0, n, c)
    assert sorted(key(r.id, r.n_tokens, r.ids_crc32) for r in got) == sorted(key(i, len(x[t]), zlib.crc32(x[t].tobytes())) for i, t in rows)
    order = [(r.id is not None, r.id or 0) for r in got]
    assert order == sorted(order) and [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    files = manifest.orderBy("part", "piece").collect()
    store = tokenstore.Store([(m.file, m.first_id, m.last_id) for m in files])
    assert len(files) > 1 and store.get(10**15) == []
    for i in (-20, 1, 15, 36):
        want = sorted(x[t].tolist() for k, t in rows if k == i)
        assert sorted(a.tolist() for a in store.get(i)) == want
    assert {r.id for r in tokenstore.read(manifest, df.filter("doc_id in (1, 15)")).collect()} == {1, 15}
    assert tokenstore.read(manifest, df.limit(0)).count() == 0
    assert tokenstore.read(tokenstore.write(df.limit(0)), df).count() == 0


def test_rows_come_through_the_index(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"words of text number {i} " * (i % 5 + 1)) for i in range(60)], "doc_id long, text string").coalesce(1)
    key = lambda rows: sorted(tuple(r) for r in rows)
    manifest = tokenstore.write(df)
    good = key(tokenstore.read(manifest, df).collect())
    for m in manifest.collect():  # the first rows of two keys change places in the file's index
        raw = bytearray(open(m.file.removeprefix("file:"), "rb").read())
        n = int.from_bytes(raw[-16:-8], "little")
        at = len(raw) - 16 - n
        head_n = int.from_bytes(raw[at : at + 4], "little")
        head = tokenstore.json.loads(raw[at + 4 : at + 4 + head_n])
        at += 4 + head_n
        for name, kind, count in head["arrays"]:
            if name == "rows":
                rows = np.frombuffer(bytes(raw[at : at + 8 * count]), kind).copy()
                if count < 2:
                    break
                rows[[0, 1]] = rows[[1, 0]]
                raw[at : at + 8 * count] = rows.tobytes()
            at += np.dtype(kind).itemsize * count
        open(m.file.removeprefix("file:"), "wb").write(raw)
    assert key(tokenstore.read(manifest, df).collect()) != good


@pytest.mark.parametrize("block, cache", [(1, 2), (1 << 16, 10**6)])
def test_blocks_of_files_and_small_caches_change_nothing(spark, monkeypatch, block, cache):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    manifest = tokenstore.write(docs, most_ids=20000)
    monkeypatch.setattr(tokenstore, "BLOCK", block)
    monkeypatch.setattr(tokenstore, "CHUNK", 100 if block == 1 else 1 << 21)
    got = {r.id: (r.n_tokens, r.ids_crc32) for r in tokenstore.read(manifest.limit(3), docs).collect()}
    enc = tokenstore.Encoder(tokenstore.default_path(), 2)
    monkeypatch.setattr(tokenstore, "CACHE", cache)
    for r in docs.filter(F.col("doc_id").isin(list(got))).collect():
        x = np.frombuffer(enc.encode([r.text])[0], enc.type).astype("<u4")
        assert got[r.doc_id] == (len(x), zlib.crc32(x.tobytes()))


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 20000))
    slots = tokenstore.PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


@pytest.fixture(scope="module")
def unigram():
    vocab = viterbi.vocabulary()
    tok = Tokenizer(models.Unigram(vocab, 0, True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return tok, viterbi.Counter(vocab)


@pytest.mark.parametrize("text", [t for t in TEXTS if t and len(t) < 1000] + ["The quick brown fox jumps", "▁▁ a▁b", "aaaaaaaaaaaaaaaa bbb", "Straße ciónmente"])
def test_counts_are_the_library(unigram, text):
    tok, counter = unigram
    assert counter.count(text) == len(tok.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdetn ▁\né漢😀.,"), max_size=30))
def test_counts_are_the_library_on_odd_texts(unigram, text):
    tok, counter = unigram
    assert counter.count(text) == len(tok.encode(text, add_special_tokens=False).ids)


def test_count_rows(spark, unigram):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.id: r.n_tokens for r in viterbi.token_counts(df).collect()}
    tok, _ = unigram
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) if t else 0 for i, t in enumerate(TEXTS)}
