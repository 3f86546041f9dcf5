"""The learned operators against plain versions: Kneser-Ney by hand, the pairwise optimum, a chain on a tiny table."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticore.llm import langid, quality, queries, toxicity

TEXTS = ["abab ab!", "Aba 12 bab", "baab", "a", "", None, "\u6f22\u5b57 \u6f22", "zZ \U0001f600 y"]


def chars(text):
    out = [0]
    for c in text or "":
        x = ord(c.lower()[0]) if c.isalpha() else 0
        if x or out[-1]:
            out.append(x)
    out = out if out[-1] == 0 and len(out) > 1 else [*out, 0]
    if not any(out):
        return []
    return out + [0] * (4 - len(out))


def by_hand(counts):
    """p(gram) of interpolated Kneser-Ney from counts of 4-grams (tuples)."""
    levels = [counts]
    while len(next(iter(levels[-1]))) > 1:
        levels.append(Counter(g[1:] for g in levels[-1]))
    tables = []
    for level in levels[::-1]:
        once, twice = (sum(n == k for n in level.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        total, kinds = Counter(), Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        tables.append((level, d, total, kinds))

    def p(gram):
        out = 2.0**-21
        for k, (level, d, total, kinds) in enumerate(tables, 1):
            g = gram[-k:]
            if total[g[:-1]]:
                out = max(level.get(g, 0) - d, 0) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * out
        return out

    return p


def grams(text):
    c = chars(text)
    return [tuple(c[i : i + 4]) for i in range(len(c) - 3)]


def test_kneser_ney_by_hand(spark):
    counts = Counter(g for t in TEXTS for g in grams(t))
    rows = spark.createDataFrame([(t, "xx") for t in TEXTS], "text string, lang string").repartition(3)
    got = langid.gram_counts(rows).toPandas()
    unpack = lambda a, b: (a, b >> 42, b >> 21 & (1 << 21) - 1, b & (1 << 21) - 1)
    assert {unpack(a, b): n for a, b, n in zip(got["a"], got["b"], got["n"])} == counts
    model = langid.KneserNey.build(*(got[c].to_numpy() for c in "abn"))
    p = by_hand(counts)
    for t in [*TEXTS, "abba", "bzb", "new words", "\u6f22"]:
        a, b = langid.grams(t)
        assert np.exp(model.log_prob(a, b)).tolist() == pytest.approx([p(g) for g in grams(t)])
        if len(a):
            assert [unpack(x, y) for x, y in zip(a.tolist(), b.tolist())] == grams(t)


def test_scripts_that_a_small_alphabet_would_mix(spark):
    """Languages that differ in a letter of one script, and all texts rejected that are none of them."""
    rng = np.random.default_rng(0)
    word = lambda letters: "".join(rng.choice(list(letters), 5))
    kinds = {"be": "\u0430\u0431\u045e\u0456\u044d", "ru": "\u0430\u0431\u0432\u0438\u044d", "zh": "\u4e00\u4e8c\u4e09\u56db\u4e94"}
    rows = [(i, " ".join(word(kinds[k]) for _ in range(12)), k) for i in range(300) for k in [sorted(kinds)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r.id: r for r in langid.predict(docs, model).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows) >= 298 and sum(got[i].accepted for i, *_ in rows) >= 295
    other = langid.predict(spark.createDataFrame([(1, "completely other letters"), (2, None), (3, "12 !")], "doc_id long, text string"), model).collect()
    assert [r.accepted for r in other] == [False] * 3 and [r.lang_pred for r in other[1:]] == ["und"] * 2


def test_held_out_rows_are_never_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from latticore.llm.common import held_out

    wrong = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert "xx" not in langid.fit(wrong).langs


def test_weights_are_the_pairwise_optimum():
    rng = np.random.default_rng(1)
    diff, won = rng.normal(size=(300, 4)), (rng.random(300) < 0.7).astype(float)
    loss = lambda w: sum(math.log1p(math.exp(-z if y else z)) for z, y in zip(diff @ w, won)) + w @ w
    w = quality.preferences(diff, won)
    best = loss(w)
    for k in range(4):
        for step in (-1e-3, 1e-3):
            assert loss(w + step * np.eye(4)[k]) > best


def test_the_threshold_is_a_quantile(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id")
    rejected = got.filter("score < 0.7").count() / got.count()
    assert abs(rejected - got.filter("quality = 0").count() / got.count()) < 0.05


def test_a_chain_on_a_tiny_table(spark):
    rows, marks = [], []
    for i in range(200):
        low, bad = i % 5 == 0, i % 4 == 0
        rows.append((i, f"common words of text n{i % 7} " + ("mess clutter " if low else "") + ("awful nasty" if bad else "fine")))
        marks.append((i, 0 if low else 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels)
    assert [x.name for x in chain.links] == ["low_quality", "toxic"] and [len(x.weights) for x in chain.links] == [4, 5]
    got = {r.id: r for r in toxicity.predict(docs, chain).collect()}
    for i, q, t in marks:
        assert got[i].predicted == t and (got[i].p_low_quality > 0.5) == (q == 0)


def test_toxic_words_are_found_in_held_out_documents(spark):
    """Of the held-out toxic documents some hold no word that tells them (labels of random documents): all others are found."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    told = F.expr("exists(array('idiot', 'moron', 'stupid', 'trash', 'loser', 'clown', 'scum', 'pathetic', 'worthless', 'disgusting'), w -> lower(text) rlike concat('\\\\b', w, '\\\\b'))")
    got = queries.op10_toxicity_chain(spark, sf).filter("held_out").join(labels, "doc_id").join(docs.withColumn("told", told).select("doc_id", "told"), "doc_id").toPandas()
    hit = got[(got["toxic"] == 1) & got["told"]]
    assert len(hit) > 50 and hit["predicted"].mean() >= 0.98
    assert got[got["toxic"] == 0]["predicted"].mean() <= 0.01
