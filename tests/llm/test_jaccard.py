"""Near-dedup of the pipeline against brute-force Jaccard of 5-word shingles."""

import importlib
import random

import pytest
from pyspark.sql import functions as F

from latticore.llm import jaccard

pipeline = importlib.import_module("corpus_pipeline")


def brute(texts):
    """Component (least position) of each text by links of Jaccard 0.8 or more."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [find(k) for k in range(len(sets))]


def groups(label):
    out = {}
    for k, v in enumerate(label):
        out.setdefault(v, set()).add(k)
    return {frozenset(g) for g in out.values()}


def texts_of_near_copies():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    line = " ".join(word() for _ in range(12))
    out = [None, "", " \t", "one", "One", "one two three four five", "one two three four six"]
    for n in (9, 20, 60, 300):
        for _ in range(6):
            base = [word() for _ in range(n)]
            out.append(" ".join(base))
            for _ in range(r.choice([1, 3, 6])):
                for at in r.sample(range(len(base)), r.randint(0, max(1, len(base) // 30))):
                    base[at : at + 1] = r.choice([[], [word()], [word(), word()]])
                out.append(" ".join(base) + f" {line}" * r.randint(0, 1))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("sf", [None, "sf0.01"])
def test_components_match_brute_force(spark, sf):
    if sf:
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
        texts = [r.text for r in docs.collect()]
    else:
        texts = texts_of_near_copies()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    got = {r.id: r.component_id for r in jaccard.near_duplicates(df, "id").collect()}
    assert groups([got[k] for k in range(len(texts))]) == groups(brute(texts))


def test_the_stage_drops_near_copies_beyond_four_bits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    label = brute([r.text for r in rows])
    want = {rows[k].doc_id for k in set(label)}
    got = [r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()]
    assert len(got) == len(want) and set(got) == want
    assert jaccard.near_duplicates(docs.filter(F.lit(False))).count() == 0
