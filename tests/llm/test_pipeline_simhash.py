"""The pipeline's near-dedup goes by SimHash, and keys rows of files without a copy."""

import importlib
import random

from latticore.llm import simhash

pipeline = importlib.import_module("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(n))


def test_fingerprints_link_what_sets_of_shingles_do_not(spark):
    texts = [f"{prose(1, 13)} " * 60 + prose(k, 12) for k in (2, 3)] + [prose(4, 60)]
    a, b = (simhash.fingerprint(t.encode()) for t in texts[:2])
    assert (a ^ b).bit_count() <= 4
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 2]


def test_rows_of_files_are_keyed_where_they_are(spark, tmp_path):
    docs = spark.range(1000).selectExpr("cast(null as long) doc_id", "'t' text", "'en' lang", "'a' source", "id n_chars")
    docs.repartition(7).write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    rows, name = pipeline.keyed(read)
    assert set(rows.inputFiles()) == set(read.inputFiles())
    first, again = (sorted(map(tuple, rows.select("n_chars", name).collect())) for _ in range(2))
    assert first == again and len({k for _, k in first}) == 1000
    few, name = pipeline.keyed(read.filter("n_chars < 10").union(read.filter("n_chars < 10")))
    assert few.select(name).distinct().count() == 20
