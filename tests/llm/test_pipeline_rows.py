"""Stages of the pipeline decide by row: null and shared doc_ids."""

import importlib
import random

import pytest

pipeline = importlib.import_module("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=80):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(n))


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, prose(100, 30))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)


def test_near_dedup_of_null_and_shared_ids(spark, sf):
    rows = [(None, prose(1)), (None, prose(1)), (5, prose(2)), (5, prose(3)), (4, prose(3)), (6, prose(1)), (None, prose(4)), (8, prose(5)), (8, prose(5))]
    want = [(6, prose(1)), (5, prose(2)), (4, prose(3)), (None, prose(4)), (8, prose(5))]
    assert left(pipeline.drop_near_duplicates(spark, docs(spark, rows), sf)) == sorted(want, key=str)


def test_decontamination_of_null_and_shared_ids(spark, sf):
    held = prose(6) + " " + prose(100, 30) + " " + prose(7)
    rows = [(None, held), (None, prose(8)), (3, held), (3, prose(9)), (4, prose(10))]
    want = [(None, prose(8)), (3, prose(9)), (4, prose(10))]
    assert left(pipeline.drop_contaminated(spark, docs(spark, rows), sf)) == sorted(want, key=str)
