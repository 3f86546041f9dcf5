import importlib

import duckdb
import pytest
from pyspark.sql import functions as F

from latticore.llm import decontam, langid, mixing, quality, queries, shard, toxicity, viterbi
from test_jaccard import brute

SF = "/root/testdata/sf0.001"
pipeline = importlib.import_module("corpus_pipeline")
ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "one two three", None, "b", 3), (3, "one two three", None, "b", 3), (None, "null id here", "de", "a", 4), (5, "word " * 60000, "en", "a", 9), (6, "\t\n ", "fr", "b", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def con(**tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toPandas())
    return c


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_shards_and_mixture_of_odd_rows(spark, odd):
    got = shard.interleave(odd, 8)
    assert got.count() == len(ODD)
    got = mixing.mix(odd)
    assert got.count() == len(ODD) and got.filter("taken > 2 * size or size is null").count() == 0
    for empty in (shard.interleave(odd.limit(0), 8), mixing.mix(odd.limit(0)), mixing.sample(odd.limit(0))):
        assert empty.count() == 0


def test_shards_hold_the_laws(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = shard.interleave(docs, 8).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == docs.count() and sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    hot = got[got["_source"] == got["_source"].mode()[0]].groupby("shard").size()
    assert hot.max() - hot.min() <= 2


def test_targets_by_resharing(spark):
    for sizes in ([100, 10, 1000, 5], [7], [0, 4, 4], [1000, 1, 1, 1, 1, 1, 900], [3, 3, 3, 3, 3, 3, 3]):
        names = [f"a{i:02}" for i in range(len(sizes))]
        got = {r.s: r.target for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "s string, source_size long")).collect()}
        w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        t, open_, left = [0.0] * len(sizes), set(range(len(sizes))), 1.5 * sum(sizes)
        while open_:
            level = left / sum(w[i] for i in open_)
            over = {i for i in open_ if level * w[i] > 2 * sizes[i]}
            for i in over or open_:
                t[i] = 2 * sizes[i] if over else level * w[i]
            left -= sum(t[i] for i in over)
            open_ = open_ - over if over else set()
        assert [got[n] for n in names] == pytest.approx(t)


def test_mixture_meets_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs).join(docs.select(F.col("doc_id").alias("_id"), "source"), "_id").toPandas()
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
        assert g["target"].iloc[0] <= 2 * g["source_size"].iloc[0] + 1e-6
    assert mixing.sample(docs).count() == got["copies"].sum()


@pytest.mark.parametrize("name", ["op3_language_id", "op6_quality_ranking", "op10_toxicity_chain"])
def test_classifiers_run_on_odd_rows(spark, tmp_path, odd, name):
    labels = spark.createDataFrame([(5, 1, 0), (3, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for k, docs in enumerate((odd, odd.limit(0))):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{k}/labels.parquet")
        assert queries.QUERIES[name](spark, f"{tmp_path}/{k}").count() == docs.count()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op3_language_id(spark, sf).filter("held_out").join(docs, "doc_id")
    assert got.filter("lang = lang_pred").count() > 0.97 * got.count()
    got = queries.op6_quality_ranking(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert got.filter("predicted = quality").count() > 0.95 * got.count()


def test_pipeline_against_brute_force(spark):
    """Scores are the model's; all other stages again, plainly: Jaccard of all pairs, Myers of all items, the mixture by SQL."""
    got = pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = sorted(pipeline.keep_quality(spark, docs, SF).collect(), key=lambda r: r.doc_id)
    label = brute([r.text for r in good])
    single = [r for k, r in enumerate(good) if label[k] == k]
    items = [decontam.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = lambda t, b: decontam.myers(b, t, int(0.1 * len(b)))[0] <= int(0.1 * len(b))
    clean = [r for r in single if not any(held(decontam.plain(r.text), b) for b in items)]
    assert len(clean) < len(single) < len(good) < docs.count()
    c = con(documents=spark.createDataFrame(clean, docs.schema))
    want = {i: n for i, n in c.sql(f"SELECT doc_id, taken // size FROM ({mixing.SQL.replace('{seed}', 'mix')}) WHERE taken > 0").fetchall()}
    have = got.toPandas()
    assert have.groupby("doc_id").size().to_dict() == want
    assert got.columns == [*docs.columns, "shard", "slot"]
    sizes = have.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    for _, g in have.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    for _, g in have.groupby("source"):
        per = g.groupby("shard").size().reindex(range(8), fill_value=0)
        assert per.max() - per.min() <= 2


def test_pipeline_stages_on_odd_rows(spark, odd):
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd, SF).columns[:5] == odd.columns
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_stages_on_clashing_columns(spark, odd):
    more = odd.withColumns({c: F.lit(7) for c in ("shard", "slot", "score", "toxic", "_id", "s", "h", "id", "node", "row", "component_id", "a.b")})
    for name, stage in pipeline.STAGES:
        got = stage(spark, more, SF)
        assert set(got.columns) == set(more.columns), name
        assert got.filter("toxic <> 7 or `a.b` <> 7 or h <> 7").count() == 0
    dealt = pipeline.deal_shards(spark, more, SF)
    assert dealt.count() == len(ODD) and {r.shard for r in dealt.collect()} <= set(range(8))


def test_operators_on_clashing_columns_and_repeated_rows(spark, odd):
    more = odd.withColumns({c: F.lit(7) for c in ("score", "toxic", "predicted", "id", "n_tokens", "t", "_text", "fp", "lang_pred")})
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (3, 0, 1), (3, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(more, labels)
    assert toxicity.predict(more, chain).columns == ["id", "p_low_quality", "p_toxic", "score", "predicted"]
    got = quality.score(more, quality.fit(more, labels))
    assert got.count() == len(ODD) and got.filter("score is null").count() == 0 and got.filter("toxic = 7").count() == len(ODD)
    assert langid.predict(more, langid.fit(more)).count() == len(ODD)
    counts = [(r.id, r.n_tokens) for r in viterbi.token_counts(more).collect()]
    assert len(counts) == len(ODD) and len({n for i, n in counts if i == 3}) == 1


def test_labels_of_one_class_keep_the_schema(spark, odd):
    for labels in ([(5, 1, 0)], [(5, 0, 1)], [(5, None, None)]):
        chain = toxicity.fit(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        got = toxicity.predict(odd, chain)
        assert got.columns == ["id", "p_low_quality", "p_toxic", "score", "predicted"] and got.filter("predicted = 0").count() == len(ODD)


def test_mixture_of_null_and_shared_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for ids in (F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")), F.lit(1).cast("long")):
        got = mixing.mix(docs.withColumn("doc_id", ids).withColumn("_id", F.lit(0))).toPandas()
        for _, g in got.groupby(["target", "source_size"]):
            assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
        dealt = shard.interleave(docs.withColumn("doc_id", ids), 8, text_col="text").groupBy("shard").count().collect()
        assert max(r["count"] for r in dealt) - min(r["count"] for r in dealt) <= 1


@pytest.mark.parametrize("small", [0, 20_000])
def test_thresholds_by_broadcast_or_by_join(spark, monkeypatch, small):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(mixing, "SMALL", small)
    assert rows(mixing.mix(docs).select("_id", "copies")) == rows(mixing.mix(docs).select("_id", "copies"))
    assert mixing.mix(docs).agg(F.sum("taken")).first()[0] > 0
