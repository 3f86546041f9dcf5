"""The registered queries opN_<name>: thin digests of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, egojoin, langid, mixing, quality, shard, simhash, tokenstore, toxicity, viterbi
from .common import held_out, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    got = shard.interleave(docs, 8, carry=[size, crc], text_col="text")
    return got.select(F.col("_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_hash_threshold_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"))
    return got.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.predict(docs, langid.fit(docs))
    return got.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "accepted", "entropy")


def op6_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    got = toxicity.predict(docs, toxicity.fit(docs, labels))
    return got.withColumnRenamed("id", "doc_id").withColumn("held_out", held_out(F.col("doc_id")))


def op4_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.withColumnRenamed("id", "doc_id")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokenstore.read(tokenstore.write(docs), docs).withColumnRenamed("id", "doc_id")


def op9_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_stratified_shards": op2_stratified_shards,
    "op3_language_id": op3_language_id,
    "op4_pigeonhole_decontamination": op4_pigeonhole_decontamination,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_quality_ranking": op6_quality_ranking,
    "op8_token_store": op8_token_store,
    "op9_viterbi_token_counts": op9_viterbi_token_counts,
    "op10_toxicity_chain": op10_toxicity_chain,
    "op7_hash_threshold_mixing": op7_hash_threshold_mixing,
}

ORACLES: dict[str, str] = {
    "op2_stratified_shards": shard.SQL.format(shards=8, seed="interleave"),
    "op5_embedding_near_dedup": egojoin.SQL,
    "op7_hash_threshold_mixing": mixing.SQL.replace("{seed}", "mix"),
}
