"""Sharding by proportional stratified interleaving, with DataFrame operations only.

Rows get a seeded shuffle key (md5 of seed, id and, where it is named, the text).  Their rank r in this order within their
source (n rows) gives the fractional rank (2r - 1) / 2n; ordering all rows by it interleaves the
sources in proportion, and cutting that order into equal runs gives shards that hold the mixture
and row counts at most one apart.

Neither ranking sorts a source or the table in one task.  Ranks within a source are counted within
4096 buckets of the shuffle key, plus the counts of the buckets before (a prefix sum over
pre-aggregated counts).  Positions are counted within 4096 intervals of the fractional rank, and
the rows before an interval follow from the sources' sizes alone by integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def interleave(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", source_col: str = "source", seed: str = "interleave", carry: list | None = None, text_col: str | None = None) -> DataFrame:
    """carry columns plus _id, _source, shard (int) and slot (long, gapless from 0 in each shard).

    carry is a list of aliased columns taken along (default: none).  A null source is a source of
    its own.  With text_col, rows without an id, or that share one, have shuffle keys of their own;
    without it they share one.  Rows that tie in key and id are ordered by the carried columns; what
    ties in these too is alike.  An empty table gives no rows."""
    carry = carry or []
    names = [docs.select(c).columns[0] for c in carry]
    ties = [n for n, kind in docs.select(*carry).dtypes if "map<" not in kind and kind != "variant"] if carry else []
    told = [F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))] if text_col else []
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), *told))
    base = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string"))).alias("_s"),
        h.alias("_h"),
        *carry,
    ).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = base.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    source = Window.partitionBy("_s")
    before = counts.select(
        "_s", "_b",
        (F.sum("_n").over(source.orderBy("_b")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(source).alias("_of"),
    )
    ranked = base.join(before, ["_s", "_b"]).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "_id", *ties)))
    ranked = ranked.withColumn("_f", F.expr(f"((2 * _r - 1) * {BUCKETS}L) div (2 * _of)"))
    # rows of a source before interval j: those with (2r - 1) * BUCKETS <= 2 n j - 1
    sizes = base.groupBy("_s").agg(F.count("*").alias("_of"))
    offsets = (
        sizes.select("_of", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("_j"))
        .groupBy(F.col("_j").cast("long").alias("_f"))
        .agg(F.sum(F.expr(f"((2 * _of * _j - 1 + {BUCKETS}L) div {BUCKETS}L) div 2")).alias("_offset"), F.sum("_of").alias("_all"))
    )
    order = Window.partitionBy("_f").orderBy(((F.col("_r") * 2 - 1) / (F.col("_of") * 2)), "_s", "_r")
    placed = ranked.join(offsets, "_f").withColumn("_pos", F.col("_offset") + F.row_number().over(order) - 1)
    shard = F.expr(f"({shards}L * (_pos + 1) - 1) div _all")
    return placed.withColumn("shard", shard.cast("int")).select(
        "_id", "_source", *names, "shard", (F.col("_pos") - F.expr(f"(shard * _all) div {shards}L")).alias("slot")
    )


#: DuckDB's form of the same ranking; {shards} and {seed} are filled in.  CRC-32 is folded byte by byte, with its table from the polynomial.
SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS s,
         md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS h,
         CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size,
         [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS bytes
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id NULLS FIRST, size) AS r, count(*) OVER (PARTITION BY s) AS n FROM base),
placed AS (
  SELECT *, row_number() OVER (ORDER BY ((2 * r - 1) * 4096) // (2 * n), CAST(2 * r - 1 AS DOUBLE) / (2 * n), s, r) - 1 AS pos, count(*) OVER () AS total
  FROM ranked),
cut AS (SELECT *, ({shards} * (pos + 1) - 1) // total AS shard FROM placed)
SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(pos - (shard * total) // {shards} AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM cut, crc
"""
