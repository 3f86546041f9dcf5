"""The corpus pipeline: five stages over documents, each written as Parquet and reread.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticore.llm import decontam, jaccard, mixing, quality, shard, simhash
from latticore.llm.common import drop, join_heavy, new_path, release, save, table
from latticore.llm.graph import linked

ACCEPT = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.7; the ranking is learned from this stage's input."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), accept=ACCEPT)
    scored = quality.score(docs, model, out="\x00score")
    return scored.filter(F.col("\x00score") >= ACCEPT).select(*[F.col(f"`{c}`") for c in docs.columns])


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key for each row, and that column's name: doc_id may be null or shared.

    Rows of plain Parquet files have the file's number and their place in it, so nothing is copied; others are written once."""
    spark = docs.sparkSession
    release(spark)  # shuffles of the stage before
    name = "_row"
    while name in docs.columns:
        name += "_"
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName().startswith("LogicalRelation") and "_metadata" not in docs.columns:
        files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())  # a row a file
        if len(files) < 1 << 22:
            number = spark.createDataFrame(list(enumerate(files)), "n long, file string")
            own = docs.withColumns({"\x00at": F.col("_metadata.row_index"), "\x00file": F.col("_metadata.file_path")})
            key = (F.shiftleft("\x00n", 40) + F.col("\x00at")).alias(name)
            names = number.select(F.col("n").alias("\x00n"), F.col("file").alias("\x00file"))
            return own.join(F.broadcast(names), "\x00file").select(*[F.col(f"`{c}`") for c in docs.columns], key), name
    return save(docs.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: the one with the least doc_id, a null one last.

    Two rows are linked if their SimHash fingerprints lie within 4 bits (op1's operator), and also if their texts
    have a Jaccard similarity of 5-word shingles of 0.8 or more, as fingerprints of such pairs may lie further apart.
    Rows are told apart by a key of their own, so a shared or null doc_id neither saves nor drops any."""
    rows, row = keyed(docs)
    near = save(simhash.near_duplicates(rows, id_col=row).select("id", F.col("component_id").alias("near")), "near")
    release(spark)
    exact = save(jaccard.near_duplicates(rows, id_col=row).select("id", F.col("component_id").alias("node")), "exact")
    release(spark)
    least = exact.groupBy("node").agg(F.min("id").alias("exact"), F.count("*").alias("n"))
    both = join_heavy(exact, least, "node", "n", exact.count()).join(near, "id").select(F.col("near").alias("u"), F.col("exact").alias("v"))
    comp = linked(both)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(row).alias("r"))).alias("first")
    per = rows.select(row, "doc_id").join(near.withColumnRenamed("id", row), row).groupBy("near").agg(first)
    per = per.join(comp.withColumnRenamed("node", "near"), "near", "left").groupBy(F.coalesce("component", "near").alias("c"))
    kept = save(per.agg(F.min("first")["r"].alias(row)), "kept")
    drop(near, exact, comp)
    release(spark)
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item within the error budget, whatever their doc_id."""
    rows, row = keyed(docs)
    hit = decontam.matches(rows, table(spark, sf_dir, "benchmark"), id_col=row).select(F.col("id").alias(row)).distinct()
    return rows.join(hit, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it; those taken 0 times go, those taken twice stand twice."""
    release(spark)
    return mixing.sample(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard (0 to 7) and slot, which replace columns of these names; the mixture of sources is that of each shard."""
    release(spark)
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    carry = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]
    got = shard.interleave(docs, 8, carry=carry, text_col="text")
    return got.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "shard", "slot")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Learned scores and edit distances have no SQL form that ends on whole tables; tests/llm hold a brute-force version.
ORACLE_SQL = None
