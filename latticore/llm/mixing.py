"""Mixing sources to target weights by hash-threshold histograms.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all
words; none gets more than 2 times its own, the excess goes to the others by weight.  That is
target = min(2 * size, level * weight) with one level for all.

Within a source each document is taken floor(target / size) times, and once more if its hash lies
below the source's threshold.  Thresholds come from histograms: words summed by source and the
first 12 bits of the hash give the bucket where the budget ends; only that bucket's rows are summed
again by the next 12 bits, and so on (nested four times, 48 bits).  Then a filter on the hash
selects, and no document is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, save

WEIGHTS = (3, 1, 2)
LEVELS, BITS = 4, 12
#: Sources whose thresholds may be broadcast; more are joined by key.
SMALL = 20_000


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """sizes(s, source_size), one row a source -> with target double."""
    n = len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(Window.orderBy("s")) - 1) % n + 1).cast("int"))
    w = sizes.withColumn("w", weight)
    # sources reach their cap in the order of cap / weight; the level is set by those that don't
    order = Window.orderBy(F.col("source_size") / F.col("w"), "s")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = (
        w.withColumn("capped", F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * most)
        .withColumn("open_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") * F.lit(float(share)) - F.col("capped")) / F.col("open_w"))
        .withColumn("fits", F.col("level") * F.col("w") <= F.col("source_size") * most)
        .withColumn("at", F.row_number().over(order))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct("at", "level"))).over(every)["level"])  # the first that fits
    )
    return w.select("s", "source_size", F.coalesce(F.least(F.col("level") * F.col("w"), (F.col("source_size") * most).cast("double")), (F.col("source_size") * most).cast("double")).alias("target"))


def _keyed(id_col: str, text_col: str, source_col: str, seed: str) -> list:
    """Source key s (null last) and hash h of a row: both follow from its own columns, the text
    among them, so that rows without an id, or that share one, are told apart."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    return [
        F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("a"), F.col(source_col).cast("string"))).alias("s"),
        F.conv(F.substring(h, 1, LEVELS * BITS // 4), 16, 10).cast("long").alias("h"),
    ]


def _size(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")


def thresholds(base: DataFrame) -> DataFrame:
    """base(s, h, size) -> one row a source: s, source_size, target, whole, limit.

    A row is taken `whole` times, and once more if h < limit."""
    sources = targets(base.groupBy("s").agg(F.sum("size").alias("source_size")))
    sources = save(
        sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")),
        "targets",
    )
    # (s, prefix): the bucket in which the budget ends, narrowed level by level; left: what is still to take in it
    edge = sources.select("s", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    for level in range(LEVELS):
        down = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("h", down)
        inside = base.select("s", "size", bucket.alias("bucket"), F.shiftright(bucket, BITS).alias("prefix"))
        sums = inside.join(edge, ["s", "prefix"]).groupBy("s", "bucket", "left").agg(F.sum("size").alias("words"))
        upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("s").orderBy("bucket")))
        ends = upto.groupBy("s").agg(
            F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", (F.col("left") - F.col("upto") + F.col("words")).alias("left")))).alias("e")
        )
        edge = save(ends.filter("e is not null").select("s", F.col("e.bucket").alias("prefix"), F.col("e.left").alias("left")), "edge")
    # at the last level the bucket is one hash: in or out, whichever is nearer to the target
    at = base.select("s", "size", F.col("h").alias("prefix")).join(edge, ["s", "prefix"]).groupBy("s", "prefix", "left").agg(F.sum("size").alias("words"))
    limit = at.select("s", (F.col("prefix") + (F.col("left") * 2 >= F.col("words")).cast("long")).alias("limit"))
    return sources.join(limit, "s", "left").select("s", "source_size", "target", "whole", F.coalesce("limit", F.when(F.col("budget") > 0, F.lit(1 << 62)).otherwise(0)).alias("limit"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """_id, size, source_size, target, copies and taken for every row of docs.

    size is the number of words (0 for null and blank texts); copies is how often the row is taken
    and taken = copies * size, so no row exceeds twice its size and a rerun chooses the same rows.
    Rows of a source with no words have target 0 and are taken once: they cost nothing and nothing
    speaks against them.  Rows alike in id, source and text are taken alike.  Other columns do not matter."""
    base = save(docs.select(F.col(id_col).alias("_id"), _size(text_col), *_keyed(id_col, text_col, source_col, seed)), "sizes")
    return _apply(base, thresholds(base)).select("_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _apply(keyed: DataFrame, limits: DataFrame) -> DataFrame:
    limits = save(limits, "limits")
    if limits.count() <= SMALL:  # a row a source: then no row of docs moves, however hot its source
        limits = F.broadcast(limits)
    return keyed.join(limits, "s").withColumn("copies", (F.col("whole") + (F.col("h") < F.col("limit")).cast("long")).cast("long"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mixture itself: each row of docs as often as mix() takes it, with the columns of docs.

    The thresholds are a row a source, so whole texts are filtered where they are read."""
    keys = _keyed(id_col, text_col, source_col, seed)
    limits = thresholds(save(docs.select(_size(text_col), *keys), "sizes"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    taken = _apply(docs.select(row, *keys), limits.select("s", "whole", "limit")).filter("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


#: DuckDB's form: the same targets, and the same documents by running sums in hash order.
SQL = r"""
WITH base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS s,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 12) AS h
  FROM documents),
sized AS (SELECT s, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY s),
weighed AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY s) - 1) % 3 + 1] AS BIGINT) AS w FROM sized),
open AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, s) AS rn, coalesce(sum(source_size) OVER o, 0) * 2 AS capped, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open_w, sum(source_size) OVER () AS total
  FROM weighed WINDOW o AS (ORDER BY source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (CAST(total AS DOUBLE) * 1.5 - CAST(capped AS DOUBLE)) / CAST(open_w AS DOUBLE) AS l FROM open),
level AS (SELECT *, first_value(l) OVER (ORDER BY CASE WHEN l * w <= source_size * 2 THEN 0 ELSE 1 END, rn) AS lv FROM levels),
goal AS (SELECT s, source_size, CAST(coalesce(least(lv * w, CAST(source_size * 2 AS DOUBLE)), source_size * 2) AS DOUBLE) AS target FROM level),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 1 END AS whole,
         target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END) * source_size AS budget FROM goal),
hashes AS (SELECT s, h, sum(size) AS words FROM base GROUP BY s, h),
running AS (SELECT *, sum(words) OVER (PARTITION BY s ORDER BY h) AS upto FROM hashes),
picked AS (
  SELECT r.s, r.h, p.budget > 0 AND (upto <= budget OR (upto - words <= budget AND 2 * (budget - (upto - words)) >= words)) AS more
  FROM running r JOIN plan p USING (s))
SELECT b.doc_id, b.size, p.source_size, p.target, CAST((p.whole + CASE WHEN k.more THEN 1 ELSE 0 END) * b.size AS BIGINT) AS taken
FROM base b JOIN plan p USING (s) JOIN picked k ON k.s = b.s AND k.h = b.h
"""
