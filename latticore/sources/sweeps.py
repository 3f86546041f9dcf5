"""Point sweeps: Parquet reader, and the projection of the star-schema tables to pseudo sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import row_fixed
from ..schema import CLASSES, DATASETS, FRAMES, POINTS, drive


def read_points(spark: SparkSession, path: str, seq: str | None = None) -> DataFrame:
    df = spark.read.schema(POINTS).parquet(path)
    return df if seq is None else df.where(F.col("seq") == seq)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def write_points(points: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Partitioned by sequence, so that a drive is pruned to its own files."""
    points.write.mode("overwrite").partitionBy("seq").option("maxRecordsPerFile", rows_per_file).parquet(path)


def append_missing(points: DataFrame, path: str) -> DataFrame:
    """Resumable cache writer: only sequences that the target lacks are computed and written; -> (seq, n) of what they now hold.

    Sequences are compared before any point is read further, and the rows counted are those written."""
    spark = points.sparkSession
    try:
        have = spark.read.parquet(path).select("seq").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = spark.createDataFrame([], "seq string")
    before = [r.seq for r in have.collect()]  # a row a drive
    new = points.filter(~F.col("seq").isin(before)) if before else points
    new.write.mode("append").partitionBy("seq").parquet(path)
    now = spark.read.schema(points.schema).parquet(path)
    return (now.filter(~F.col("seq").isin(before)) if before else now).groupBy("seq").agg(F.count("*").alias("n"))


def iterate(path: str, spark: SparkSession, by: tuple[str, ...] = ("seq", "frame")):
    """Frames of a cache one after the other, each a list of rows: one partition's rows stand on the driver at a time."""
    held, mark = [], None
    for r in spark.read.parquet(path).orderBy(*by, "pid").toLocalIterator(prefetchPartitions=False):
        key = tuple(r[c] for c in by)
        if held and key != mark:
            yield mark, held
            held = []
        mark = key
        held.append(r)
    if held:
        yield mark, held


def count_frames(spark: SparkSession, path: str) -> DataFrame:
    """(seq, n) frames of a cache, from the key columns alone."""
    return spark.read.parquet(path).groupBy("seq").agg(F.countDistinct("frame").alias("n"))


def write_index(spark: SparkSession, path: str, name: str, hz: float | None = None) -> None:
    """The cache's description, a JSON record beside it: rows, columns and classes of the dataset, and its sequences."""
    rows, cols, active, rate = DATASETS[name]
    seqs = count_frames(spark, path).agg(F.array_sort(F.collect_list(F.struct("seq", "n"))).alias("sequences"))
    info = seqs.select(F.lit(name).alias("name"), F.lit(rows).alias("n_rows"), F.lit(cols).alias("n_cols"), F.array(*[F.lit(c in active) for c in range(len(CLASSES))]).alias("active"), F.lit(float(hz or rate)).alias("hz"), "sequences")
    info.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The dataset's description as write_index() left it: one row."""
    kind = "name string, n_rows int, n_cols int, active array<boolean>, hz double, sequences array<struct<seq: string, n: long>>"
    return spark.read.schema(kind).json(f"{path.rstrip('/')}_index")


def first_frames(points: DataFrame, n: int) -> DataFrame:
    """The first n frames of each drive, by number."""
    on = drive(points)
    few = points.select(*on, "frame").distinct().withColumn("_k", F.row_number().over(Window.partitionBy(*on).orderBy("frame"))).filter(F.col("_k") <= n).drop("_k")
    return points.join(few, [*on, "frame"], "left_semi")


def pseudo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as sweeps: ego-frame x, y, z, predicted cls and moving, truth label and gt_moving.

    A quarter of the rows spreads over 4 m, a quarter over 10 m, the others over 100 m, so all tiers
    fill.  Ground lies within centimetres but for rare holes, other classes anywhere up to 3 m.  The
    ring is the row of the elevation.  Values are integers over a power of ten; pid is unique: a packed
    key, or a negative hash of its parts where that exceeds a long (order keys from 2^21 on; the SQL stops there)."""
    li = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    part, supp, order, line = (F.col(f"l_{c}") for c in ("partkey", "suppkey", "orderkey", "linenumber"))
    wide = F.when(part % 2 == 0, 100.0).when(part % 4 == 1, 2500.0).otherwise(1000.0)
    cls = ((part + F.when(supp % 5 == 0, 1).otherwise(0)) % 9).cast("int")
    rough = ((part * 37) % 400 - 100).cast("double")
    z = F.when(cls >= 4, rough / 100.0).when(part % 50 == 7, F.lit(-0.5)).otherwise(rough / 10000.0)
    cents = F.rint(F.col("l_extendedprice") * 100).cast("long")
    place = (order * 8 + line) * 32768 + part
    fits = order.between(-(1 << 22), 1 << 22) & place.between(-(1 << 39), (1 << 39) - 1)  # try_multiply would raise and catch an error in each of the other rows
    pid = F.when(fits, F.try_add(place * 16777216, cents))
    p = li.select(
        line.alias("frame"),
        F.coalesce(pid, -1 - F.shiftrightunsigned(F.xxhash64(order, line, part, cents), 2)).alias("pid"),
        (((order * 7919 + part * 13) % 20011 - 10005) / wide).alias("x"),
        (((order * 104729 + supp * 31) % 20011 - 10005) / wide).alias("y"),
        z.alias("z"),
        (F.col("l_quantity") / 50.0).alias("inten"),
        (part % 10 - 1).cast("int").alias("label"),
        cls.alias("cls"),
        ((cls >= 7) & (supp % 3 == 0)).alias("moving"),
        ((part % 10 >= 8) & (supp % 4 == 0)).alias("gt_moving"),
    )
    elev = F.degrees(F.atan2("z", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))))
    return p.withColumn("ring", row_fixed(elev, 30.0, -30.0))


def pseudo_frames(spark: SparkSession, n: int = 7) -> DataFrame:
    """Ego poses of the pseudo sweeps: a drive that turns and moves.  The rotation is rational, so engines agree to the last bit."""
    t = F.col("id") / 20.0
    f = spark.range(1, n + 1).select(F.col("id").cast("int").alias("frame"), (F.col("id") * 13 / 10.0).alias("ex"), (F.col("id") * 6 / 10.0).alias("ey"), ((1 - t * t) / (1 + t * t)).alias("c"), (2 * t / (1 + t * t)).alias("s"))
    zero, one = F.lit(0.0), F.lit(1.0)
    return f.select("frame", "ex", "ey", F.array("c", -F.col("s"), zero, "ex", "s", "c", zero, "ey", zero, zero, one, zero, zero, zero, zero, one).alias("pose"))


#: The same in DuckDB, as the opening of a WITH clause.
PSEUDO_SQL = """
WITH raw AS (
  SELECT *, CAST((l_partkey + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END) % 9 AS INTEGER) AS cls,
    CASE WHEN l_partkey % 2 = 0 THEN 1e2 WHEN l_partkey % 4 = 1 THEN 25e2 ELSE 1e3 END AS wide, CAST((l_partkey * 37) % 400 - 100 AS DOUBLE) AS rough
  FROM lineitem),
placed0 AS (
  SELECT l_linenumber AS frame, ((l_orderkey * 8 + l_linenumber) * 32768 + l_partkey) * 16777216 + CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS pid,
    ((l_orderkey * 7919 + l_partkey * 13) % 20011 - 10005) / wide AS x, ((l_orderkey * 104729 + l_suppkey * 31) % 20011 - 10005) / wide AS y,
    CASE WHEN cls >= 4 THEN rough / 1e2 WHEN l_partkey % 50 = 7 THEN -5e-1 ELSE rough / 1e4 END AS z, l_quantity / 5e1 AS inten,
    CAST(l_partkey % 10 - 1 AS INTEGER) AS label, cls, cls >= 7 AND l_suppkey % 3 = 0 AS moving, l_partkey % 10 >= 8 AND l_suppkey % 4 = 0 AS gt_moving
  FROM raw),
pts AS (SELECT *, CAST(least(greatest(floor((3e1 - degrees(atan2(z, sqrt(x * x + y * y)))) / 6e1 * 64), 0), 63) AS INTEGER) AS ring FROM placed0),
frames AS (SELECT *, (1 - t * t) / (1 + t * t) AS c, 2 * t / (1 + t * t) AS s FROM (SELECT CAST(i AS INTEGER) AS frame, i * 13 / 1e1 AS ex, i * 6 / 1e1 AS ey, i / 2e1 AS t FROM range(1, 8) t(i))),
wp AS (SELECT p.*, f.c * p.x + (-f.s) * p.y + 0e0 * p.z + f.ex AS wx, f.s * p.x + f.c * p.y + 0e0 * p.z + f.ey AS wy, 0e0 * p.x + 0e0 * p.y + 1e0 * p.z + 0e0 AS wz, f.ex, f.ey FROM pts p JOIN frames f USING (frame))
"""
