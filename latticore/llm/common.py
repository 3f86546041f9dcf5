"""Shared helpers: table access, the shared work folder, written intermediate tables, joins on hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII white space of the contracts.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is heavy if it holds more than this share of all rows, so at most HEAVY keys are.
HEAVY = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, else the context's checkpoint folder.

    Where neither is set, a local master (tests) gets a temporary folder; any other raises, as no
    folder of this machine reaches the executors."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="latticore-")
        found = _OWN[app]
    return found.rstrip("/")


_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/latticore-{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append((spark, path))
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and reread it: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._latticore_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables of save() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_latticore_path", None):
            remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles of plans that are done: it acts when the driver collects its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # the session is gone already
            return


def slices(batches: Iterable, rows: int = 500) -> Iterator:
    """Arrow batches in pieces of at most `rows` rows: bounds what Python objects stand at once.

    Spark bounds the bytes of a batch itself (64 MB by default), so no setting of the session is changed."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def join_heavy(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined (inner) with per_key, which has one row a key and in `n` how many of rows' `total` hold it.

    Heavy keys (over total / 1000 rows, so under 1000 of them) are joined by broadcast, so their rows
    stay where they are; of the others no key can fill a task.  rows should be a written table: it is read twice."""
    most = max(total // HEAVY, 10_000)
    if total <= most:  # then no key can be heavy
        return rows.join(per_key.drop(n), key)
    heavy = F.broadcast(per_key.filter(F.col(n) > most).drop(n))
    light = rows.join(heavy.select(key), key, "left_anti").join(per_key.filter(F.col(n) <= most).drop(n), key)
    return rows.join(heavy, key).unionByName(light)


#: Bits of the table of keys that marks() broadcasts: one size for any input.
MARKS = 1 << 25


def marks(df: DataFrame, col: str):
    """Broadcast bit table (4 MB) of the low bits of a column of uniform 64-bit hashes.

    What it does not hold is surely not in df; what it holds may be.  The more it fills, the less it
    spares, and nothing else changes."""
    import numpy as np

    slot = F.col(col).bitwiseAND(MARKS - 1) + 1
    chunks = df.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).collect()
    out = np.zeros((MARKS >> 15, 1 << 12), np.uint8)
    for r in chunks:
        out[r.b - 1] = np.frombuffer(r.m, np.uint8)
    return df.sparkSession.sparkContext.broadcast(out.ravel())


def marked(table, hashes):
    """Which of the hashes (a NumPy array of 64-bit integers) the bit table holds."""
    import numpy as np

    at = hashes.astype(np.int64) & (MARKS - 1)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def across(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Pairs (x, y) of structs of all columns but key of rows that share the key and differ in label, x's label the lesser.

    Label pairs meet first, by key, then their rows: rows of one label never meet, so the work is that
    of the pairs given, whatever the size of a label's group.  rows should be few beside the corpus
    (those whose key marks() has found to hold several labels): they are written once more."""
    several = rows.groupBy(key).agg(F.min(label).alias("_p"), F.max(label).alias("_q")).filter("_p < _q").select(key)
    rows = save(rows.join(several, key), "across")
    release(rows.sparkSession)
    kinds = rows.select(key, label).distinct()
    p, q = kinds.withColumnRenamed(label, "_p"), kinds.withColumnRenamed(label, "_q")
    meet = p.join(q, key).filter("_p < _q")
    cols = F.struct(*[c for c in rows.columns if c != key])
    x = rows.select(key, F.col(label).alias("_p"), cols.alias("x"))
    y = rows.select(key, F.col(label).alias("_q"), cols.alias("y"))
    return meet.join(x, [key, "_p"]).join(y, [key, "_q"]).select(key, "x", "y")


def held_out(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 4, is 2; a null doc_id counts as learnable."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
