"""The rolling mean's order of addition: 1000 / mean may lie on a half of its last digit."""

import duckdb
from pyspark.sql import functions as F

from latticore.operators import metrics
from latticore.plans import catalog

COLS = ["event_id", "p50", "p95", "p99", "mean", "fps"]


def test_halves_equal_the_sql(spark, tmp_path):
    """1000 / 20.48 = 48.828125; keys of many lengths, few of 64 and more rows, and a null key share DuckDB's hash groups."""
    ev = f"""SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i // 7) MINUTE AS ts, CASE WHEN u = 7 THEN NULL ELSE u END AS user_id, 'view' AS event_type,
        CASE WHEN i % 11 = 3 AND u % 3 = 0 THEN NULL WHEN u % 4 = 1 THEN 20.47 + (i % 3) / 100.0::DOUBLE ELSE 20.48 END::DOUBLE AS value
        FROM (SELECT i, CAST(floor(60 * sqrt((i * 7919 % 6007) / 6007.0)) AS BIGINT) AS u FROM range(12000) t(i))"""
    duckdb.sql(f"COPY ({ev}) TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLS)} FROM ({catalog.ORACLES['rolling_latency']})").fetchall())
    got = sorted(tuple(r) for r in catalog.QUERIES["rolling_latency"](spark, str(tmp_path)).select(*COLS).collect())
    assert len(got) == len(want) and [a for a, b in zip(got, want) if a != b] == []


def test_sums_of_any_width_and_place(spark):
    """Integers add exactly, so every width and place of the first run must give the plain mean."""
    df = spark.range(150).select(F.lit(1).alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 13 != 5, F.col("id") * 37 % 101).alias("v"))
    values = [i * 37 % 101 if i % 13 != 5 else None for i in range(150)][2:]
    for width, at in ((1, 0), (5, 3), (16, 0), (17, 15), (32, 9), (33, 0), (64, 1), (200, 11)):
        rows = metrics.rolling(df.withColumn("at", F.lit(at)), ("k",), ("o",), "v", width, 2, "at").orderBy("o").collect()
        frames = [[v for v in values[max(0, i + 1 - width) : i + 1] if v is not None] for i in range(len(values))]
        assert [r["mean"] for r in rows] == [sum(f) / len(f) if f else None for f in frames]
