"""The operators that SQL expresses, against DuckDB over the whole tables of sf0.001."""

import duckdb
import pytest

from latticore.llm import queries

SF = "/root/testdata/sf0.001"


def cell(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_the_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(tuple(map(cell, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(cell, r)) for r in want)
