"""Registered reference queries against their DuckDB SQL at the smallest scale."""

import duckdb
import pytest

from turnmill.plans.registry import ORACLES, QUERIES

TABLES = ("conversations", "documents", "embeddings", "benchmark", "pages", "labels")


def plain(rows):
    def one(v):
        return "null" if v is None else f"{float(v):.5f}" if isinstance(v, float) or (isinstance(v, int) and not isinstance(v, bool)) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)
