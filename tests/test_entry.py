"""The driver's entry point and a sample of its checks against DuckDB."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SAMPLE = ["agg_count_win", "agg_top_k_win_where", "agg_ewvar", "agg_reservoir_sample", "agg_distance_from_home", "row_with_columns", "expr_divide_int", "expr_quadkey", "table_cold_after", "table_dedupe", "table_composite_key", "pack_medium"]


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    a = sorted((tuple(plain(r[c]) for c in want.columns) for r in df.collect()), key=str)
    b = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)
    assert len(a) == len(b)
    assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(f"agg_{x}" in entry.queries() for x in ("count", "ewma", "geo_spread", "reservoir_sample"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
