"""Registered queries against their SQL, on empty tables and with clashing columns."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = [q for q in QUERIES if q.startswith(("p1_", "p3_", "p4_"))]


def plain(v):
    if v is None or pd.isna(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return round(float(v), 7) + 0.0
    return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(map(plain, r)) for r in frame[names].itertuples(index=False)), key=str)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p4_totals", "bars_ohlcv", "htf_asof", "feature_ret", "trigger_events", "exit_outcomes", "greedy_trades", "holm", "null_sign_flip", "stream_closed_windows"])
def test_matches_sql(spark, data, name):
    from pathlib import Path

    db = duckdb.connect()
    db.execute("set TimeZone = 'UTC'")
    for path in Path(data).iterdir():
        db.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(db.execute(SQL[name]).df())


@pytest.mark.parametrize("name", [q for q in QUERIES if not q.startswith(("p2_", "p5_", "p6_", "p7_", "p8_"))])
def test_empty_tables(spark, empty_tables, name):
    if name == "stream_closed_windows":
        pytest.skip("the stream reads what files there are")
    made_without_tables = ("grammar_enum", "grammar_neighbours", "schema_difference", "content_hash")
    assert QUERIES[name](spark, empty_tables).count() == 0 or name in made_without_tables


@pytest.mark.parametrize("name", OWN)
def test_clashing_columns(spark, data, clashing_tables, name):
    assert rows(QUERIES[name](spark, clashing_tables).toPandas()) == rows(QUERIES[name](spark, data).toPandas())
