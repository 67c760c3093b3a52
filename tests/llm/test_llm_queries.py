"""The subpackage's queries: SQL, empty tables, clashing columns."""

from pathlib import Path

import duckdb
import pytest

from tickloom.llm.queries import REGISTRY


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v) for v in r) for r in frame[names].itertuples(index=False)))


@pytest.mark.parametrize("name", list(REGISTRY.sql))
def test_matches_sql(spark, data, name):
    db = duckdb.connect()
    for path in Path(data).iterdir():
        db.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    assert rows(REGISTRY.queries[name](spark, data).toPandas()) == rows(db.execute(REGISTRY.sql[name]).df())


@pytest.mark.parametrize("name", list(REGISTRY.queries))
def test_empty_tables(spark, empty_tables, name):
    assert REGISTRY.queries[name](spark, empty_tables).count() == 0


@pytest.mark.parametrize("name", ["p2_found", "p5_found", "p6_ids", "p7_mixture", "p8_scores"])
def test_clashing_columns(spark, data, clashing_tables, name):
    query = REGISTRY.queries[name]
    assert rows(query(spark, clashing_tables).toPandas()) == rows(query(spark, data).toPandas())
