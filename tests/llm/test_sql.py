"""Queries with a SQL text give its rows."""

from __future__ import annotations

import duckdb
import pytest

from conftest import SMALL
from tidemark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", SQL)
def test_query(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "conversations"):
        db.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    cursor = db.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(map(tuple, QUERIES[name](spark, SMALL).select(*names).collect())) == sorted(cursor.fetchall())


@pytest.mark.parametrize("name", QUERIES)
def test_columns(spark, name):
    frame = QUERIES[name](spark, SMALL)
    assert frame.count() > 0 and len(set(frame.columns)) == len(frame.columns)
