"""Every named query: it runs, it has rows, and it gives the rows of its SQL text."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from tidemark import registry  # noqa: E402
from tools.check_sql import as_counts, open_tables, run_both  # noqa: E402

from conftest import SMALL  # noqa: E402

# The text operators have tests of their own.
QUERIES, TEXTS = registry.all_queries(), registry.all_sql()


@pytest.fixture(scope="module")
def db():
    return open_tables(SMALL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    names, mine, theirs = run_both(spark, db, SMALL, QUERIES[name], TEXTS.get(name))
    assert names and len(set(names)) == len(names)
    if theirs is not None:
        assert as_counts(mine) == as_counts(theirs)


def test_every_text_has_a_query():
    assert set(TEXTS) <= set(QUERIES)


SPLIT = [n for n in QUERIES if n.startswith(("win_", "agg_collect_", "profile_")) or n == "job_episode_roundtrip"]


@pytest.mark.parametrize("name", SPLIT)
def test_query_with_split_groups(spark, db, name):
    spark.conf.set("spark.tidemark.window.maxGroupRows", "100")
    try:
        _, mine, theirs = run_both(spark, db, SMALL, QUERIES[name], TEXTS.get(name))
    finally:
        spark.conf.unset("spark.tidemark.window.maxGroupRows")
    assert as_counts(mine) == as_counts(theirs)


def test_contract_has_every_query():
    assert set(QUERIES) <= set(contract.queries()) and set(TEXTS) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).columns[0] == "class_code"


def test_cache_reuse_gives_three_models_for_each_capacity(spark):
    found = contract.queries()["cache_reuse"](spark, SMALL).groupBy("near").count().collect()
    assert sorted(map(tuple, found)) == [(4.0, 3), (8.0, 3)]
