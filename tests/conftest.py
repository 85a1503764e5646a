from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import build_session  # noqa: E402
from tidemark.sources.tables import Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    settings = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Small test frames would otherwise be merged into one partition, hiding split groups.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tidemark-tests-"),
    }
    session = build_session("tests", "local[4]", **settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)


def rows(df, *order):
    """Rows as tuples, sorted so that nulls compare."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, str(type(v)), v) for v in r])


@pytest.fixture(scope="session")
def as_rows():
    return rows
