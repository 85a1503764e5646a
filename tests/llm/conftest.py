from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of the given texts, with extra columns whose names clash with those of the operators."""

    def make(texts, ids=None, partitions=3, langs=None):
        ids = list(range(len(texts))) if ids is None else ids
        langs = langs or ["en"] * len(texts)
        schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, key long, score string, n long, k1 string, held_out string, part int, rep long"
        rows = [(i, t, lang, "s", None if t is None else len(t), "x", 1, "y", 2, "z", "h", 3, 4) for i, t, lang in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return make
