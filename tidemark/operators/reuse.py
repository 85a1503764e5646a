"""Keeping a frame that is read several times."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame


@contextmanager
def reused(df: DataFrame) -> Iterator[DataFrame]:
    """Cache for the length of a block; what does not fit into memory spills to disk."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()
