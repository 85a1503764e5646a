"""Temporary views that live as long as the block that needs them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from types import SimpleNamespace
from uuid import uuid4

from pyspark.sql import DataFrame


@contextmanager
def named_views(**frames: DataFrame) -> Iterator[SimpleNamespace]:
    """Register frames under unique names, yield the names, and drop the views afterwards.

    A query is resolved against its views when spark.sql() is called, so the frame it returns
    can be used after the block.
    """
    suffix = uuid4().hex[:12]
    names = {label: f"{label}_{suffix}" for label in frames}
    for label, frame in frames.items():
        frame.createOrReplaceTempView(names[label])
    try:
        yield SimpleNamespace(**names)
    finally:
        for label, frame in frames.items():
            frame.sparkSession.catalog.dropTempView(names[label])
