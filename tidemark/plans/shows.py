"""Shows with nested episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.nested import first_item, last_item


def episodes(shows: DataFrame) -> DataFrame:
    """One row per episode."""
    return shows.select("id", F.explode("document.lines").alias("episode"))


def show_spans(shows: DataFrame) -> DataFrame:
    """Seconds from the first episode to the last, in the order they are listed."""
    stamps = F.col("document.lines.sent_at")
    first, last = F.try_to_timestamp(first_item(stamps)), F.try_to_timestamp(last_item(stamps))
    return shows.select("id", "name", (F.unix_timestamp(last) - F.unix_timestamp(first)).alias("duration_seconds"))
