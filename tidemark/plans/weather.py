"""Questions about daily readings per station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import attach
from tidemark.operators.windows import with_sliding_max
from tidemark.storage import settled

READING = ["stn", "year", "mo", "da", "temp"]


def coldest_by_semi_join(readings: DataFrame, period: str = "year") -> DataFrame:
    """Where and when each period was coldest: the minima are a few rows, broadcast by size."""
    minima = readings.groupBy(period).agg(F.min("temp").alias("temp"))
    return readings.join(minima, [period, "temp"], "left_semi").select(*READING)


def rows_at_extreme(df: DataFrame, keys: list[str], value: str, extreme=F.min) -> DataFrame:
    """Rows that hold their group's extreme, ties included.

    Same rows as extreme().over(partitionBy(keys)) == value, but the extreme is aggregated with
    map-side combine and joined back, so a large group is never one task.
    """
    best = df.groupBy(*keys).agg(extreme(value).alias("_best"))
    return attach(df, settled(best), keys).where(F.col(value) == F.col("_best")).drop("_best")


def rows_at_sliding_max(readings: DataFrame, days: int = 7) -> DataFrame:
    """Readings that are the highest of their station within some days before and after."""
    dated = readings.withColumn("day", F.unix_date(F.to_date(F.concat_ws("-", "year", "mo", "da"))))
    return with_sliding_max(dated, ["stn"], "day", "temp", days, "max_temp").where(F.col("temp") == F.col("max_temp"))
