"""Commercial share of airtime from a broadcast log and its lookup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio

# Programme class codes that count as commercial, and the one counted in part.
COMMERCIAL_CODES = ["COM", "PRC", "PGI", "PRO", "PSA", "MAG", "LOC", "SPO", "MER", "SOL"]
PARTIAL_CODE, PARTIAL_WEIGHT = "PRC", 0.75


def commercial_seconds(
    code: Column, seconds: Column, codes: Sequence[str] = COMMERCIAL_CODES, partial: str | None = None, weight: float = PARTIAL_WEIGHT
) -> Column:
    """The seconds that count as commercial; the partly counted class is looked at first."""
    trimmed = F.trim(code)
    whole = trimmed.isin(list(codes))
    if partial is None:
        return F.when(whole, seconds).otherwise(0)
    return F.when(trimmed == partial, seconds * weight).when(whole, seconds).otherwise(0)


def commercial_ratio(
    log: DataFrame,
    keys: Sequence[str],
    code: str,
    seconds: str,
    codes: Sequence[str] = COMMERCIAL_CODES,
    partial: str | None = None,
) -> DataFrame:
    """Commercial and total seconds per group and their ratio, null for an empty total."""
    totals = log.groupBy(*keys).agg(
        F.sum(commercial_seconds(F.col(code), F.col(seconds), codes, partial)).alias("counted_seconds"),
        F.sum(seconds).alias("all_seconds"),
    )
    return totals.withColumn("commercial_ratio", ratio(F.col("counted_seconds"), F.col("all_seconds")))


def full_log(log: DataFrame, primary: DataFrame, categories: DataFrame, classes: DataFrame) -> DataFrame:
    """Log rows of primary services with category and class; lookups may have gaps.

    The lookups have one row per key: Spark broadcasts those that its size checks allow, and a
    shuffled join with a hot key is split at run time because only the log side repeats keys.
    """
    return (
        log.join(primary, "service_id", "inner").join(categories, "category_id", "left").join(classes, "class_id", "left")
    )


def ratio_histogram(ratios: DataFrame, digits: int = 1) -> DataFrame:
    """How many groups have each rounded ratio."""
    filled = ratios.fillna(0, subset=["commercial_ratio"])
    rounded = F.round("commercial_ratio", digits).alias("commercial_ratio")
    return filled.groupBy(rounded).agg(F.count("*").alias("n_signs"))
