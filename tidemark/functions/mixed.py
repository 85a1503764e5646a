"""Collections of mixed values, held as a string column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_number(value: Column) -> Column:
    return value.try_cast("double")


def add_one(value: Column) -> Column:
    """Numbers grow by one; whatever is not a number passes unchanged."""
    return F.coalesce((as_number(value) + 1).cast("string"), value)


def numbers_only(df: DataFrame, value: str) -> DataFrame:
    return df.where(as_number(F.col(value)).isNotNull())


def truthy_only(df: DataFrame, value: str) -> DataFrame:
    """Drops nulls, empty strings, empty lists and zeros."""
    v = F.col(value)
    return df.where(v.isNotNull() & ~v.isin("", "[]") & (F.coalesce(as_number(v), F.lit(1.0)) != 0))


def total(df: DataFrame, value: str, name: str = "total") -> DataFrame:
    return df.agg(F.sum(value).alias(name))
