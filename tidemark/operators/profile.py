"""Column statistics as rows, in as few passes as the answer allows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import attach, collect_pages

# Buckets of a range in one pass, and the number of rows up to which a range's values are looked at one by one.
BUCKETS, FEW = 1024, 2000


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, stddev, min and max per numeric column: one pass, one row per column."""

    def facts(c):
        x = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("column"),
            F.count(x).alias("count"),
            F.avg(x).alias("mean"),
            F.stddev(x).alias("stddev"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        )

    return df.agg(F.array(*[facts(c) for c in columns]).alias("facts")).selectExpr("inline(facts)")


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, least and greatest value per column of any type that has an order, as strings."""

    def facts(c):
        ends = [f(c).cast("string").alias(n) for n, f in (("min", F.min), ("max", F.max))]
        return F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), *ends)

    return df.agg(F.array(*[facts(c) for c in columns]).alias("facts")).selectExpr("inline(facts)")


def melted(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """(column, value) rows; all values are cast to one type."""
    return df.select([F.col(c).cast(kind).alias(c) for c in columns]).unpivot([], list(columns), "column", "value")


@dataclass
class _Range:
    """Values of a column from low to high: how many, how many lie below them, and the ranks sought among them."""

    column: str
    low: float
    high: float
    below: int
    n: int
    ranks: list[int]


def _in_ranges(df: DataFrame, ranges: Sequence[_Range], place) -> DataFrame:
    """(range, place, value) for the values inside ranges; those of one column do not overlap."""
    items = []
    for name in dict.fromkeys(r.column for r in ranges):
        x = F.col(name).cast("double")
        at = F.lit(None).cast("struct<range:int,place:int,value:double>")
        for k, r in enumerate(ranges):
            if r.column == name:
                at = F.when(x.between(r.low, r.high), F.struct(F.lit(k).alias("range"), place(x, r).cast("int").alias("place"), x.alias("value"))).otherwise(at)
        items.append(at)
    return df.select(F.explode(F.array(*items)).alias("at")).where("at is not null").select("at.*")


def _bucket(x: Column, r: _Range) -> Column:
    # Halves, as the width of a range can exceed the largest double. Each step keeps the order of values.
    return F.floor((x * 0.5 - r.low * 0.5) / (r.high * 0.5 - r.low * 0.5) * BUCKETS)


def values_at_ranks(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, tuple[int, dict[int, float]]]:
    """Per column its number of values and those at the ranks next to ``share * (n - 1)``, by refining histograms.

    A pass counts the buckets of all open ranges at once (a map-side aggregate: no value is shuffled) with the
    ends of each bucket. Buckets that hold a sought rank are the next ranges; one of a single value is an
    answer, however many rows it has. Ranges of few rows are looked at last, value by value. Three passes do for
    some millions of rows, and each further one serves a thousand times as many. Nulls are left out;
    not-a-numbers are the largest. The driver sees ends and counts of buckets.
    """
    finite = {c: F.when((F.abs(F.col(c).cast("double")) < math.inf), F.col(c).cast("double")) for c in wanted}
    facts = []
    for c, x in finite.items():
        plain = F.col(c).cast("double")
        facts.append(F.struct(F.count(plain).alias("n"), F.count_if(plain == -math.inf).alias("least"), F.count(x).alias("finite"), F.count_if(plain == math.inf).alias("most"), F.min(x).alias("low"), F.max(x).alias("high")))
    ends = df.agg(F.array(*facts).alias("facts")).head().facts if facts else []
    answers: dict[str, dict[int, float]] = {c: {} for c in wanted}
    open_: list[_Range] = []

    def seek(column: str, pieces: Sequence[tuple[float, float, int]], below: int, ranks: Sequence[int]) -> None:
        """Sort ranks into the pieces (low, high, rows) that follow one another."""
        for low, high, n in pieces:
            mine = [r for r in ranks if below <= r < below + n]
            if mine and (low == high or math.isnan(low)):
                answers[column].update(dict.fromkeys(mine, low))
            elif mine:
                open_.append(_Range(column, low, high, below, n, mine))
            below += n

    for (c, shares), f in zip(wanted.items(), ends):
        ranks = sorted({int(r) for s in shares for r in (math.floor(s * (f.n - 1)), math.ceil(s * (f.n - 1)))}) if f.n else []
        seek(c, [(-math.inf, -math.inf, f.least), (f.low, f.high, f.finite), (math.inf, math.inf, f.most), (math.nan, math.nan, f.n - f.least - f.finite - f.most)], 0, ranks)
    while many := [r for r in open_ if r.n > FEW]:
        counted = _in_ranges(df, many, _bucket).groupBy("range", "place").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
        found: dict[int, list] = {}
        for r in counted.collect():
            found.setdefault(r.range, []).append((r.low, r.high, r.n))
        open_ = [r for r in open_ if r.n <= FEW]
        for k, r in enumerate(many):
            seek(r.column, sorted(found[k]), r.below, r.ranks)
    if open_:
        counted = _in_ranges(df, open_, lambda x, r: F.lit(0)).groupBy("range", "value").agg(F.count("*").alias("n"))
        found = {}
        for r in counted.collect():
            found.setdefault(r.range, []).append((r.value, r.value, r.n))
        for k, r in enumerate(open_):
            seek(r.column, sorted(found[k]), r.below, r.ranks)
    return {c: (f.n, answers[c]) for c, f in zip(wanted, ends)}


def percentiles(df: DataFrame, columns: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles, a row per column that has values; see ``values_at_ranks``."""
    told = []
    for c, (n, at) in values_at_ranks(df, {c: list(shares.values()) for c in columns}).items():
        targets = [s * (n - 1) for s in shares.values()] if n else []
        ends = [(at[math.floor(t)], at[math.ceil(t)], t - math.floor(t)) for t in targets]
        if n:
            told.append((c, *[low if low == high else low + (high - low) * part for low, high, part in ends]))
    return df.sparkSession.createDataFrame(told, "column string, " + ", ".join(f"`{n}` double" for n in shares))


def approximate_percentiles(df: DataFrame, columns: Sequence[str], shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """The same from sketches of fixed size in one pass; off by at most 1/accuracy in rank."""

    def facts(c):
        points = [
            F.percentile_approx(F.col(c).cast("double"), F.lit(s), F.lit(accuracy)).alias(n) for n, s in shares.items()
        ]
        return F.struct(F.lit(c).alias("column"), *points)

    return df.agg(F.array(*[facts(c) for c in columns]).alias("facts")).selectExpr("inline(facts)")


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """describe with quartiles."""
    quartiles = percentiles(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return describe(df, columns).join(quartiles, "column", "left")


def binary_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, is_binary): exactly two different values, nulls aside.

    A column has two values when its least and greatest differ and nothing lies between. That
    takes two narrow passes; counting distinct values of many columns would copy every row once
    per column.
    """
    ends = df.agg(
        *[F.min(c).alias(f"_low_{c}") for c in columns], *[F.max(c).alias(f"_high_{c}") for c in columns]
    )
    checks = [
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(
                (F.max(f"_low_{c}") < F.max(f"_high_{c}"))
                & (F.count_if((F.col(c) > F.col(f"_low_{c}")) & (F.col(c) < F.col(f"_high_{c}"))) == 0),
                F.lit(False),
            ).alias("is_binary"),
        )
        for c in columns
    ]
    return attach(df.select(*columns), ends, []).agg(F.array(*checks).alias("checks")).selectExpr("inline(checks)")


def value_sets(df: DataFrame, columns: Sequence[str], kind: str = "double", page_rows: int = 10_000) -> DataFrame:
    """The different values of each column as sorted arrays, in pages if there are very many."""
    values = melted(df, columns, kind).where("value is not null").distinct()
    return collect_pages(values, ["column"], ["value"], F.col("value"), "values", page_rows)


def column_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the sum of every column and the number of rows, ``_rows``."""
    return df.agg(*[F.sum(c).alias(c) for c in columns], F.count("*").alias("_rows"))


def rare_columns(df: DataFrame, columns: Sequence[str], at_least: int = 10) -> DataFrame:
    """(column, total) of 0/1 columns that are nearly always 0 or nearly always 1."""
    sums = column_sums(df, columns).unpivot(["_rows"], list(columns), "column", "total")
    rare = (F.col("total") < at_least) | (F.col("total") > F.col("_rows") - at_least)
    return sums.where(rare).select("column", "total")
