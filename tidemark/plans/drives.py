"""Reliability of drives from daily status rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import gibibytes, ratio
from tidemark.operators.ordered import attach
from tidemark.storage import settled


def with_capacity_gib(days: DataFrame) -> DataFrame:
    return days.withColumn("capacity_gib", gibibytes(F.col("capacity_bytes")))


def failure_rate(days: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Failures per drive-day of the groups that had a failure, counted in one pass."""
    counted = days.groupBy(*keys).agg(F.count("*").alias("drive_days"), F.count_if(F.col("failure") == 1).alias("failures"))
    rate = ratio(F.col("failures"), F.col("drive_days"))
    return counted.where("failures > 0").withColumn("failure_rate", rate)


def reliability(days: DataFrame) -> DataFrame:
    """Failure rate of every model and capacity, zero where nothing failed."""
    counted = with_capacity_gib(days).groupBy("model", "capacity_gib").agg(
        F.count("*").alias("drive_days"), F.count_if(F.col("failure") == 1).alias("failures")
    )
    return counted.select("model", "capacity_gib", ratio(F.col("failures"), F.col("drive_days")).alias("failure_rate"))


def most_reliable(rates: DataFrame, capacity_gib: float, precision: float, top_n: int) -> DataFrame:
    """The models of about a capacity that fail least; larger ones first among equals."""
    low, high = capacity_gib / (1 + precision), capacity_gib * (1 + precision)
    near = rates.where(F.col("capacity_gib").between(low, high))
    return near.orderBy(F.asc("failure_rate"), F.desc("capacity_gib"), F.asc("model")).limit(top_n)


def capacity_drift(days: DataFrame) -> DataFrame:
    """Models reported with more than one capacity."""
    size = F.col("capacity_gib")
    spread = with_capacity_gib(days).groupBy("model").agg(F.min(size).alias("min_gib"), F.max(size).alias("max_gib"))
    return spread.where(F.col("min_gib") != F.col("max_gib"))


def mean_age(days: DataFrame) -> DataFrame:
    """Mean number of days a drive was seen, by model and capacity."""
    lives = with_capacity_gib(days).groupBy("serial_number", "model", "capacity_gib").agg(
        F.datediff(F.max("date"), F.min("date")).alias("age")
    )
    return lives.groupBy("model", "capacity_gib").agg(F.avg("age").alias("avg_age"))


def modal_capacity(days: DataFrame) -> DataFrame:
    """The commonest capacity of each model; the smaller one on a tie."""
    counted = days.groupBy("model", "capacity_bytes").agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col("capacity_bytes")).alias("smaller")))
    return counted.groupBy("model").agg(best.alias("best")).select(
        "model", (-F.col("best.smaller")).alias("capacity_bytes"), F.col("best.n").alias("occurrences")
    )


def with_modal_capacity(days: DataFrame) -> DataFrame:
    """Drive days with the capacity replaced by the commonest one of the model."""
    return attach(days.drop("capacity_bytes"), settled(modal_capacity(days).drop("occurrences")), ["model"])


def capacity_on_first_days(days: DataFrame) -> DataFrame:
    """Total capacity on the first day of each month, in TiB."""
    firsts = days.selectExpr("cast(date as date) AS date", "capacity_bytes").where("extract(day from date) = 1")
    total = F.sum("capacity_bytes") / F.pow(F.lit(1024), 4)
    return firsts.groupBy("date").agg(total.alias("capacity_tib")).orderBy("date")
