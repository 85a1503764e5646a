"""Two-phase Python aggregates and growing frames, against built-in functions and plain Python."""

from __future__ import annotations

import random
import statistics
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.arrow_groups import GrowingMean, GrowingMedian, fitted_lines, grown, line_moments
from tidemark.operators import windows as W

READINGS = "k string, at int, v double"


@pytest.fixture(scope="module")
def readings(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, *range(12)]), draw.choice([None, float("nan"), *[float(i) for i in range(9)]])) for _ in range(400)]
    return spark.createDataFrame([*rows, ("nulls", 1, None), ("nulls", 2, None)], READINGS).repartition(3).cache()


@pytest.mark.parametrize("state,builtin", [(GrowingMean, F.avg), (GrowingMedian, F.median)])
@pytest.mark.parametrize("limit", [1, 100_000])
@pytest.mark.parametrize("keys", [["k"], []])
def test_grown_frames_equal_built_in_windows(spark, readings, as_rows, state, builtin, limit, keys):
    known = readings.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = W.with_grown(known, keys, ["at"], "v", "so_far", state, "all", limit)
    upto = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    want = []
    for r in known.withColumn("seen", F.collect_list("v").over(upto)).withColumn("every", F.collect_list("v").over(Window.partitionBy(*keys))).collect():
        middle = statistics.median if state is GrowingMedian else statistics.fmean
        want.append((r.k, r.at, r.v, *(round(middle(x), 9) if x else None for x in (r.seen, r.every))))
    rounded = got.select("k", "at", "v", F.round("so_far", 9), F.round("all", 9))
    assert as_rows(rounded) == as_rows(spark.createDataFrame(want, READINGS + ", a double, b double"))


def test_grown_states_are_linear_and_nan_steps_are_one(spark):
    rows = spark.range(100_000).select(F.lit("k").alias("k"), (F.col("id") % 100_000).cast("double").alias("at"), F.pmod(F.hash("id"), F.lit(1000)).cast("double").alias("v"))
    began = time.time()
    result = grown(rows, ["k"], ["at"], "v", "m", GrowingMedian)
    assert result.count() == 100_000 and result.orderBy(F.desc("at")).head().m == rows.agg(F.median("v")).head()[0]
    assert time.time() - began < 20
    odd = spark.createDataFrame([("k", float("nan"), 1.0), ("k", float("nan"), 3.0), ("k", None, 5.0)], "k string, at double, v double")
    assert {(str(r.at), r.m) for r in grown(odd, ["k"], ["at"], "v", "m", GrowingMean).collect()} == {("None", 5.0), ("nan", 3.0)}


def test_lines_of_moments_equal_regression(spark, as_rows):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None]), 1e7 + draw.randrange(30), draw.choice([None, float(draw.randrange(90))])) for _ in range(500)]
    rows += [("one", 4.0, 2.0), ("same", 0.1, 2.0), ("same", 0.1, 3.0), ("same", 0.1, 7.0), ("none", None, 1.0), ("nan", float("nan"), 1.0), ("nan", 1.0, 1.0), ("nan", 3.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(4)
    clean = df.where("not isnan(x)")
    want = clean.groupBy("k").agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"), F.regr_count("y", "x").alias("n")).where("n > 0")
    expected = {r.k: (r.s, r.i) for r in want.collect()}
    got = {r.k: (r.slope, r.intercept) for r in fitted_lines(df, ["k"], "x", "y").collect()}
    assert got.keys() == expected.keys()
    for k, (slope, intercept) in got.items():
        if k in ("one", "same"):
            assert (slope, intercept) == (None, None)
        else:
            assert slope == pytest.approx(expected[k][0], rel=1e-6) and intercept == pytest.approx(expected[k][1], rel=1e-6)
    # No raw rows in a shuffle: what Python gives is made where the rows lie, and is all that is moved.
    source = spark.createDataFrame(rows, "k string, x double, y double")
    assert "Exchange" not in line_moments(source, ["k"], "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert fitted_lines(df.where("false"), ["k"], "x", "y").count() == 0
    assert fitted_lines(df.where("k = 'b'"), [], "x", "y").head().slope == pytest.approx(expected["b"][0])
