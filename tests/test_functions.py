"""Scalar functions on the awkward values: null, empty, zero, out of range."""

from __future__ import annotations

import datetime as dt
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import mixed as M
from tidemark.functions import numbers as N
from tidemark.functions import text as X
from tidemark.functions import udfs as U
from tidemark.functions.nested import first_item, last_item


def one(spark, column, **values):
    """The value of an expression over a single row."""
    schema = ", ".join(f"{n} {kind}" for n, (_, kind) in values.items())
    return spark.createDataFrame([tuple(v for v, _ in values.values())], schema).select(column).head()[0]


def test_hms_seconds(spark):
    df = spark.createDataFrame([("02:00:01.0000000",), ("00:10:00",), ("xx:00:00",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(D.hms_seconds(F.col("s"))).collect()] == [7201, 600, None, None, None]


def test_date_of_parts(spark):
    df = spark.createDataFrame([("2020", "2", "29"), ("2021", "2", "29"), ("2021", "02", "03"), (None, "1", "1")], "y string, m string, d string")
    got = [r[0] for r in df.select(D.date_of_parts(F.col("y"), F.col("m"), F.col("d"))).collect()]
    assert got[:3] == [dt.date(2020, 2, 29), None, dt.date(2021, 2, 3)]


def test_ratio_cap_and_scale(spark):
    df = spark.createDataFrame([(4.0, 2.0), (1.0, 0.0), (None, 1.0), (9.0, None)], "a double, b double")
    assert [r[0] for r in df.select(N.ratio(F.col("a"), F.col("b"))).collect()] == [2.0, None, None, None]
    assert [r[0] for r in df.select(N.capped(F.col("a"), 5.0)).collect()] == [4.0, 1.0, None, 5.0]
    assert [r[0] for r in df.select(N.clipped(F.col("a"), 2.0, 5.0)).collect()] == [4.0, 2.0, None, 5.0]
    scaled = N.range_scaled(F.col("a"), F.lit(1.0), F.lit(9.0))
    assert [r[0] for r in df.select(scaled).collect()] == [0.375, 0.0, None, 1.0]
    assert one(spark, N.range_scaled(F.col("a"), F.col("a"), F.col("a")), a=(3.0, "double")) == 0.5


# The freezing and boiling points of water on every scale.
WATER = {"C": (0.0, 100.0), "F": (32.0, 212.0), "K": (273.15, 373.15), "R": (491.67, 671.67)}


@pytest.mark.parametrize("source", WATER)
@pytest.mark.parametrize("target", WATER)
def test_convert_temperature(spark, source, target):
    df = spark.createDataFrame([(x,) for x in WATER[source]], "t double")
    got = [r[0] for r in df.select(N.convert_temperature(F.col("t"), source.lower(), target)).collect()]
    assert got == pytest.approx(WATER[target])


def test_convert_temperature_rejects_unknown_scales():
    with pytest.raises(ValueError):
        N.convert_temperature(None, "C", "X")


def test_coded(spark):
    df = spark.createDataFrame([("red",), ("blue",), ("pink",), (None,)], "c string")
    assert [r[0] for r in df.select(N.coded(F.col("c"), {"red": 1, "blue": 2})).collect()] == [1, 2, None, None]


def test_words(spark):
    text = "It's 1abc don't\n--x  ABC-def\n9\n\nend"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    assert [r.word for r in X.words(df, "t").collect()] == ["it", "don", "abc", "end"]
    assert [r.word for r in X.words(df, "t", X.LETTERS_ANYWHERE).collect()] == ["it's", "abc", "don't", "x", "abc", "end"]
    assert [r.token for r in X.tokens(df, "t").collect()].count("") == 3


@pytest.mark.parametrize(
    "text, expected",
    [(None, True), ("", True), ("1", True), (" 2.5 ", True), ("-1e3", True), (".5", True), ("5.", True), ("nan", True), ("Infinity", True)]
    + [("n/a", False), ("1d", False), ("1_000", False), ("--1", False), (".", False), ("1 2", False)],
)
def test_is_number(spark, text, expected):
    assert one(spark, X.is_number(F.col("s")), s=(text, "string")) is expected


def test_accepted_numbers_can_be_cast(spark):
    df = spark.createDataFrame([(s,) for s in ("1", " 2.5 ", "-1e3", ".5", "5.", "nan", "inf")], "s string")
    assert df.where(X.is_number(F.col("s")) & F.col("s").try_cast("double").isNull()).count() == 0


def test_array_ends(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "a array<int>")
    assert [tuple(r) for r in df.select(first_item(F.col("a")), last_item(F.col("a"))).collect()] == [(1, 3), (None, None), (None, None)]


def test_mixed_collection(spark):
    df = spark.createDataFrame([("1",), ("two",), ("3.0",), ("0",), ("",), ("[]",), (None,)], "v string")
    assert [r[0] for r in df.select(M.add_one(F.col("v"))).collect()] == ["2.0", "two", "4.0", "1.0", "", "[]", None]
    assert [r.v for r in M.numbers_only(df, "v").collect()] == ["1", "3.0", "0"]
    assert [r.v for r in M.truthy_only(df, "v").collect()] == ["1", "two", "3.0"]


def as_pair(top, bottom):
    if not bottom:
        return None
    f = Fraction(top, bottom)
    fits = all(-(2**63) <= x < 2**63 for x in (f.numerator, f.denominator))
    return [f.numerator, f.denominator] if fits else None


EDGES = [(3, 6), (1, 0), (0, 5), (-4, 6), (4, -6), (-(2**63), -1), (-(2**63), 2), (2**63 - 1, 2**63 - 1), (7, 2**62)]


def test_fractions_against_exact_arithmetic(spark):
    df = spark.createDataFrame([([a, b],) for a, b in EDGES] + [(None,)], "f array<bigint>")
    got = [r[0] for r in df.select(U.reduce_fraction("f")).collect()]
    assert got == [as_pair(a, b) for a, b in EDGES] + [None]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-(2**62), 2**62)] * 4), min_size=1, max_size=40))
def test_added_fractions(spark, quads):
    df = spark.createDataFrame([([a, b], [c, d]) for a, b, c, d in quads], "x array<bigint>, y array<bigint>").coalesce(1)
    got = [r[0] for r in df.select(U.add_fractions("x", "y")).collect()]
    assert got == [as_pair(a * d + c * b, b * d) if b and d else None for a, b, c, d in quads]


def test_fraction_to_float_equals_built_in(spark):
    df = spark.createDataFrame([([a, b],) for a, b in EDGES] + [(None,)], "f array<bigint>")
    both = df.select(U.fraction_to_float("f"), N.ratio(F.col("f")[0], F.col("f")[1])).collect()
    for python, built_in in both:
        assert python == (built_in if built_in is None else pytest.approx(built_in))


def test_vectorised_forms_agree(spark):
    df = spark.createDataFrame([(32.0,), (212.0,), (-40.0,), (None,)], "t double")
    got = df.select(
        U.fahrenheit_to_celsius("t"), U.fahrenheit_to_celsius_batches("t"), N.convert_temperature(F.col("t"), "F", "C")
    ).collect()
    for a, b, c in got:
        assert (a, b) == ((None, None) if c is None else (pytest.approx(c), pytest.approx(c)))


def test_grouped_line_equals_regression(spark):
    rows = [("a", 1, 2.0), ("a", 2, 4.5), ("a", 4, 1.0), ("one", 1, 3.0), ("flat", 2, 1.0), ("flat", 2, 5.0)]
    df = spark.createDataFrame(rows, "k string, x int, y double").groupBy("k")
    python = {r.k: r.fit for r in df.agg(U.line_of_group("x", "y").alias("fit")).collect()}
    slopes = {r.k: r.s for r in df.agg(U.slope_of_group("x", "y").alias("s")).collect()}
    built_in = {r.k: (r.s, r.i) for r in df.agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i")).collect()}
    for key, (slope, intercept) in built_in.items():
        expected = [slope if slope is None else pytest.approx(slope), intercept if slope is None else pytest.approx(intercept)]
        assert python[key] == ([None, None] if slope is None else expected)
        assert slopes[key] == expected[0]
