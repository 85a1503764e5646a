"""User-defined functions, and collections of mixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import mixed as M
from tidemark.functions import udfs as U
from tidemark.functions.arrow_groups import GrowingMedian, fitted_lines
from tidemark.functions.numbers import ratio
from tidemark.operators import windows as W
from tidemark.registry import query
from tidemark.registry.windows import CENTS, cents
from tidemark.sources.tables import WEATHER_SQL, Tables, weather

WEATHER = f"WITH {WEATHER_SQL}"

# Distinct pairs of supplier and line number: some denominators are zero.
FRACTIONS_SQL = """WITH fractions AS (SELECT DISTINCT l_suppkey AS num, l_linenumber::BIGINT - 1 AS den FROM lineitem),
reduced AS (SELECT num, den, CASE WHEN den <> 0 THEN num // gcd(num, den) END AS rnum,
                   CASE WHEN den <> 0 THEN den // gcd(num, den) END AS rden FROM fractions) """


def fractions(t: Tables) -> DataFrame:
    """Each pair once: copies are dropped before Python sees them."""
    pairs = t.lineitem.select(F.col("l_suppkey").alias("num"), (F.col("l_linenumber").cast("bigint") - 1).alias("den"))
    return pairs.distinct().withColumn("fraction", F.array("num", "den"))


def shown(df: DataFrame, column: str, top: str = "rnum", bottom: str = "rden") -> DataFrame:
    """Array elements as columns; doubles, because a missing fraction is null."""
    parts = [F.get(column, F.lit(i)).cast("double").alias(n) for i, n in enumerate((top, bottom))]
    return df.select("num", "den", *parts)


REDUCED_SQL = FRACTIONS_SQL + "SELECT num, den, rnum::DOUBLE AS rnum, rden::DOUBLE AS rden FROM reduced"


@query("udf_row", FRACTIONS_SQL + "SELECT num, den, CASE WHEN den <> 0 THEN num / den END AS share FROM fractions")
def udf_row(t: Tables):
    return fractions(t).select("num", "den", U.fraction_to_float("fraction").alias("share"))


@query(
    "udf_row_decorated",
    "SELECT event_type, CASE WHEN event_type <> 'view' THEN upper(substr(event_type, 1, 1)) END AS initial, count(*) AS n FROM events GROUP BY 1, 2",
)
def udf_row_decorated(t: Tables):
    counted = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return counted.withColumn("initial", U.initial("event_type"))


@query("udf_fraction_reduce", REDUCED_SQL)
def udf_fraction_reduce(t: Tables):
    return shown(fractions(t).withColumn("reduced", U.reduce_fraction("fraction")), "reduced")


@query("udf_fraction_float", FRACTIONS_SQL + "SELECT num, den, CASE WHEN den <> 0 THEN num / den END AS share FROM fractions")
def udf_fraction_float(t: Tables):
    return fractions(t).select("num", "den", ratio(F.col("num"), F.col("den")).alias("share"))


@query(
    "udf_fraction_add",
    FRACTIONS_SQL
    + """SELECT num, den, ((2 * rnum) // gcd(2 * rnum, rden))::DOUBLE AS rnum, (rden // gcd(2 * rnum, rden))::DOUBLE AS rden FROM reduced""",
)
def udf_fraction_add(t: Tables):
    reduced = fractions(t).withColumn("reduced", U.reduce_fraction("fraction"))
    return shown(reduced.withColumn("doubled", U.add_fractions("reduced", "reduced")), "doubled")


# Beside the table's pairs, pairs at the end of 64 bits: the least number over -1, -2, -3, ... The first has no
# 64-bit result, the others have, in halves, or as they are with both signs turned.
BOUNDED_SQL = FRACTIONS_SQL.rstrip() + """,
edge AS (SELECT DISTINCT (-9223372036854775807 - 1)::BIGINT AS num, -l_linenumber::BIGINT AS den FROM lineitem),
terms AS (SELECT num, den, gcd(num::HUGEINT, den::HUGEINT) AS g FROM edge),
exact AS (SELECT num, den, -(num::HUGEINT // g) AS rnum, -(den::HUGEINT // g) AS rden FROM terms)
SELECT num, den, rnum::DOUBLE AS rnum, rden::DOUBLE AS rden FROM reduced
UNION ALL SELECT num, den, CASE WHEN rnum < 9223372036854775808 THEN rnum END::DOUBLE, CASE WHEN rnum < 9223372036854775808 THEN rden END::DOUBLE FROM exact"""


@query("udf_fraction_bounded", BOUNDED_SQL)
def udf_fraction_bounded(t: Tables):
    least = F.lit(-(2**63)).cast("bigint")
    edge = t.lineitem.select(least.alias("num"), (-F.col("l_linenumber")).cast("bigint").alias("den")).distinct()
    every = fractions(t).unionByName(edge.withColumn("fraction", F.array("num", "den")))
    return shown(every.withColumn("reduced", U.reduce_fraction("fraction")), "reduced")


@query("udf_type_mismatch", "SELECT o_orderkey, CAST(trunc(o_orderkey * 3.14159::DOUBLE) AS BIGINT) AS scaled FROM orders")
def udf_type_mismatch(t: Tables):
    return t.orders.select("o_orderkey", (F.col("o_orderkey") * 3.14159).cast("bigint").alias("scaled"))


CELSIUS_SQL = WEATHER + "SELECT DISTINCT temp, round((temp - 32) * 5 / 9, 6) AS temp_c FROM weather"


@query("pudf_series", CELSIUS_SQL)
def pudf_series(t: Tables):
    temps = weather(t.events).select("temp").distinct()
    return temps.select("temp", F.round(U.fahrenheit_to_celsius("temp"), 6).alias("temp_c"))


@query("pudf_iterator", CELSIUS_SQL)
def pudf_iterator(t: Tables):
    temps = weather(t.events).select("temp").distinct()
    return temps.select("temp", F.round(U.fahrenheit_to_celsius_batches("temp"), 6).alias("temp_c"))


@query(
    "pudf_multi_iterator",
    WEATHER + "SELECT DISTINCT year, mo, da, CAST(CAST(year || '-' || mo || '-' || da AS DATE) AS VARCHAR) AS date FROM weather",
)
def pudf_multi_iterator(t: Tables):
    days = weather(t.events).select("year", "mo", "da").distinct()
    return days.select("year", "mo", "da", U.dates_of_parts("year", "mo", "da").cast("string").alias("date"))


SLOPE_SQL = WEATHER + "SELECT stn, year, mo, round(regr_slope(temp, CAST(da AS INT)), 6) AS slope{} FROM weather GROUP BY 1, 2, 3 HAVING count(*) > 1"


def monthly_lines(t: Tables) -> DataFrame:
    """Temperature by day for each station and month; moments leave Python, not readings."""
    readings = weather(t.events).select("stn", "year", "mo", F.col("da").cast("int").alias("day"), "temp")
    lines = fitted_lines(readings, ["stn", "year", "mo"], "day", "temp").where("slope is not null")
    return lines.select("stn", "year", "mo", *[F.round(c, 6).alias(c) for c in ("slope", "intercept")])


@query("pudf_agg", SLOPE_SQL.format(""))
def pudf_agg(t: Tables):
    return monthly_lines(t).drop("intercept")


@query("pudf_agg_array", SLOPE_SQL.format(", round(regr_intercept(temp, CAST(da AS INT)), 6) AS intercept"))
def pudf_agg_array(t: Tables):
    return monthly_lines(t)


@query(
    "pudf_group_map",
    WEATHER
    + """, ends AS (SELECT *, min(temp) OVER w AS low, max(temp) OVER w AS high FROM weather WINDOW w AS (PARTITION BY stn, year, mo))
    SELECT stn, year, mo, da, temp, CASE WHEN low = high THEN 0.5 ELSE round((temp - low) / (high - low), 6) END AS temp_norm FROM ends""",
)
def pudf_group_map(t: Tables):
    # A station and month has at most 31 readings, so a group is always small.
    readings = weather(t.events).select("stn", "year", "mo", "da", "temp")
    schema = T.StructType([*readings.schema.fields, T.StructField("temp_norm", T.DoubleType())])
    scaled = readings.groupBy("stn", "year", "mo").applyInPandas(U.range_scaler("temp", "temp_norm"), schema)
    return scaled.withColumn("temp_norm", F.round("temp_norm", 6))


@query(
    "pudf_window",
    CENTS
    + """SELECT stn, mo, da, temp, median(temp) OVER (PARTITION BY stn, year) AS median_temp,
         median(temp) OVER (PARTITION BY stn, year ORDER BY mo, da) AS median_so_far FROM cents""",
)
def pudf_window(t: Tables):
    return W.with_grown(cents(t).select("stn", "year", "mo", "da", "temp"), ["stn", "year"], ["mo", "da"], "temp", "median_so_far", GrowingMedian, "median_temp").drop("year")


MIXED_SQL = """WITH mixed AS (SELECT event_id, CASE event_type WHEN 'click' THEN CAST((event_id % 7) AS VARCHAR)
  WHEN 'view' THEN NULL WHEN 'signup' THEN '' WHEN 'error' THEN '[]' ELSE event_type END AS v FROM events) """


def mixed(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    value = (
        F.when(kind == "click", (F.col("event_id") % 7).cast("string"))
        .when(kind == "view", F.lit(None))
        .when(kind == "signup", "")
        .when(kind == "error", "[]")
        .otherwise(kind)
    )
    return t.events.select("event_id", value.alias("v"))


@query("coll_map", MIXED_SQL + "SELECT event_id, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN CAST(CAST(v AS DOUBLE) + 1 AS VARCHAR) ELSE v END AS v FROM mixed")
def coll_map(t: Tables):
    return mixed(t).select("event_id", M.add_one(F.col("v")).alias("v"))


@query("coll_filter_type", MIXED_SQL + "SELECT event_id, v FROM mixed WHERE TRY_CAST(v AS DOUBLE) IS NOT NULL")
def coll_filter_type(t: Tables):
    return M.numbers_only(mixed(t), "v")


@query("coll_filter_truthy", MIXED_SQL + "SELECT event_id, v FROM mixed WHERE v IS NOT NULL AND v NOT IN ('', '[]', '0')")
def coll_filter_truthy(t: Tables):
    return M.truthy_only(mixed(t), "v")


@query("coll_reduce", "SELECT sum(l_partkey)::BIGINT AS total FROM lineitem")
def coll_reduce(t: Tables):
    return M.total(t.lineitem, "l_partkey")


@query("coll_count", MIXED_SQL + "SELECT count(*) AS n FROM mixed")
def coll_count(t: Tables):
    return mixed(t).agg(F.count("*").alias("n"))
