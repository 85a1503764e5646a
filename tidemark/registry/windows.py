"""Window functions over daily readings.

Readings are one row per station and day, so a station and year has at most 366 of them.
Months and years across stations have no such bound and go through operators.windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.arrow_groups import GrowingMean
from tidemark.operators import windows as W
from tidemark.operators.ordered import attach, number_rows
from tidemark.plans.weather import READING, rows_at_extreme, rows_at_sliding_max
from tidemark.registry import query
from tidemark.sources.tables import WEATHER_SQL, Tables, weather
from tidemark.storage import settled

WEATHER = f"WITH {WEATHER_SQL}"
TOTAL_ORDER = ["temp", "stn", "mo", "da"]

# Means are taken over whole hundredths, so that both engines add without rounding.
CENTS = f"""WITH {WEATHER_SQL},
cents AS (SELECT stn, year, mo, da, CAST(round(temp * 100) AS BIGINT) AS temp FROM weather) """


def readings(t: Tables):
    """Daily readings, written once: the queries below read them more than once, and they are far
    smaller than the events they come from."""
    return settled(weather(t.events))


def in_cents(df: DataFrame) -> DataFrame:
    return df.withColumn("temp", F.round(F.col("temp") * 100).cast("bigint"))


def cents(t: Tables):
    return in_cents(weather(t.events))




@query("win_min_filter", WEATHER + "SELECT stn, year, mo, da, temp FROM weather QUALIFY temp = min(temp) OVER (PARTITION BY year)")
def win_min_filter(t: Tables):
    return rows_at_extreme(readings(t), ["year"], "temp", F.min).select(*READING)


@query("win_max_by_day", WEATHER + "SELECT stn, year, mo, da, temp FROM weather QUALIFY temp = max(temp) OVER (PARTITION BY year, mo, da)")
def win_max_by_day(t: Tables):
    return rows_at_extreme(readings(t), ["year", "mo", "da"], "temp", F.max).select(*READING)


@query(
    "win_nested_avg",
    CENTS
    + """, hottest AS (SELECT * FROM cents QUALIFY temp = max(temp) OVER (PARTITION BY year))
    SELECT stn, year, mo, da, temp, avg(temp) OVER (PARTITION BY year) AS avg_temp FROM hottest""",
)
def win_nested_avg(t: Tables):
    # A year over all stations is a large group: its maximum is aggregated and joined back.
    hottest = settled(rows_at_extreme(in_cents(readings(t)), ["year"], "temp", F.max).select(*READING))
    return W.with_group_stats(hottest, ["year"], avg_temp=F.avg("temp"))


@query("win_rank", WEATHER + "SELECT stn, mo, da, count_temp, rank() OVER (PARTITION BY mo ORDER BY count_temp) AS rank_in_month FROM weather")
def win_rank(t: Tables):
    return W.with_ranks(readings(t), ["mo"], "count_temp", rank="rank_in_month").drop("year", "temp")


@query(
    "win_dense_rank",
    WEATHER + "SELECT stn, mo, da, count_temp, dense_rank() OVER (PARTITION BY mo ORDER BY count_temp) AS rank_in_month FROM weather",
)
def win_dense_rank(t: Tables):
    return W.with_ranks(readings(t), ["mo"], "count_temp", dense_rank="rank_in_month").drop("year", "temp")


@query(
    "win_percent_rank",
    WEATHER + "SELECT stn, mo, da, temp, round(percent_rank() OVER (PARTITION BY year ORDER BY temp), 9) AS rank_in_month FROM weather",
)
def win_percent_rank(t: Tables):
    ranked = W.with_ranks(readings(t), ["year"], "temp", percent_rank="rank_in_month")
    return ranked.select("stn", "mo", "da", "temp", F.round("rank_in_month", 9).alias("rank_in_month"))


@query(
    "win_ntile",
    WEATHER + "SELECT stn, mo, da, temp, ntile(3) OVER (PARTITION BY year ORDER BY temp, stn, mo, da) AS tile FROM weather",
)
def win_ntile(t: Tables):
    return W.with_ntile(readings(t), ["year"], TOTAL_ORDER, 3, "tile").drop("year", "count_temp")


@query(
    "win_row_number",
    WEATHER + "SELECT stn, mo, da, temp, row_number() OVER (PARTITION BY year ORDER BY temp, stn, mo, da) AS row_num FROM weather",
)
def win_row_number(t: Tables):
    return number_rows(readings(t), ["year"], TOTAL_ORDER, "row_num").drop("year", "count_temp")


@query(
    "win_row_number_desc",
    WEATHER
    + """SELECT stn, mo, da, count_temp, row_number() OVER (PARTITION BY mo ORDER BY count_temp DESC, stn, da) AS row_num
         FROM weather""",
)
def win_row_number_desc(t: Tables):
    order = [F.col("count_temp").desc(), "stn", "da"]
    return number_rows(readings(t), ["mo"], order, "row_num").drop("year", "temp")


@query(
    "win_rank_tiebreak",
    WEATHER
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY mo ORDER BY count_temp, stn, da) AS place_in_month FROM weather)
    SELECT stn, mo, da, place_in_month, rank() OVER (PARTITION BY mo ORDER BY count_temp, place_in_month) AS rank_in_month FROM numbered""",
)
def win_rank_tiebreak(t: Tables):
    # The row number already follows count_temp, so ranking by it alone gives the same unique ranks.
    numbered = number_rows(readings(t), ["mo"], ["count_temp", "stn", "da"], "place_in_month")
    return W.with_ranks(numbered, ["mo"], "place_in_month", rank="rank_in_month").select("stn", "mo", "da", "place_in_month", "rank_in_month")


@query(
    "win_lag",
    WEATHER
    + """SELECT stn, mo, da, temp, lag(temp) OVER w AS previous_temp, lag(temp, 2) OVER w AS temp_two_back
         FROM weather WINDOW w AS (PARTITION BY year ORDER BY temp, stn, mo, da)""",
)
def win_lag(t: Tables):
    lags = {"previous_temp": 1, "temp_two_back": 2}
    return W.with_lags(readings(t), ["year"], TOTAL_ORDER, "temp", lags).drop("year", "count_temp")


@query(
    "win_cume_dist",
    WEATHER
    + """SELECT stn, mo, da, round(percent_rank() OVER w, 9) AS percent_rank, round(cume_dist() OVER w, 9) AS cume_dist
         FROM weather WINDOW w AS (PARTITION BY year ORDER BY temp)""",
)
def win_cume_dist(t: Tables):
    ranked = W.with_ranks(readings(t), ["year"], "temp", percent_rank="pr", cume_dist="cd")
    return ranked.select("stn", "mo", "da", F.round("pr", 9).alias("percent_rank"), F.round("cd", 9).alias("cume_dist"))


FRAMES_SQL = """SELECT stn, mo, da, temp, avg(temp) OVER (PARTITION BY year) AS avg_plain,
  avg(temp) OVER (PARTITION BY year ORDER BY temp) AS avg_ordered FROM cents"""


@query("win_default_frames", CENTS + FRAMES_SQL)
def win_default_frames(t: Tables):
    whole = W.with_group_stats(in_cents(readings(t)), ["year"], avg_plain=F.avg("temp"))
    both = W.with_running_mean(whole, ["year"], "temp", "avg_ordered")
    return both.select("stn", "mo", "da", "temp", "avg_plain", "avg_ordered")


@query(
    "win_rows_unbounded",
    CENTS
    + """SELECT stn, mo, da, temp, avg(temp) OVER (PARTITION BY stn, year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS avg_plain
         FROM cents""",
)
def win_rows_unbounded(t: Tables):
    whole = Window.partitionBy("stn", "year").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return cents(t).select("stn", "mo", "da", "temp", F.avg("temp").over(whole).alias("avg_plain"))


@query(
    "win_range_growing",
    CENTS
    + """SELECT stn, mo, da, temp, avg(temp) OVER (PARTITION BY stn, year ORDER BY temp RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS avg_ordered
         FROM cents""",
)
def win_range_growing(t: Tables):
    upto = Window.partitionBy("stn", "year").orderBy("temp").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return cents(t).select("stn", "mo", "da", "temp", F.avg("temp").over(upto).alias("avg_ordered"))


@query(
    "win_range_days",
    WEATHER
    + """SELECT stn, mo, da, count_temp, avg(count_temp) OVER (PARTITION BY year
           ORDER BY datediff('day', DATE '1970-01-01', CAST(year || '-' || mo || '-' || da AS DATE)) * 86400
           RANGE BETWEEN 2592000 PRECEDING AND 2592000 FOLLOWING) AS avg_count FROM weather""",
)
def win_range_days(t: Tables):
    day = F.to_date(F.concat_ws("-", "year", "mo", "da"))
    dated = readings(t).withColumn("day_second", F.unix_timestamp(day))
    month = 30 * 24 * 60 * 60
    averaged = W.with_sliding_mean(dated, ["year"], "day_second", "count_temp", month, "avg_count")
    return averaged.select("stn", "mo", "da", "count_temp", "avg_count")


@query(
    "win_range_week_max",
    WEATHER
    + """SELECT stn, year, mo, da, temp FROM weather QUALIFY temp = max(temp) OVER (PARTITION BY stn
           ORDER BY CAST(year || '-' || mo || '-' || da AS DATE)
           RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY FOLLOWING)""",
)
def win_range_week_max(t: Tables):
    return rows_at_sliding_max(readings(t), 7).select(*READING)


@query(
    "win_range_month_index",
    """SELECT o_orderkey, avg(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY year(o_orderdate) * 12 + month(o_orderdate)
         RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS avg_key FROM orders""",
)
def win_range_month_index(t: Tables):
    indexed = t.orders.withColumn("month_no", F.year("o_orderdate") * 12 + F.month("o_orderdate"))
    averaged = W.with_sliding_mean(indexed, ["o_orderstatus"], "month_no", "o_custkey", 1, "avg_key")
    return averaged.select("o_orderkey", "avg_key")


@query(
    "win_rows_vs_range",
    """SELECT ord, count(ord) OVER (ORDER BY ord ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS "row",
         count(ord) OVER (ORDER BY ord RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS "range"
       FROM (SELECT l_quantity::BIGINT AS ord FROM lineitem)""",
)
def win_rows_vs_range(t: Tables):
    frame = t.lineitem.select(F.col("l_quantity").cast("bigint").alias("ord"))
    by_value = W.sliding(frame, [], "ord", 2, 2, {"range": F.count("ord")})
    return attach(W.sliding_row_counts(frame, ["ord"], 2, 2, "row"), by_value, ["ord"])


@query(
    "win_median_partition",
    WEATHER + "SELECT stn, mo, da, temp, round(median(temp) OVER (PARTITION BY year), 6) AS median_temp FROM weather",
)
def win_median_partition(t: Tables):
    whole = W.with_group_median(readings(t), ["year"], "temp", "median_temp")
    return whole.select("stn", "mo", "da", "temp", F.round("median_temp", 6).alias("median_temp"))


@query(
    "win_median_growing",
    WEATHER
    + "SELECT stn, mo, da, temp, round(median(temp) OVER (PARTITION BY year ORDER BY mo, da), 6) AS median_so_far FROM weather",
)
def win_median_growing(t: Tables):
    dated = readings(t).withColumn("at", F.col("mo").cast("int") * 100 + F.col("da").cast("int"))
    grown = W.with_growing_median(dated, ["year"], "at", "temp", "median_so_far")
    return grown.select("stn", "mo", "da", "temp", F.round("median_so_far", 6).alias("median_so_far"))


@query(
    "win_mean_udaf",
    CENTS + "SELECT stn, mo, da, temp, avg(temp) OVER (PARTITION BY stn, year ORDER BY mo, da) AS mean_v FROM cents",
)
def win_mean_udaf(t: Tables):
    return W.with_grown(cents(t).select("stn", "year", "mo", "da", "temp"), ["stn", "year"], ["mo", "da"], "temp", "mean_v", GrowingMean).drop("year")
