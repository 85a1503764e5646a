"""Declared schemas of the supplied Parquet tables, and frames derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import settle_settings

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
        " l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
        " l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Tables:
    """Lazy scans with declared schemas: ``Tables(spark, folder).orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = settle_settings(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")


def shows(documents: DataFrame) -> DataFrame:
    """Nested documents: one show per text, one episode per line of it.

    The nesting is built inside each row, so no group is ever collected.
    """
    episodes = F.expr(
        "transform(split(text, '\\n'), (line, i) -> struct("
        " i + 1 as id, line as name, date_add(date'2020-01-01', i * 7) as on_day,"
        " concat(cast(date_add(date'2020-01-01', i * 7) as string), 'T20:30:00') as sent_at,"
        " length(line) as runtime))"
    )
    return documents.select(
        F.col("doc_id").alias("id"),
        F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("name"),
        F.array("lang", "source").alias("genres"),
        F.col("lang").alias("language"),
        F.col("source").alias("type"),
        F.when(F.col("n_chars") > 1000, "Ended").otherwise("Running").alias("status"),
        F.col("n_chars").alias("weight"),
        F.struct(episodes.alias("lines")).alias("document"),
    )


def weather(events: DataFrame) -> DataFrame:
    """One reading per station and day: at most 366 rows for a station and year.

    A busy station collapses in the map-side half of this aggregation, which is what bounds
    every later window or pandas group keyed by station.
    """
    day = F.to_date("ts")
    return (
        events.groupBy(F.col("user_id").cast("string").alias("stn"), day.alias("day"))
        .agg(F.max("value").alias("temp"), F.count("*").alias("count_temp"))
        .select(
            "stn",
            F.date_format("day", "yyyy").alias("year"),
            F.date_format("day", "MM").alias("mo"),
            F.date_format("day", "dd").alias("da"),
            "temp",
            "count_temp",
        )
    )


def drive_days(events: DataFrame) -> DataFrame:
    """One row per drive and reading: model, serial number, capacity, date, failure flag."""
    return events.select(
        F.concat(F.lit("M"), F.col("user_id") % 20).alias("model"),
        F.concat(F.lit("S"), F.col("user_id")).alias("serial_number"),
        (F.pow(F.lit(1024.0), 3) * (F.col("user_id") % 20 + 1 + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)))
        .cast("bigint")
        .alias("capacity_bytes"),
        F.to_date("ts").alias("date"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("failure"),
        F.get_json_object("props", "$.k").alias("smart_1_raw"),
    )


def recipes(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Wide feature rows with untidy values: one per customer."""
    spending = orders.groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"),
        F.max("o_totalprice").alias("max_price"),
        F.min("o_totalprice").alias("min_price"),
        F.max(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("has_f"),
        F.max(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)).alias("has_urgent"),
    )
    key = F.col("c_custkey")

    def flag(condition):
        return F.when(condition, 1.0).otherwise(0.0)

    return customer.join(spending, key == F.col("o_custkey"), "left").select(
        F.col("c_name").alias("title"),
        F.when(key % 50 == 0, "n/a").when(key % 37 == 1, "").otherwise((key % 6).cast("string")).alias("rating"),
        F.when(key % 29 == 7, "unknown").otherwise(F.floor("max_price").cast("string")).alias("calories"),
        F.when(key % 11 != 3, F.col("min_price")).alias("protein"),
        F.when(key % 13 != 5, F.col("n_orders").cast("double")).alias("fat"),
        F.when(key % 17 != 4, F.col("c_acctbal")).alias("sodium"),
        F.when(key % 101 == 9, 2.0).when(key % 7 != 2, flag(key % 3 == 0)).alias("cakeweek"),
        F.when(key % 103 == 9, 3.0).when(key % 7 != 3, flag(key % 5 == 0)).alias("wasteless"),
        F.when(key % 9 != 1, flag(F.col("c_nationkey") < 5)).alias("clove"),
        flag(key == 1).alias("rare herb"),
        F.coalesce("has_f", F.lit(0.0)).alias("quick-22 meals"),
        F.col("has_urgent").alias("appetite & more"),
        F.when(key % 19 != 6, flag(F.col("c_mktsegment") == "BUILDING")).alias("dessert"),
    )


# ---- the same frames for the SQL side of the value checks -------------------------------

SHOWS_SQL = """
shows AS (
  SELECT doc_id AS id, source || '-' || doc_id AS name, [lang, source] AS genres, lang AS language,
         source AS type, CASE WHEN n_chars > 1000 THEN 'Ended' ELSE 'Running' END AS status,
         n_chars AS weight, string_split(text, chr(10)) AS lines
  FROM documents),
episodes AS (
  SELECT s.id, s.name AS show_name, u.i AS ep_id, s.lines[u.i] AS ep_name,
         date '2020-01-01' + CAST((u.i - 1) * 7 AS INTEGER) AS on_day, length(s.lines[u.i]) AS runtime
  FROM shows s, (SELECT id, unnest(range(1, len(lines) + 1)) AS i FROM shows) u WHERE u.id = s.id)
"""

WEATHER_SQL = """
weather AS (
  SELECT CAST(user_id AS VARCHAR) AS stn, strftime(day, '%Y') AS year, strftime(day, '%m') AS mo,
         strftime(day, '%d') AS da, temp, count_temp
  FROM (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS temp, count(*) AS count_temp
        FROM events GROUP BY 1, 2))
"""

DRIVES_SQL = """
drives AS (
  SELECT 'M' || (user_id % 20) AS model, 'S' || user_id AS serial_number,
         CAST(1073741824 * (user_id % 20 + 1 + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) AS BIGINT)
           AS capacity_bytes,
         CAST(ts AS DATE) AS date, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failure
  FROM events)
"""

RECIPES_SQL = """
recipes AS (
  SELECT c_name AS title,
    CASE WHEN c_custkey % 50 = 0 THEN 'n/a' WHEN c_custkey % 37 = 1 THEN ''
         ELSE CAST(c_custkey % 6 AS VARCHAR) END AS rating,
    CASE WHEN c_custkey % 29 = 7 THEN 'unknown'
         ELSE CAST(CAST(floor(max_price) AS BIGINT) AS VARCHAR) END AS calories,
    CASE WHEN c_custkey % 11 <> 3 THEN min_price END AS protein,
    CASE WHEN c_custkey % 13 <> 5 THEN CAST(n_orders AS DOUBLE) END AS fat,
    CASE WHEN c_custkey % 17 <> 4 THEN c_acctbal END AS sodium,
    CASE WHEN c_custkey % 101 = 9 THEN 2.0::DOUBLE WHEN c_custkey % 7 <> 2
         THEN CASE WHEN c_custkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS cakeweek,
    CASE WHEN c_custkey % 103 = 9 THEN 3.0::DOUBLE WHEN c_custkey % 7 <> 3
         THEN CASE WHEN c_custkey % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS wasteless,
    CASE WHEN c_custkey % 9 <> 1 THEN CASE WHEN c_nationkey < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS clove,
    CASE WHEN c_custkey = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rare_herb,
    coalesce(has_f, 0.0)::DOUBLE AS quick_22_meals,
    CAST(has_urgent AS DOUBLE) AS appetite_and_more,
    CASE WHEN c_custkey % 19 <> 6
         THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS dessert
  FROM customer LEFT JOIN (
    SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS max_price, min(o_totalprice) AS min_price,
           max(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS has_f,
           max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS has_urgent
    FROM orders GROUP BY 1) ON c_custkey = o_custkey)
"""
