"""Equi-joins.

The large side is filtered, pruned and, where the result allows it, aggregated to one row per
key before it is joined. That also evens out a key that holds much of the data. Small sides are
left to Spark's size checks; a skewed sort-merge join is split at run time.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.weather import coldest_by_semi_join
from tidemark.registry import query
from tidemark.sources.tables import DRIVES_SQL, WEATHER_SQL, Tables, drive_days, weather
from tidemark.plans.drives import modal_capacity
from tidemark.operators.views import named_views

DRIVES = f"WITH {DRIVES_SQL}"


@query(
    "join_inner_using",
    """SELECT c_custkey AS custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer
       JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 5000""",
)
def join_inner_using(t: Tables):
    customers = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    orders = t.orders.select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice")
    return orders.join(customers, "custkey", "inner")


@query(
    "join_left_chain",
    """SELECT s_suppkey, n_name, r_name FROM supplier
       LEFT JOIN (FROM nation WHERE n_name <> 'NATION_7') ON s_nationkey = n_nationkey
       LEFT JOIN (FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey""",
)
def join_left_chain(t: Tables):
    nations = t.nation.where("n_name <> 'NATION_7'").withColumnRenamed("n_nationkey", "s_nationkey")
    regions = t.region.where("r_name <> 'ASIA'").withColumnRenamed("r_regionkey", "n_regionkey")
    chained = t.supplier.join(nations, "s_nationkey", "left").join(regions, "n_regionkey", "left")
    return chained.select("s_suppkey", "n_name", "r_name")


@query(
    "join_left_multikey",
    f"""{DRIVES} SELECT model, capacity_bytes, count(*) AS drive_days, sum(failure)::BIGINT AS failures
       FROM drives GROUP BY 1, 2""",
)
def join_left_multikey(t: Tables):
    days = drive_days(t.events)
    keys = ["model", "capacity_bytes"]
    totals = days.groupBy(*keys).agg(F.count("*").alias("drive_days"))
    failures = days.where("failure = 1").groupBy(*keys).agg(F.count("*").alias("failures"))
    return totals.join(failures, keys, "left").fillna(0, "failures")


@query(
    "join_condition_drop",
    """SELECT l_orderkey, n_lines, o_orderstatus FROM
       (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey""",
)
def join_condition_drop(t: Tables):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).drop(orders["o_orderkey"])


@query(
    "join_alias_drop",
    """SELECT custkey, c_name, spent FROM (SELECT o_custkey AS custkey, max(o_totalprice) AS spent FROM orders GROUP BY 1)
       JOIN customer ON c_custkey = custkey""",
)
def join_alias_drop(t: Tables):
    spent = t.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.max("o_totalprice").alias("spent"))
    names = t.customer.select(F.col("c_custkey").alias("custkey"), "c_name")
    left, right = spent.alias("left"), names.alias("right")
    return left.join(right, F.col("left.custkey") == F.col("right.custkey")).drop(F.col("right.custkey"))


ANTI_SQL = """SELECT DISTINCT c_custkey, c_name FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"""


def urgent_customers(t: Tables):
    return t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()


@query("join_left_anti", ANTI_SQL)
def join_left_anti(t: Tables):
    return t.customer.join(urgent_customers(t), "c_custkey", "left_anti").select("c_custkey", "c_name").distinct()


@query("join_anti_as_left", ANTI_SQL)
def join_anti_as_left(t: Tables):
    left, right = t.customer.alias("left"), urgent_customers(t).alias("right")
    joined = left.join(right, F.col("left.c_custkey") == F.col("right.c_custkey"), "left")
    return joined.where(F.col("right.c_custkey").isNull()).select("left.c_custkey", "left.c_name").distinct()


@query(
    "join_left_semi",
    f"""WITH {WEATHER_SQL} SELECT stn, year, mo, da, temp FROM weather
        WHERE (year, temp) IN (SELECT (year, min(temp)) FROM weather GROUP BY year)""",
)
def join_left_semi(t: Tables):
    return coldest_by_semi_join(weather(t.events))


@query(
    "join_sql_left",
    f"""{DRIVES} SELECT d.serial_number, drive_days, failures FROM (SELECT serial_number, count(*) AS drive_days FROM drives GROUP BY 1) d
        LEFT JOIN (SELECT serial_number, count(*) AS failures FROM drives WHERE failure = 1 GROUP BY 1) f ON d.serial_number = f.serial_number""",
)
def join_sql_left(t: Tables):
    days = drive_days(t.events)
    totals = days.groupBy("serial_number").agg(F.count("*").alias("drive_days"))
    failures = days.where("failure = 1").groupBy("serial_number").agg(F.count("*").alias("failures"))
    with named_views(totals=totals, failed=failures) as v:
        return t.spark.sql(
            f"""SELECT {v.totals}.serial_number, drive_days, failures
                FROM {v.totals} LEFT JOIN {v.failed} ON {v.totals}.serial_number = {v.failed}.serial_number"""
        )


@query(
    "join_subqueries",
    """SELECT o_orderpriority AS priority, orders_open, lines_returned
        FROM (SELECT o_orderpriority, count(*) AS orders_open FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
        JOIN (SELECT o_orderpriority AS p, count(*) AS lines_returned FROM orders JOIN lineitem ON o_orderkey = l_orderkey
              WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderpriority = p""",
)
def join_subqueries(t: Tables):
    with named_views(heads=t.orders, parts=t.lineitem) as v:
        return t.spark.sql(
            f"""
            SELECT waiting.priority, waiting.orders_open, back.lines_returned
            FROM (SELECT o_orderpriority AS priority, count_if(o_orderstatus = 'O') AS orders_open FROM {v.heads} GROUP BY 1) waiting,
                 (SELECT h.o_orderpriority AS priority, count(*) AS lines_returned FROM {v.parts} p
                  JOIN {v.heads} h ON h.o_orderkey = p.l_orderkey AND p.l_returnflag = 'R' GROUP BY 1) back
            WHERE waiting.priority = back.priority AND waiting.orders_open > 0
            """
        )


@query(
    "join_self_agg",
    f"""{DRIVES}, counted AS (SELECT model, capacity_bytes, count(*) AS n FROM drives GROUP BY 1, 2)
        SELECT model, capacity_bytes, n AS occurrences FROM counted c
        QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC, capacity_bytes) = 1""",
)
def join_self_agg(t: Tables):
    return modal_capacity(drive_days(t.events))
