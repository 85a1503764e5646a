"""Sorts, limits, unions and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.columns import common_columns, union_common
from tidemark.operators.rowsets import split_rows
from tidemark.operators.views import named_views
from tidemark.plans import words as W
from tidemark.plans.drives import most_reliable, reliability
from tidemark.registry import query
from tidemark.registry.aggregates import LETTERS_SQL
from tidemark.registry.scans import WORDS_SQL
from tidemark.sources.tables import DRIVES_SQL, Tables, drive_days


@query("sort_desc", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC")
def sort_desc(t: Tables):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc())


@query("sort_flag", "SELECT o_orderpriority, max(o_totalprice) AS top FROM orders GROUP BY 1 ORDER BY top DESC")
def sort_flag(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("top")).orderBy("top", ascending=False)


@query("sort_mixed", "SELECT p_type, p_size, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY p_type, p_size DESC")
def sort_mixed(t: Tables):
    return t.part.groupBy("p_type", "p_size").agg(F.count("*").alias("n")).orderBy("p_type", "p_size", ascending=[True, False])


@query("sort_ordinal", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1")
def sort_ordinal(t: Tables):
    with named_views(part=t.part) as v:
        return t.spark.sql(f"SELECT p_brand, count(*) AS n FROM {v.part} GROUP BY 1 ORDER BY 2 DESC, 1")


@query(
    "limit_n",
    f"WITH {WORDS_SQL} SELECT word, count(*) AS n FROM words WHERE word <> '' GROUP BY 1 HAVING count(*) = 1 ORDER BY word LIMIT 5",
)
def limit_n(t: Tables):
    return W.once_only(t.documents, "text").orderBy("word").limit(5)


@query("top_k", f"WITH {LETTERS_SQL} SELECT letter, count(*) AS n FROM letters GROUP BY 1 ORDER BY n DESC, letter LIMIT 5")
def top_k(t: Tables):
    return W.most_frequent(W.letter_counts(t.documents, "text"), "letter", 5)


RATES_SQL = f"""WITH {DRIVES_SQL}, rates AS (
  SELECT model, capacity_bytes / pow(1024, 3) AS capacity_gib, sum(failure) / count(*) AS rate FROM drives GROUP BY 1, 2)"""


@query(
    "top_k_param",
    f"""{RATES_SQL} SELECT model, capacity_gib, round(rate, 6) AS failure_rate FROM rates
        WHERE capacity_gib BETWEEN 12 / 1.25 AND 12 * 1.25 ORDER BY rate, capacity_gib DESC, model LIMIT 3""",
)
def top_k_param(t: Tables):
    best = most_reliable(reliability(drive_days(t.events)), capacity_gib=12.0, precision=0.25, top_n=3)
    return best.withColumn("failure_rate", F.round("failure_rate", 6))


@query(
    "union_positional",
    """SELECT name, nationkey, count(*) AS n FROM (
         SELECT c_mktsegment AS name, c_nationkey AS nationkey FROM customer UNION ALL SELECT 'SUPPLIER', s_nationkey FROM supplier)
       GROUP BY 1, 2""",
)
def union_positional(t: Tables):
    customers = t.customer.select(F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("name"), "c_acctbal")
    suppliers = t.supplier.select(F.lit("SUPPLIER").alias("name"), F.col("s_nationkey").alias("nationkey"), "s_suppkey")
    both = union_common([customers, suppliers], required=["name", "nationkey"])
    return both.groupBy("name", "nationkey").agg(F.count("*").alias("n"))


@query(
    "union_by_name",
    """SELECT nationkey, count(*) AS n, count(segment) AS n_segment FROM (
         SELECT c_nationkey AS nationkey, c_mktsegment AS segment FROM customer UNION ALL BY NAME
         SELECT s_nationkey AS nationkey FROM supplier) GROUP BY 1""",
)
def union_by_name(t: Tables):
    customers = t.customer.select(F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"))
    suppliers = t.supplier.select(F.col("s_nationkey").alias("nationkey"))
    both = customers.unionByName(suppliers, allowMissingColumns=True)
    return both.groupBy("nationkey").agg(F.count("*").alias("n"), F.count("segment").alias("n_segment"))


@query(
    "common_columns",
    """SELECT 'doc_id' AS name, (SELECT count(doc_id) FROM documents) + (SELECT count(doc_id) FROM labels) AS filled""",
)
def common_columns_query(t: Tables):
    shared = common_columns([t.documents, t.labels])
    both = union_common([t.documents, t.labels])
    counts = both.agg(*[F.count(c).alias(c) for c in shared])
    return counts.unpivot([], shared, "name", "filled")


@query(
    "random_split",
    """SELECT o_orderkey, CASE WHEN ('0x' || substr(md5('13|' || o_orderkey), 1, 8))::BIGINT % 10000 < 7000
         THEN 'train' ELSE 'test' END AS part FROM orders""",
)
def random_split(t: Tables):
    train, test = split_rows(t.orders.select("o_orderkey"), ["o_orderkey"], 0.7, seed=13)
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))
