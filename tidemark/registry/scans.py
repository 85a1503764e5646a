"""Scans, literal rows and sinks. Files are written from the tables first, then read back."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import words
from tidemark.operators.columns import filled_counts
from tidemark.operators.ordered import collect_pages
from tidemark.registry import query
from tidemark.sources import files
from tidemark.sources.json_arrays import read_json_arrays
from tidemark.sources.tables import SHOWS_SQL, Tables, shows
from tidemark.storage import new_folder

LINES_SQL = "SELECT unnest(string_split(text, chr(10))) AS value FROM documents"


@query("scan_text", LINES_SQL)
def scan_text(t: Tables):
    path = new_folder(t.spark, "text")
    t.documents.select("text").write.text(path)
    return t.spark.read.text(path)


@query(
    "scan_text_glob",
    """SELECT value, count(*) AS n FROM (
         SELECT unnest(string_split(text, chr(10))) AS value FROM documents
         UNION ALL SELECT unnest(string_split(text, chr(10))) FROM conversations) GROUP BY 1""",
)
def scan_text_glob(t: Tables):
    path = new_folder(t.spark, "texts")
    t.documents.select("text").write.text(f"{path}/documents")
    t.conversations.select("text").write.text(f"{path}/conversations")
    return t.spark.read.text(f"{path}/*/part-*.txt").groupBy("value").agg(F.count("*").alias("n"))


def _order_files(t: Tables, label: str, **options: str) -> str:
    frame = t.orders.select(
        "o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority"
    )
    return files.write_csv(frame, new_folder(t.spark, label), options=options)


@query(
    "scan_csv_delimited",
    """SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y%m%d') AS day, o_orderpriority
       FROM orders""",
)
def scan_csv_delimited(t: Tables):
    path = _order_files(t, "csv", sep="|")
    read = files.read_csv(t.spark, path, sep="|", infer=True, date_format="yyyy-MM-dd")
    return read.withColumn("day", F.date_format("o_orderdate", "yyyyMMdd")).drop("o_orderdate")


@query("scan_csv_quote", "SELECT p_partkey, p_name || ',' || p_brand AS label, p_size FROM part")
def scan_csv_quote(t: Tables):
    frame = t.part.select("p_partkey", F.concat_ws(",", "p_name", "p_brand").alias("label"), "p_size")
    path = files.write_csv(frame, new_folder(t.spark, "quoted"), options={"quote": "$"})
    return files.read_csv(t.spark, path, quote="$", infer=True)


@query(
    "scan_csv_raw",
    """SELECT s_suppkey || '|' || s_name || '|' || s_nationkey AS "s_suppkey|s_name|s_nationkey" FROM supplier""",
)
def scan_csv_raw(t: Tables):
    path = files.write_csv(
        t.supplier.select("s_suppkey", "s_name", "s_nationkey"), new_folder(t.spark, "raw"), options={"sep": "|"}
    )
    return files.read_csv(t.spark, path)


@query(
    "scan_csv_dir",
    """SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, max(value) AS top FROM events GROUP BY 1""",
)
def scan_csv_dir(t: Tables):
    path = new_folder(t.spark, "dir")
    t.events.select("event_id", "event_type", "value").write.option("header", True).option(
        "maxRecordsPerFile", 1_000_000
    ).csv(path)
    read = files.read_csv(t.spark, path, schema="event_id bigint, event_type string, value double")
    return read.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.max("value").alias("top")
    )


@query("scan_jsonl", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def scan_jsonl(t: Tables):
    path = new_folder(t.spark, "jsonl")
    t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.json(path)
    return files.read_json(t.spark, path)


@query("scan_json_multiline", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def scan_json_multiline(t: Tables):
    path = new_folder(t.spark, "json-files")
    document = F.struct("o_orderkey", "o_totalprice", "o_orderpriority")
    pages = collect_pages(t.orders, ["o_orderpriority"], ["o_orderkey"], document, page_rows=100_000)
    # One page becomes one file that holds a JSON array over many lines.
    pages.select(F.to_json("items", {"pretty": "true"})).write.option("maxRecordsPerFile", 1).text(path)
    return files.read_json(t.spark, f"{path}/*.txt", whole_files=True)


@query("scan_json_array_parallel", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def scan_json_array_parallel(t: Tables):
    path = new_folder(t.spark, "json-arrays")
    document = F.struct("o_orderkey", "o_totalprice", "o_orderpriority")
    pages = collect_pages(t.orders, ["o_orderpriority"], ["o_orderkey"], document, page_rows=100_000)
    pages.select(F.to_json("items", {"pretty": "true"})).write.option("maxRecordsPerFile", 1).text(path)
    return read_json_arrays(t.spark, f"{path}/*.txt", t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority").schema)


EPISODE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("on_day", T.DateType()),
        T.StructField("sent_at", T.TimestampType()),
        T.StructField("runtime", T.LongType()),
    ]
)
SHOW = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("genres", T.ArrayType(T.StringType())),
        T.StructField("document", T.StructType([T.StructField("lines", T.ArrayType(EPISODE))])),
    ]
)


@query(
    "scan_json_strict",
    f"""WITH {SHOWS_SQL}
       SELECT id, ep_id, ep_name, strftime(on_day, '%Y%m%d') AS on_day,
              datediff('day', DATE '1970-01-01', on_day) * 86400 + 73800 AS aired_at, runtime FROM episodes""",
)
def scan_json_strict(t: Tables):
    path = new_folder(t.spark, "shows")
    shows(t.documents).write.json(path)
    read = files.read_json(t.spark, path, schema=SHOW, strict=True)
    return read.select("id", F.explode("document.lines").alias("e")).select(
        "id",
        F.col("e.id").alias("ep_id"),
        F.col("e.name").alias("ep_name"),
        F.date_format("e.on_day", "yyyyMMdd").alias("on_day"),
        F.unix_timestamp("e.sent_at").alias("aired_at"),
        F.col("e.runtime").alias("runtime"),
    )


@query("parse_json_strings", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json_strings(t: Tables):
    return files.parse_json_column(t.events, "props").select("event_id", "parsed.k")


@query("scan_parquet", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2")
def scan_parquet(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(
    "scan_parquet_years",
    """SELECT year(o_orderdate) AS year, count(*) AS n, count(o_orderpriority) FILTER (o_orderdate >= DATE '1998-01-01')
         AS n_priority FROM orders GROUP BY 1""",
)
def scan_parquet_years(t: Tables):
    path = new_folder(t.spark, "years")
    late = F.year("o_orderdate") >= 1998
    t.orders.where(~late).select("o_orderkey", "o_orderdate").write.parquet(f"{path}/early")
    t.orders.where(late).select("o_orderdate", "o_orderpriority", "o_orderkey").write.parquet(f"{path}/late")
    read = files.read_parquet_drifting(t.spark, [f"{path}/early", f"{path}/late"])
    return read.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("n"), F.count("o_orderpriority").alias("n_priority")
    )


@query(
    "rows_literal",
    """SELECT item, price, count(*) AS n, sum(p_size)::BIGINT AS sizes
       FROM part JOIN (VALUES ('PROMO', 1.74::DOUBLE), ('SMALL', 2.04::DOUBLE), ('LARGE', 1.09::DOUBLE)) v(item, price) ON p_type = item
       GROUP BY 1, 2""",
)
def rows_literal(t: Tables):
    prices = files.literal_rows(t.spark, [["PROMO", 1.74], ["SMALL", 2.04], ["LARGE", 1.09]], ["item", "price"])
    counted = t.part.groupBy("p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))
    return counted.join(F.broadcast(prices), F.col("p_type") == F.col("item")).drop("p_type")


@query(
    "rows_typed",
    """SELECT kind, level, count(*) AS n FROM events
       JOIN (VALUES ('click', 1), ('click', 2), ('error', 3)) v(kind, level) ON event_type = kind GROUP BY 1, 2""",
)
def rows_typed(t: Tables):
    schema = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("levels", T.ArrayType(T.IntegerType()))]
    )
    rows = [{"kind": "click", "levels": [1, 2]}, {"kind": "error", "levels": [3]}]
    levels = files.literal_rows(t.spark, rows, schema).select("kind", F.explode("levels").alias("level"))
    counted = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(levels), F.col("event_type") == F.col("kind")).drop("event_type")


WORDS_SQL = """
words AS (
  SELECT regexp_extract(lower(w), '[a-z]*', 0) AS word
  FROM (SELECT unnest(string_split_regex(text, '[ \n]')) AS w FROM documents))
"""


@query("rows_scalar", f"WITH {WORDS_SQL} SELECT count(DISTINCT word)::INT AS distinct_words FROM words WHERE word <> ''")
def rows_scalar(t: Tables):
    return files.scalar_row(t.spark, words(t.documents, "text").distinct().count(), "distinct_words")


@query(
    "rows_pandas",
    """SELECT seg, code, count(*) AS n FROM customer
       JOIN (VALUES ('BUILDING', 1), ('MACHINERY', 2)) v(seg, code) ON c_mktsegment = seg GROUP BY 1, 2""",
)
def rows_pandas(t: Tables):
    codes = t.spark.createDataFrame(pd.DataFrame({"seg": ["BUILDING", "MACHINERY"], "code": [1, 2]}))
    counted = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(codes), F.col("c_mktsegment") == F.col("seg")).drop("c_mktsegment")


@query("sink_csv", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def sink_csv(t: Tables):
    report = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    path = files.write_csv(report, new_folder(t.spark, "report"))
    return files.read_csv(t.spark, path, schema="o_orderpriority string, o_orderstatus string, n bigint")


@query("sink_csv_overwrite", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def sink_csv_overwrite(t: Tables):
    path = new_folder(t.spark, "report")
    files.write_csv(t.documents.groupBy("source").agg(F.count("*").alias("n")), path, one_file=True)
    report = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    files.write_csv(report, path, overwrite=True, one_file=True)
    return files.read_csv(t.spark, path, schema="lang string, n bigint")


@query("preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def preview(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(10)


@query(
    "schema_roundtrip",
    """SELECT 'doc_id' AS name, 'bigint' AS type, true AS nullable, count(doc_id) AS filled FROM labels
       UNION ALL SELECT 'quality', 'int', true, count(quality) FROM labels
       UNION ALL SELECT 'toxic', 'int', true, count(toxic) FROM labels""",
)
def schema_roundtrip(t: Tables):
    schema = T.StructType.fromJson(json.loads(t.labels.schema.json()))
    if schema != t.labels.schema:
        raise ValueError("schema changed on the way through JSON")
    return filled_counts(t.spark.read.schema(schema).parquet(f"{t.folder}/labels.parquet"))


@query(
    "describe_schema",
    """SELECT 'o_orderkey' AS name, 'bigint' AS type, true AS nullable, count(o_orderkey) AS filled FROM orders
       UNION ALL SELECT 'o_custkey', 'bigint', true, count(o_custkey) FROM orders
       UNION ALL SELECT 'o_orderstatus', 'string', true, count(o_orderstatus) FROM orders
       UNION ALL SELECT 'o_totalprice', 'double', true, count(o_totalprice) FROM orders
       UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', true, count(o_orderdate) FROM orders
       UNION ALL SELECT 'o_orderpriority', 'string', true, count(o_orderpriority) FROM orders""",
)
def describe_schema(t: Tables):
    return filled_counts(t.orders)
