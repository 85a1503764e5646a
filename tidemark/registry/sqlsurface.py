"""Views, SQL text and the session catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.reuse import reused
from tidemark.operators.views import named_views
from tidemark.plans import words as W
from tidemark.plans.drives import failure_rate, most_reliable, reliability
from tidemark.plans.views import plan_text, sql_or_none, temp_view_names
from tidemark.registry import query
from tidemark.registry.rowsets import RATES_SQL
from tidemark.sources.tables import DRIVES_SQL, Tables, drive_days

DRIVES = f"WITH {DRIVES_SQL}"
GROUP_SQL = "SELECT p_size, count(*) AS n FROM part WHERE p_type = 'SMALL' GROUP BY 1"


@query("sql_group", GROUP_SQL)
def sql_group(t: Tables):
    with named_views(part=t.part) as v:
        return t.spark.sql(f"SELECT p_size, count(*) AS n FROM {v.part} WHERE p_type = 'SMALL' GROUP BY p_size")


@query("df_group", GROUP_SQL)
def df_group(t: Tables):
    return t.part.where(F.col("p_type") == "SMALL").groupBy("p_size").count().withColumnRenamed("count", "n")


@query("sql_filter_project", f"{DRIVES} SELECT serial_number, model FROM drives WHERE failure = 1")
def sql_filter_project(t: Tables):
    with named_views(stats=drive_days(t.events)) as v:
        return t.spark.sql(f"SELECT serial_number, model FROM {v.stats} WHERE failure = 1")


@query(
    "sql_view_chain",
    f"""{DRIVES}, days AS (SELECT model, count(*) AS drive_days FROM drives GROUP BY 1)
        SELECT model, drive_days FROM days WHERE drive_days > 500""",
)
def sql_view_chain(t: Tables):
    with named_views(stats=drive_days(t.events)) as v:
        days = f"{v.stats}_days"
        t.spark.sql(f"CREATE OR REPLACE TEMP VIEW {days} AS SELECT model, count(*) AS drive_days FROM {v.stats} GROUP BY model")
        try:
            return t.spark.sql(f"SELECT model, drive_days FROM {days} WHERE drive_days > 500")
        finally:
            t.spark.catalog.dropTempView(days)


RATE_SQL = f"""{DRIVES}, days AS (SELECT model, count(*) AS drive_days FROM drives GROUP BY 1),
  failed AS (SELECT model, count(*) AS failures FROM drives WHERE failure = 1 GROUP BY 1)
  SELECT days.model, round(failures / drive_days, 6) AS failure_rate FROM days JOIN failed ON days.model = failed.model"""


@query(
    "sql_cte",
    """SELECT l_suppkey AS supplier, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 6) AS mean_discount
       FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) GROUP BY 1""",
)
def sql_cte(t: Tables):
    with named_views(sellers=t.supplier, sold=t.lineitem) as v:
        return t.spark.sql(
            f"""
            WITH solvent AS (FROM {v.sellers} |> WHERE s_acctbal >= 0 |> SELECT s_suppkey AS supplier),
                 given AS (SELECT l_suppkey AS supplier, sum(l_extendedprice) AS asked, sum(l_discount * l_extendedprice) AS let_off
                           FROM {v.sold} GROUP BY ALL)
            SELECT supplier, round(let_off / asked, 6) AS mean_discount FROM given LEFT SEMI JOIN solvent USING (supplier)
            """
        )


@query("fn_scope", RATE_SQL)
def fn_scope(t: Tables):
    rates = failure_rate(drive_days(t.events)).orderBy(F.desc("failure_rate"))
    return rates.select("model", F.round("failure_rate", 6).alias("failure_rate"))


@query(
    "catalog_list_drop",
    """SELECT 'inside' AS moment, true AS listed, count(*) AS n FROM part
       UNION ALL SELECT 'after', false, count(*) FROM part""",
)
def catalog_list_drop(t: Tables):
    with named_views(part=t.part) as v:
        inside = v.part in temp_view_names(t.spark)
        counted = t.spark.sql(f"SELECT count(*) AS n FROM {v.part}")
    after = v.part in temp_view_names(t.spark)
    moments = [("inside", inside), ("after", after)]
    return counted.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("moment"), F.lit(x).alias("listed")) for m, x in moments])).alias("e"), "n"
    ).select("e.moment", "e.listed", "n")


@query(
    "sql_missing_view",
    """SELECT 'there' AS place, true AS found, count(*) AS n FROM part UNION ALL SELECT 'gone', false, count(*) FROM part""",
)
def sql_missing_view(t: Tables):
    with named_views(part=t.part) as v:
        text = f"SELECT count(*) AS n FROM {v.part}"
        counted = sql_or_none(t.spark, text)
    places = [("there", counted is not None), ("gone", sql_or_none(t.spark, text) is not None)]
    entries = F.array(*[F.struct(F.lit(p).alias("place"), F.lit(x).alias("found")) for p, x in places])
    return counted.select(F.inline(entries), "n")


@query("fetch", "SELECT count(*) AS n, max(value) AS top, min(value) AS low FROM events")
def fetch(t: Tables):
    # Only the aggregated row comes to the driver.
    facts = t.events.agg(F.count("*").alias("n"), F.max("value").alias("top"), F.min("value").alias("low")).head().asDict()
    return t.spark.createDataFrame([tuple(facts.values())], "n bigint, top double, low double").select(*facts)


@query(
    "cache_reuse",
    f"""{RATES_SQL} SELECT * FROM (SELECT 4.0::DOUBLE AS near, model, capacity_gib, round(rate, 6) AS failure_rate FROM rates
          WHERE capacity_gib BETWEEN 4 / 1.25 AND 4 * 1.25 ORDER BY rate, capacity_gib DESC, model LIMIT 3)
        UNION ALL SELECT * FROM (SELECT 8.0::DOUBLE, model, capacity_gib, round(rate, 6) FROM rates
          WHERE capacity_gib BETWEEN 8 / 1.25 AND 8 * 1.25 ORDER BY rate, capacity_gib DESC, model LIMIT 3)""",
)
def cache_reuse(t: Tables):
    with reused(reliability(drive_days(t.events))) as rates:
        best = [(near, *r) for near in (4.0, 8.0) for r in most_reliable(rates, near, precision=0.25, top_n=3).collect()]  # three rows each
    found = t.spark.createDataFrame(best, "near double, model string, capacity_gib double, failure_rate double")
    return found.withColumn("failure_rate", F.round("failure_rate", 6))


LONG_WORDS_SQL = """(SELECT count(*) FROM (
  SELECT regexp_extract(lower(w), '[a-z'']+', 0) AS word
  FROM (SELECT unnest(string_split_regex(text, '[ \n]')) AS w FROM documents)) WHERE length(word) > 8)"""


@query("plan_text", f"SELECT 'fused' AS form, 1 AS exchanges, {LONG_WORDS_SQL} AS n UNION ALL SELECT 'by word', 2, {LONG_WORDS_SQL}")
def plan_text_query(t: Tables):
    forms = {"fused": W.long_word_lengths(t.documents, "text"), "by word": W.long_word_lengths_by_word(t.documents, "text")}
    parts = [
        df.agg(F.sum("n").alias("n")).select(
            F.lit(form).alias("form"), F.lit(plan_text(df).count("Arguments: hashpartitioning")).alias("exchanges"), "n"
        )
        for form, df in forms.items()
    ]
    return parts[0].union(parts[1])
