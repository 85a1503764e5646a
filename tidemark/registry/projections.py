"""Projections, filters, predicates and null handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.dates import hms_part, hms_seconds
from tidemark.operators import columns as C
from tidemark.registry import query
from tidemark.sources.tables import RECIPES_SQL, SHOWS_SQL, WEATHER_SQL, Tables, recipes, shows, weather

RECIPES = f"WITH {RECIPES_SQL}"
WEATHER = f"WITH {WEATHER_SQL}"


def tidy_recipes(t: Tables):
    return C.with_tidy_names(recipes(t.customer, t.orders))


def lined_recipes(t: Tables):
    return tidy_recipes(t).select("title", "cakeweek", "wasteless", "clove", "dessert")


@query("project_columns", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def project_columns(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")


@query("project_alias", "SELECT doc_id, length(text) AS n_letters FROM documents")
def project_alias(t: Tables):
    return t.documents.select("doc_id", F.length("text").alias("n_letters"))


@query("rename_column", "SELECT doc_id AS document, lang FROM documents")
def rename_column(t: Tables):
    return t.documents.select("doc_id", "lang").withColumnRenamed("doc_id", "document")


@query("project_expr", "SELECT p_partkey, p_size / pow(1024, 3) AS size_gib, p_brand FROM part")
def project_expr(t: Tables):
    return t.part.selectExpr("p_partkey", "(p_size / pow(1024, 3)) AS size_gib", "p_brand")


def clock(t: Tables):
    return t.events.select("event_id", F.date_format("ts", "HH:mm:ss").alias("duration"))


@query(
    "add_column",
    """SELECT event_id, strftime(ts, '%H:%M:%S') AS duration,
         (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT AS duration_seconds FROM events""",
)
def add_column(t: Tables):
    return clock(t).withColumn("duration_seconds", hms_seconds(F.col("duration")))


@query("drop_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def drop_columns(t: Tables):
    return t.orders.drop("o_custkey", "o_orderdate", "o_orderpriority")


@query("rename_all_lower", "SELECT n_nationkey AS nationid, n_name AS name, n_regionkey AS regionid FROM nation")
def rename_all_lower(t: Tables):
    return C.with_lower_names(t.nation.toDF("NationID", "Name", "RegionID"))


@query(
    "rename_all_sanitize",
    f"{RECIPES} SELECT title, rare_herb, quick_22_meals, appetite_and_more FROM recipes",
)
def rename_all_sanitize(t: Tables):
    return tidy_recipes(t).select("title", "rare_herb", "quick_22_meals", "appetite_and_more")


@query("order_columns", "SELECT p_brand, p_name, p_partkey, p_retailprice, p_size, p_type FROM part")
def order_columns(t: Tables):
    return C.in_name_order(t.part)


@query("project_by_suffix", "SELECT o_orderstatus, o_totalprice, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def project_by_suffix(t: Tables):
    kept = C.without_suffix(t.orders.drop("o_orderdate"), "key")
    return kept.groupBy(*kept.columns).agg(F.count("*").alias("n"))


@query(
    "project_chunks",
    """SELECT 0 AS chunk, 'l_orderkey,l_partkey,l_suppkey,l_linenumber' AS names, count(*) AS filled FROM lineitem
       UNION ALL SELECT 1, 'l_quantity,l_extendedprice,l_discount,l_tax', count(*) FROM lineitem
       UNION ALL SELECT 2, 'l_returnflag,l_linestatus,l_shipdate', count(*) FROM lineitem""",
)
def project_chunks(t: Tables):
    chunks = C.column_chunks(t.lineitem)
    filled = t.lineitem.agg(
        *[F.count(F.when(F.coalesce(*[F.col(c).isNotNull() for c in names]), 1)).alias(str(i)) for i, names in enumerate(chunks)]
    )
    labels = t.spark.createDataFrame([(i, ",".join(names)) for i, names in enumerate(chunks)], "chunk int, names string")
    rows = C.columns_as_rows(filled, "place", "filled")
    return labels.join(rows, F.col("chunk") == F.col("place").cast("int")).drop("place")


@query(
    "cast_by_prefix",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS smart_raw, NULL::BIGINT AS smart_bad, event_type FROM events""",
)
def cast_by_prefix(t: Tables):
    frame = t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").alias("smart_raw"),
        F.col("event_type").alias("smart_bad"),
        "event_type",
    )
    return C.cast_by_prefix(frame, "smart", "bigint")


@query(
    "nested_field",
    f"""WITH {SHOWS_SQL} SELECT id, count(*) AS n_names, sum(runtime)::BIGINT AS runtime FROM episodes GROUP BY 1""",
)
def nested_field(t: Tables):
    picked = shows(t.documents).select("id", F.col("document.lines.name").alias("names"), "document.lines.runtime")
    total = F.aggregate("runtime", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return picked.select("id", F.size("names").cast("bigint").alias("n_names"), total.alias("runtime"))


@query("filter_column", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'view' AND value > 40")
def filter_column(t: Tables):
    return t.events.where((F.col("event_type") != "view") & (F.col("value") > 40)).select("event_id", "event_type", "value")


@query("filter_sql", "SELECT title, wasteless, cakeweek FROM (" + RECIPES + " FROM recipes) WHERE cakeweek > 1.0 OR wasteless > 1.0")
def filter_sql(t: Tables):
    return lined_recipes(t).where("cakeweek > 1.0 or wasteless > 1.0").select("title", "wasteless", "cakeweek")


@query("filter_in", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view', 'error')")
def filter_in(t: Tables):
    return t.events.where(~F.col("event_type").isin("click", "view", "error")).select("event_id", "event_type")


@query("filter_regex", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m].* [r-z]')")
def filter_regex(t: Tables):
    return t.part.where(F.col("p_name").rlike("^[a-m].* [r-z]")).select("p_partkey", "p_name")


@query("filter_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
def filter_between(t: Tables):
    return t.orders.where("o_totalprice between 100000 and 200000").select("o_orderkey", "o_totalprice")


@query("filter_null", RECIPES + " SELECT title, dessert FROM recipes WHERE clove IS NULL AND dessert IS NOT NULL")
def filter_null(t: Tables):
    return lined_recipes(t).where(F.isnull("clove") & F.col("dessert").isNotNull()).select("title", "dessert")


@query(
    "filter_compound",
    RECIPES
    + """ SELECT title FROM recipes WHERE (cakeweek IN (0.0, 1.0) OR cakeweek IS NULL)
          AND (wasteless IN (0.0, 1.0) OR wasteless IS NULL)""",
)
def filter_compound(t: Tables):
    fits = [F.col(c).isin(0.0, 1.0) | F.col(c).isNull() for c in ("cakeweek", "wasteless")]
    return lined_recipes(t).where(fits[0] & fits[1]).select("title")


@query("filter_on_dropped", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 5000")
def filter_on_dropped(t: Tables):
    suppliers = t.supplier
    return suppliers.select("s_suppkey", "s_name").where(suppliers["s_acctbal"] > 5000)


@query("drop_null_rows", RECIPES + " SELECT title, clove, dessert FROM recipes WHERE clove IS NOT NULL AND dessert IS NOT NULL")
def drop_null_rows(t: Tables):
    return lined_recipes(t).dropna(subset=["clove", "dessert"]).select("title", "clove", "dessert")


@query(
    "drop_all_null_rows",
    RECIPES + " SELECT title FROM recipes WHERE cakeweek IS NOT NULL OR clove IS NOT NULL",
)
def drop_all_null_rows(t: Tables):
    return lined_recipes(t).dropna(how="all", subset=["cakeweek", "clove"]).select("title")


@query(
    "fill_null",
    RECIPES + " SELECT title, coalesce(cakeweek, 0.0) AS cakeweek, coalesce(clove, 0.0) AS clove, wasteless FROM recipes",
)
def fill_null(t: Tables):
    return lined_recipes(t).fillna(0.0, subset=["cakeweek", "clove"]).drop("dessert")


@query(
    "null_sentinel",
    WEATHER + " SELECT stn, year, mo, da, CASE WHEN temp > 200 THEN 9999.9::DOUBLE ELSE temp END AS reading FROM weather WHERE temp <= 200",
)
def null_sentinel(t: Tables):
    readings = weather(t.events).withColumn("reading", F.when(F.col("temp") > 200, 9999.9).otherwise(F.col("temp")))
    return readings.where(F.col("reading") != 9999.9).select("stn", "year", "mo", "da", "reading")


@query("domain_check", RECIPES + " SELECT title, cakeweek FROM recipes WHERE cakeweek NOT IN (0.0, 1.0)")
def domain_check(t: Tables):
    return lined_recipes(t).where(~F.col("cakeweek").isin(0.0, 1.0)).select("title", "cakeweek")


@query(
    "distinct_rows",
    """SELECT DISTINCT strftime(ts, '%H:%M:%S') AS duration, hour(ts)::INT AS dur_hours, minute(ts)::INT AS minutes,
         second(ts)::INT AS dur_seconds FROM events""",
)
def distinct_rows(t: Tables):
    duration = F.col("duration")
    return (
        clock(t)
        .select(
            duration,
            hms_part(duration, 1).alias("dur_hours"),
            hms_part(duration, 4).alias("minutes"),
            hms_part(duration, 7).alias("dur_seconds"),
        )
        .distinct()
    )
