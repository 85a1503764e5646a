"""Aggregations, column profiles and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import profile as P
from tidemark.operators.ordered import collect_pages
from tidemark.operators.views import named_views
from tidemark.plans import words as W
from tidemark.plans.airtime import commercial_ratio, commercial_seconds
from tidemark.plans.drives import capacity_drift
from tidemark.registry import query
from tidemark.registry.projections import lined_recipes, tidy_recipes
from tidemark.registry.scans import WORDS_SQL
from tidemark.sources.tables import DRIVES_SQL, RECIPES_SQL, WEATHER_SQL, Tables, drive_days, weather

DRIVES = f"WITH {DRIVES_SQL}"
RECIPES = f"WITH {RECIPES_SQL}"
WEATHER = f"WITH {WEATHER_SQL}"
LETTERS_SQL = """
letters AS (
  SELECT lower(substr(w, 1, 1)) AS letter
  FROM (SELECT unnest(string_split_regex(text, '[ \n]')) AS w FROM documents)
  WHERE regexp_matches(lower(substr(w, 1, 1)), '[a-z]'))
"""


@query("agg_count_by", f"WITH {WORDS_SQL} SELECT word, count(*) AS n FROM words WHERE word <> '' GROUP BY 1")
def agg_count_by(t: Tables):
    return W.word_counts(t.documents, "text")


@query(
    "agg_count_by_expr",
    f"WITH {LETTERS_SQL} SELECT letter IN ('a', 'e', 'i', 'o', 'u') AS is_vowel, count(*) AS n FROM letters GROUP BY 1",
)
def agg_count_by_expr(t: Tables):
    return W.vowel_split(t.documents, "text")


@query(
    "agg_sum_by",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS all_seconds FROM lineitem GROUP BY 1, 2",
)
def agg_sum_by(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("all_seconds"))


@query("agg_sum_short", "SELECT o_orderstatus, sum(o_custkey)::BIGINT AS custkeys FROM orders GROUP BY 1")
def agg_sum_short(t: Tables):
    return t.orders.groupBy("o_orderstatus").sum("o_custkey").withColumnRenamed("sum(o_custkey)", "custkeys")


@query(
    "agg_conditional_sum",
    """SELECT l_shipmonth, sum(CASE WHEN trim(code) IN ('A', 'R') THEN l_quantity ELSE 0 END) AS commercial,
         sum(l_quantity) AS total
       FROM (SELECT strftime(l_shipdate, '%Y-%m') AS l_shipmonth, l_returnflag || '  ' AS code, l_quantity FROM lineitem)
       GROUP BY 1""",
)
def agg_conditional_sum(t: Tables):
    padded = t.lineitem.select(
        F.date_format("l_shipdate", "yyyy-MM").alias("l_shipmonth"), F.rpad("l_returnflag", 3, " ").alias("code"), "l_quantity"
    )
    return padded.groupBy("l_shipmonth").agg(
        F.sum(commercial_seconds(F.col("code"), F.col("l_quantity"), ["A", "R"])).alias("commercial"),
        F.sum("l_quantity").alias("total"),
    )


@query(
    "agg_ratio",
    """SELECT l_linenumber, sum(CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity ELSE 0 END) AS counted_seconds,
         sum(l_quantity) AS all_seconds,
         round(sum(CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS commercial_ratio
       FROM lineitem GROUP BY 1""",
)
def agg_ratio(t: Tables):
    shares = commercial_ratio(t.lineitem, ["l_linenumber"], "l_returnflag", "l_quantity", ["A", "R"])
    return shares.withColumn("commercial_ratio", F.round("commercial_ratio", 6))


MIN_MAX_SQL = f"""{DRIVES} SELECT model, min(capacity_bytes / pow(1024, 3)) AS min_gib, max(capacity_bytes / pow(1024, 3)) AS max_gib
  FROM drives GROUP BY 1 HAVING min(capacity_bytes) <> max(capacity_bytes)"""


@query("agg_min_max_having", MIN_MAX_SQL)
def agg_min_max_having(t: Tables):
    return capacity_drift(drive_days(t.events))


@query(
    "agg_sql_having",
    """SELECT o_custkey AS customer, count(*) AS n_orders, max(o_totalprice) AS dearest FROM orders
       GROUP BY 1 HAVING count(*) >= 8 AND max(o_totalprice) > 2 * min(o_totalprice)""",
)
def agg_sql_having(t: Tables):
    with named_views(bought=t.orders) as v:
        return t.spark.sql(
            f"""
            SELECT o_custkey AS customer, count(*) AS n_orders, max(o_totalprice) AS dearest FROM {v.bought}
            GROUP BY o_custkey HAVING n_orders >= 8 AND dearest > 2 * min(o_totalprice)
            """
        )


@query("agg_count_star", f"{DRIVES} SELECT model, count(*) AS drive_days FROM drives GROUP BY 1")
def agg_count_star(t: Tables):
    return drive_days(t.events).groupBy("model").agg(F.count("*").alias("drive_days"))


@query("agg_count_filtered", f"{DRIVES} SELECT model, count(*) AS failures FROM drives WHERE failure = 1 GROUP BY 1")
def agg_count_filtered(t: Tables):
    return drive_days(t.events).where("failure = 1").groupBy("model").agg(F.expr("count(*) AS failures"))


@query(
    "agg_two_in_one",
    f"{DRIVES} SELECT model, capacity_bytes, count(*) AS drive_days, sum(failure)::BIGINT AS failures FROM drives GROUP BY 1, 2",
)
def agg_two_in_one(t: Tables):
    grouped = drive_days(t.events).groupBy("model", "capacity_bytes")
    return grouped.agg(F.count("*").alias("drive_days"), F.sum("failure").alias("failures"))


@query("agg_avg", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS avg_price FROM orders GROUP BY 1")
def agg_avg(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("avg_price"))


@query("agg_distinct_rows", f"WITH {WORDS_SQL} SELECT count(DISTINCT word) AS distinct_words FROM words WHERE word <> ''")
def agg_distinct_rows(t: Tables):
    return W.vocabulary_size(t.documents, "text")


@query("agg_hapax", f"WITH {WORDS_SQL} SELECT word, count(*) AS n FROM words WHERE word <> '' GROUP BY 1 HAVING count(*) = 1")
def agg_hapax(t: Tables):
    return W.once_only(t.documents, "text")


@query(
    "agg_two_level",
    "SELECT n, count(*) AS n_orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1",
)
def agg_two_level(t: Tables):
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return per_order.groupBy("n").agg(F.count("*").alias("n_orders"))


@query(
    "agg_collect_list",
    """WITH numbered AS (
         SELECT o_custkey, o_orderkey, o_orderpriority,
                (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 8 AS page FROM orders)
       SELECT o_custkey, page, count(*) AS n,
              string_agg(o_orderkey || ':' || o_orderpriority, ' ' ORDER BY o_orderkey) AS orders
       FROM numbered GROUP BY 1, 2""",
)
def agg_collect_list(t: Tables):
    item = F.struct("o_orderkey", "o_orderpriority")
    pages = collect_pages(t.orders, ["o_custkey"], ["o_orderkey"], item, "orders", page_rows=8)
    shown = F.transform("orders", lambda o: F.concat(o["o_orderkey"], F.lit(":"), o["o_orderpriority"]))
    return pages.select(
        "o_custkey", "page", F.size("orders").cast("bigint").alias("n"), F.concat_ws(" ", shown).alias("orders")
    )


@query(
    "agg_collect_set",
    f"""{RECIPES}, melted AS (
          SELECT DISTINCT 'cakeweek' AS "column", cakeweek AS value FROM recipes WHERE cakeweek IS NOT NULL
          UNION ALL SELECT DISTINCT 'wasteless', wasteless FROM recipes WHERE wasteless IS NOT NULL)
        SELECT "column", 0::BIGINT AS page, string_agg(CAST(value::INT AS VARCHAR), ',' ORDER BY value) AS "values" FROM melted GROUP BY 1""",
)
def agg_collect_set(t: Tables):
    sets = P.value_sets(lined_recipes(t), ["cakeweek", "wasteless"])
    shown = F.transform("values", lambda x: x.cast("int").cast("string"))
    return sets.select("column", "page", F.concat_ws(",", shown).alias("values"))


@query(
    "agg_global_map",
    """WITH numbered AS (SELECT p_partkey, p_retailprice, (row_number() OVER (ORDER BY p_partkey) - 1) // 500 AS page FROM part)
       SELECT page, count(*) AS n, max(p_partkey) AS last_key,
              max_by(p_retailprice, p_partkey) AS last_price FROM numbered GROUP BY 1""",
)
def agg_global_map(t: Tables):
    pairs = F.struct("p_partkey", "p_retailprice")
    pages = collect_pages(t.part, [], ["p_partkey"], pairs, "pairs", page_rows=500)
    mapped = pages.select("page", F.map_from_entries("pairs").alias("prices"))
    last = F.array_max(F.map_keys("prices"))
    return mapped.select(
        "page",
        F.size("prices").cast("bigint").alias("n"),
        last.alias("last_key"),
        F.try_element_at("prices", last).alias("last_price"),
    )


BINARIES = ["cakeweek", "wasteless", "clove", "rare_herb", "quick_22_meals", "appetite_and_more"]


@query(
    "profile_binary",
    RECIPES
    + " UNION ALL ".join(
        f" SELECT '{c}' AS \"column\", count(DISTINCT {c}) = 2 AS is_binary FROM recipes" for c in BINARIES
    ),
)
def profile_binary(t: Tables):
    return P.binary_columns(tidy_recipes(t), BINARIES)


MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


def facts_sql(c: str, more: str = "") -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev,
               min({c}) AS min, max({c}) AS max{more} FROM lineitem"""


def rounded(df, names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("profile_describe", " UNION ALL ".join(facts_sql(c) for c in MEASURES))
def profile_describe(t: Tables):
    return rounded(P.describe(t.lineitem, MEASURES), ["mean", "stddev"])


def quantile_sql(c: str, shares: dict[str, float]) -> str:
    return ", ".join(f"round(quantile_cont({c}, {s}), 4) AS {n}" for n, s in shares.items())


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


@query("profile_summary", " UNION ALL ".join(facts_sql(c, ", " + quantile_sql(c, QUARTILES)) for c in MEASURES))
def profile_summary(t: Tables):
    return rounded(P.summary(t.lineitem, MEASURES), ["mean", "stddev", *QUARTILES])


SHARES = {"p1": 0.01, "p5": 0.05, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query(
    "profile_percentiles",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {quantile_sql(c, SHARES)} FROM lineitem" for c in MEASURES),
)
def profile_percentiles(t: Tables):
    return rounded(P.percentiles(t.lineitem, MEASURES, SHARES), SHARES)


@query(
    "profile_percentiles_approx",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{n}' AS share, count({c}) AS n, true AS within FROM lineitem" for c in MEASURES for n in SHARES),
)
def profile_percentiles_approx(t: Tables):
    """The sketched percentiles, each with whether its rank is as near as the sketch promises."""
    accuracy = 10_000
    found = {r["column"]: r for r in P.approximate_percentiles(t.lineitem, MEASURES, SHARES, accuracy).collect()}

    def check(c, name, share):
        x, n = F.col(c).cast("double"), F.count(c)
        below, upto = F.count_if(x < found[c][name]), F.count_if(x <= found[c][name])
        slack = n / accuracy + 1
        return F.struct(F.lit(c).alias("column"), F.lit(name).alias("share"), n.alias("n"), ((below <= share * n + slack) & (upto >= share * n - slack)).alias("within"))

    return t.lineitem.agg(F.array(*[check(c, n, s) for c in MEASURES for n, s in SHARES.items()]).alias("checks")).selectExpr("inline(checks)")


@query("profile_column_sums", RECIPES + " SELECT " + ", ".join(f"sum({c}) AS {c}" for c in BINARIES) + ", count(*) AS _rows FROM recipes")
def profile_column_sums(t: Tables):
    return P.column_sums(tidy_recipes(t), BINARIES)


@query(
    "rare_columns",
    RECIPES
    + "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", sum({c}) AS total, count(*) AS n FROM recipes GROUP BY () " for c in BINARIES)
    + ") WHERE total < 10 OR total > n - 10",
)
def rare_columns(t: Tables):
    frame = tidy_recipes(t)
    return P.rare_columns(frame, BINARIES).withColumn("n", frame.agg(F.count("*")).scalar())


@query(
    "pivot_count",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
         count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
)
def pivot_count(t: Tables):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()


@query(
    "agg_mean_stddev",
    "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev FROM events GROUP BY 1",
)
def agg_mean_stddev(t: Tables):
    return t.events.groupBy("event_type").agg(
        F.round(F.mean("value"), 6).alias("mean"), F.round(F.stddev("value"), 6).alias("stddev")
    )


@query(
    "agg_regression_slope",
    f"""{WEATHER} SELECT stn, year, mo, round(regr_slope(temp, CAST(da AS INT)), 6) AS slope FROM weather
        GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def agg_regression_slope(t: Tables):
    fit = weather(t.events).groupBy("stn", "year", "mo").agg(
        F.round(F.regr_slope("temp", F.col("da").cast("int")), 6).alias("slope"), F.count("*").alias("n")
    )
    return fit.where("n > 1").drop("n")


@query(
    "agg_regression_fit",
    f"""{WEATHER} SELECT stn, year, mo, round(regr_slope(temp, CAST(da AS INT)), 6) AS slope,
          round(regr_intercept(temp, CAST(da AS INT)), 6) AS intercept FROM weather GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def agg_regression_fit(t: Tables):
    day = F.col("da").cast("int")
    fit = F.array(F.regr_slope("temp", day), F.regr_intercept("temp", day))
    fitted = weather(t.events).groupBy("stn", "year", "mo").agg(fit.alias("fit"), F.count("*").alias("n")).where("n > 1")
    return fitted.select("stn", "year", "mo", F.round(F.col("fit")[0], 6).alias("slope"), F.round(F.col("fit")[1], 6).alias("intercept"))
