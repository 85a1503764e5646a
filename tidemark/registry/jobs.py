"""The composite questions, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.features import evaluate as E
from tidemark.features.prepare import prepare, vector_columns
from tidemark.operators.reuse import reused
from tidemark.plans import airtime as A
from tidemark.plans import drives as D
from tidemark.plans import recipes as R
from tidemark.plans import words as W
from tidemark.plans.shows import episodes, show_spans
from tidemark.plans.weather import coldest_by_semi_join
from tidemark.registry import query
from tidemark.registry.aggregates import LETTERS_SQL
from tidemark.registry.features import AREA_SQL, CUSTOM_SQL, LABEL_RATES_SQL, PLAIN_SQL, STEPS_SQL, custom_rows
from tidemark.registry.rowsets import RATES_SQL
from tidemark.registry.scans import WORDS_SQL
from tidemark.storage import settled
from tidemark.sources.tables import DRIVES_SQL, RECIPES_SQL, SHOWS_SQL, WEATHER_SQL, Tables, drive_days, recipes, shows, weather

DRIVES = f"WITH {DRIVES_SQL}"
WORDS = f"WITH {WORDS_SQL}"

# ---- words --------------------------------------------------------------------------------


@query("job_word_count", f"{WORDS} SELECT word, count(*) AS n FROM words WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 10")
def job_word_count(t: Tables):
    return W.most_frequent(W.word_counts(t.documents, "text"), "word", 10)


@query("job_distinct_words", f"{WORDS} SELECT count(DISTINCT word) AS distinct_words FROM words WHERE word <> ''")
def job_distinct_words(t: Tables):
    return W.vocabulary_size(t.documents, "text")


@query("job_first_letter", f"WITH {LETTERS_SQL} SELECT letter, count(*) AS n FROM letters GROUP BY 1 ORDER BY n DESC, letter LIMIT 5")
def job_first_letter(t: Tables):
    return W.most_frequent(W.letter_counts(t.documents, "text"), "letter", 5)


@query("job_vowel_split", f"WITH {LETTERS_SQL} SELECT letter IN ('a', 'e', 'i', 'o', 'u') AS is_vowel, count(*) AS n FROM letters GROUP BY 1")
def job_vowel_split(t: Tables):
    return W.vowel_split(t.documents, "text")


@query(
    "job_word_length",
    """SELECT length(word)::INT AS word_length, count(*) AS n FROM (
         SELECT regexp_extract(lower(w), '[a-z'']+', 0) AS word
         FROM (SELECT unnest(string_split_regex(text, '[ \n]')) AS w FROM documents)) WHERE length(word) > 8 GROUP BY 1""",
)
def job_word_length(t: Tables):
    return W.long_word_lengths(t.documents, "text")


# ---- airtime ------------------------------------------------------------------------------
# A log row is a line item: the service is its supplier, the class its part's type, the category
# its supplier's nation, the channel its supplier's name. One class stands for the partly
# counted one.

CODES = ["PROMO", "ECONOMY", "SMALL"]
PARTIAL = "PROMO"


def log(t: Tables):
    return t.lineitem.select(
        F.col("l_suppkey").alias("service_id"),
        F.col("l_partkey").alias("class_id"),
        F.col("l_quantity").cast("bigint").alias("seconds"),
    )


def services(t: Tables):
    primary = t.supplier.where("s_acctbal > 0")
    return primary.select(
        F.col("s_suppkey").alias("service_id"), F.col("s_name").alias("channel"), F.col("s_nationkey").alias("category_id")
    )


def classes(t: Tables):
    known = t.part.where("p_size > 1")
    return known.select(F.col("p_partkey").alias("class_id"), F.rpad("p_type", 10, " ").alias("class_code"))


def categories(t: Tables):
    return t.nation.select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("category"))


def joined_log(t: Tables):
    return A.full_log(log(t), services(t), categories(t), classes(t))


LOG_SQL = """
log AS (SELECT s_name AS channel, l_suppkey AS service_id, n_name AS category, p_type AS class_code, l_quantity::BIGINT AS seconds
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN part ON l_partkey = p_partkey AND p_size > 1),
signed AS (SELECT log.*, n_nationkey AS sign_id, n_name AS sign FROM log JOIN nation ON service_id % 40 = n_nationkey)
"""


def ratio_sql(keys: str, special: bool = False) -> str:
    whole = "('ECONOMY', 'SMALL')" if special else "('PROMO', 'ECONOMY', 'SMALL')"
    part = "WHEN class_code = 'PROMO' THEN seconds * 0.75::DOUBLE" if special else ""
    zero, kind = ("0.0::DOUBLE", "DOUBLE") if special else ("0", "BIGINT")
    commercial = f"sum(CASE WHEN class_code IN {whole} THEN seconds {part} ELSE {zero} END)"
    return f"""SELECT {keys}, {commercial}::{kind} AS counted_seconds, sum(seconds)::BIGINT AS all_seconds,
      {commercial} / sum(seconds) AS exact_ratio FROM {'signed' if 'sign' in keys else 'log'} GROUP BY {keys}"""


@query(
    "job_commercial_ratio",
    f"""WITH {LOG_SQL}, totals AS ({ratio_sql('class_code, category')})
        SELECT coalesce(class_code, 'none') AS class_code, category, counted_seconds, all_seconds,
               round(exact_ratio, 6) AS commercial_ratio FROM totals""",
)
def job_commercial_ratio(t: Tables):
    ratios = A.commercial_ratio(joined_log(t), ["class_code", "category"], "class_code", "seconds", CODES)
    known = ratios.dropna(subset=["commercial_ratio"]).fillna(0)
    return known.select(
        F.coalesce(F.trim("class_code"), F.lit("none")).alias("class_code"),
        "category",
        "counted_seconds",
        "all_seconds",
        F.round("commercial_ratio", 6).alias("commercial_ratio"),
    ).orderBy("commercial_ratio", ascending=False)


def call_signs(t: Tables):
    """Names by identifier: a table of its own, with identifiers that no service has, and without some."""
    return t.nation.select(F.col("n_nationkey").alias("sign_id"), F.col("n_name").alias("sign"))


def channel_ratios(t: Tables, partial=None):
    signed = joined_log(t).withColumn("sign_id", (F.col("service_id") % 40).cast("int")).join(call_signs(t), "sign_id")
    return A.commercial_ratio(signed, ["sign_id", "sign"], "class_code", "seconds", CODES, partial).fillna(0)


@query(
    "job_channel_ratio",
    f"""WITH {LOG_SQL}, totals AS ({ratio_sql('sign_id, sign')})
        SELECT sign_id, sign, counted_seconds, all_seconds, round(exact_ratio, 6) AS commercial_ratio FROM totals""",
)
def job_channel_ratio(t: Tables):
    return channel_ratios(t).withColumn("commercial_ratio", F.round("commercial_ratio", 6))


@query(
    "job_channel_ratio_weighted",
    f"""WITH {LOG_SQL}, totals AS ({ratio_sql('sign_id, sign', special=True)})
        SELECT sign_id, sign, counted_seconds, all_seconds, round(exact_ratio, 6) AS commercial_ratio FROM totals""",
)
def job_channel_ratio_weighted(t: Tables):
    return channel_ratios(t, PARTIAL).withColumn("commercial_ratio", F.round("commercial_ratio", 6))


@query(
    "job_ratio_histogram",
    f"""WITH {LOG_SQL}, totals AS ({ratio_sql('sign_id, sign', special=True)})
        SELECT round(exact_ratio, 1) AS commercial_ratio, count(*) AS n_signs FROM totals GROUP BY 1""",
)
def job_ratio_histogram(t: Tables):
    return A.ratio_histogram(channel_ratios(t, PARTIAL))


# ---- shows --------------------------------------------------------------------------------


@query(
    "job_show_span",
    f"""WITH {SHOWS_SQL} SELECT id, show_name AS name, (datediff('day', min(on_day), max(on_day)) * 86400)::BIGINT AS duration_seconds
        FROM episodes GROUP BY 1, 2""",
)
def job_show_span(t: Tables):
    return show_spans(shows(t.documents)).orderBy("duration_seconds", ascending=False)


@query(
    "job_episode_roundtrip",
    f"""WITH {SHOWS_SQL} SELECT id, count(*) AS n, sum(runtime)::BIGINT AS runtime, min(ep_id)::BIGINT AS first_id,
          string_agg(ep_name, '|' ORDER BY ep_id) AS names FROM episodes GROUP BY 1""",
)
def job_episode_roundtrip(t: Tables):
    each = episodes(shows(t.documents))
    # The episodes of a show come out of one cell, so they fit into one again.
    gathered = each.groupBy("id").agg(F.sort_array(F.collect_list("episode")).alias("episodes"))
    return gathered.select(
        "id",
        F.size("episodes").cast("bigint").alias("n"),
        F.aggregate("episodes", F.lit(0).cast("bigint"), lambda a, e: a + e["runtime"]).alias("runtime"),
        F.get("episodes", F.lit(0))["id"].cast("bigint").alias("first_id"),
        F.concat_ws("|", "episodes.name").alias("names"),
    )


# ---- drives -------------------------------------------------------------------------------


@query("job_liquid_elements", "SELECT p_size AS period, count(*) AS n FROM part WHERE p_type = 'PROMO' GROUP BY 1")
def job_liquid_elements(t: Tables):
    return t.part.where(F.col("p_type") == "PROMO").groupBy(F.col("p_size").alias("period")).agg(F.count("*").alias("n"))


@query(
    "job_capacity_drift",
    f"""{DRIVES} SELECT model, min(capacity_bytes) / pow(1024, 3) AS min_gib, max(capacity_bytes) / pow(1024, 3) AS max_gib FROM drives
        GROUP BY 1 HAVING min(capacity_bytes) <> max(capacity_bytes)""",
)
def job_capacity_drift(t: Tables):
    return D.capacity_drift(drive_days(t.events)).orderBy("max_gib", ascending=False)


@query(
    "job_failure_rate",
    f"""{DRIVES} SELECT model, count(*) AS drive_days, sum(failure)::BIGINT AS failures, round(sum(failure) / count(*), 6) AS failure_rate
        FROM drives GROUP BY 1 HAVING sum(failure) > 0""",
)
def job_failure_rate(t: Tables):
    rates = D.failure_rate(drive_days(t.events)).withColumn("failure_rate", F.round("failure_rate", 6))
    return rates.orderBy("failure_rate", ascending=False)


@query(
    "job_reliable_drives",
    f"""{RATES_SQL} SELECT * FROM (SELECT 'small' AS band, model, capacity_gib, round(rate, 6) AS failure_rate FROM rates
          WHERE capacity_gib BETWEEN 4 / 1.25 AND 4 * 1.25 ORDER BY rate, capacity_gib DESC, model LIMIT 3)
        UNION ALL SELECT * FROM (SELECT 'large', model, capacity_gib, round(rate, 6) FROM rates
          WHERE capacity_gib BETWEEN 16 / 1.25 AND 16 * 1.25 ORDER BY rate, capacity_gib DESC, model LIMIT 3)""",
)
def job_reliable_drives(t: Tables):
    rates = settled(D.reliability(drive_days(t.events)))  # one pass over the drive days for both bands
    bands = [
        D.most_reliable(rates, capacity, precision=0.25, top_n=3).withColumn("band", F.lit(band)) for band, capacity in (("small", 4.0), ("large", 16.0))
    ]
    return bands[0].union(bands[1]).withColumn("failure_rate", F.round("failure_rate", 6))


@query(
    "job_drive_age",
    f"""{DRIVES}, lives AS (SELECT serial_number, model, capacity_bytes, datediff('day', min(date), max(date)) AS age FROM drives GROUP BY 1, 2, 3)
        SELECT model, capacity_bytes / pow(1024, 3) AS capacity_gib, round(avg(age), 6) AS avg_age FROM lives GROUP BY 1, 2""",
)
def job_drive_age(t: Tables):
    return D.mean_age(drive_days(t.events)).withColumn("avg_age", F.round("avg_age", 6))


@query(
    "job_capacity_first_day",
    """SELECT CAST(day AS VARCHAR) AS date, sum(capacity)::BIGINT / pow(1024, 4) AS capacity_tib FROM (
         SELECT CAST(o_orderdate AS DATE) AS day, o_custkey * 1073741824 AS capacity FROM orders WHERE day(o_orderdate) = 1) GROUP BY 1""",
)
def job_capacity_first_day(t: Tables):
    days = t.orders.select(
        F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") * 1024**3).cast("bigint").alias("capacity_bytes")
    )
    return D.capacity_on_first_days(days).withColumn("date", F.col("date").cast("string"))


@query(
    "job_modal_capacity",
    f"""{DRIVES}, counted AS (SELECT model, capacity_bytes, count(*) AS n FROM drives GROUP BY 1, 2),
        modal AS (SELECT model, capacity_bytes FROM counted QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC, capacity_bytes) = 1)
        SELECT serial_number, modal.capacity_bytes, count(*) AS n FROM drives JOIN modal ON drives.model = modal.model GROUP BY 1, 2""",
)
def job_modal_capacity(t: Tables):
    days = settled(drive_days(t.events).groupBy("model", "serial_number", "capacity_bytes").agg(F.count("*").alias("rows")))
    drives = days.groupBy("model", "serial_number").agg(F.sum("rows").alias("n"))  # counted before the join
    per_capacity = days.groupBy("model", "capacity_bytes").agg(F.sum("rows").alias("rows"))
    best = F.max(F.struct("rows", (-F.col("capacity_bytes")).alias("smaller"))).alias("best")
    modal = settled(per_capacity.groupBy("model").agg(best).select("model", (-F.col("best.smaller")).alias("capacity_bytes")))
    return drives.join(modal, "model").groupBy("serial_number", "capacity_bytes").agg(F.sum("n").alias("n"))


@query(
    "job_coldest",
    f"""WITH {WEATHER_SQL} SELECT stn, year, mo, da, temp FROM weather QUALIFY temp = min(temp) OVER (PARTITION BY year)""",
)
def job_coldest(t: Tables):
    return coldest_by_semi_join(settled(weather(t.events))).orderBy("year", "mo", "da")


# ---- recipes ------------------------------------------------------------------------------

FLAGS = ["cakeweek", "wasteless", "clove", "rare_herb", "quick_22_meals", "appetite_and_more"]
CONTINUOUS = ["calories", "protein", "fat", "sodium"]
FEATURES_SQL = (
    f"WITH {RECIPES_SQL}, readable AS (SELECT title, dessert, TRY_CAST(rating AS DOUBLE) AS rating, TRY_CAST(calories AS DOUBLE) AS calories,"
    " protein, fat, sodium, "
    + ", ".join(f"coalesce({c}, 0.0::DOUBLE) AS {c}" for c in FLAGS)
    + """ FROM recipes WHERE (cakeweek IN (0.0, 1.0) OR cakeweek IS NULL) AND (wasteless IN (0.0, 1.0) OR wasteless IS NULL)
      AND dessert IS NOT NULL AND (rating IS NULL OR rating = '' OR TRY_CAST(rating AS DOUBLE) IS NOT NULL)
      AND (calories IS NULL OR calories = '' OR TRY_CAST(calories AS DOUBLE) IS NOT NULL)),
    bounds AS (SELECT """
    + ", ".join(f"quantile_cont({c}, 0.99) AS {c}_top" for c in CONTINUOUS)
    + ", count(*) AS n, "
    + ", ".join(f"sum({c}) AS {c}_sum" for c in FLAGS)
    + " FROM readable), capped AS (SELECT title, dessert, rating, "
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least({c}, {c}_top) END AS {c}" for c in CONTINUOUS)
    + ", "
    + " + ".join(f"CASE WHEN {c}_sum < 10 OR {c}_sum > n - 10 THEN 0.0::DOUBLE ELSE {c} END" for c in FLAGS)
    + """ AS flags FROM readable, bounds),
    filled AS (SELECT title, dessert, flags, rating, coalesce(protein * 4 / nullif(calories, 0), 0) AS protein_ratio,
      coalesce(fat * 9 / nullif(calories, 0), 0) AS fat_ratio, """
    + ", ".join(f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in CONTINUOUS)
    + " FROM capped WHERE rating IS NOT NULL) SELECT title, dessert, flags, round(protein_ratio, 6) AS protein_ratio, round(fat_ratio, 6) AS fat_ratio, "
    + ", ".join(
        f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}_scaled" for c in ["rating", *CONTINUOUS]
    )
    + " FROM filled"
)


@query("job_recipe_features", FEATURES_SQL)
def job_recipe_features(t: Tables):
    rows, kept = R.featured(recipes(t.customer, t.orders))
    ready = prepare(R.complete(rows), CONTINUOUS, ["rating"], [*kept, *R.RATIOS])
    flags = sum((F.col(c) for c in kept), F.lit(0.0)).alias("flags")
    names = [f"{c}_scaled" for c in ["rating", *CONTINUOUS]]
    scaled = vector_columns(ready.select("title", "dessert", flags, *R.RATIOS, "continuous_scaled"), "continuous_scaled", names)
    return scaled.withColumns({n: F.round(n, 6) for n in [*names, *R.RATIOS]})


def verdict(t: Tables, predictions):
    """Area under ROC beside precision and recall of each label."""
    with reused(predictions.select("dessert", "rawPrediction", "prediction")) as kept:
        area = E.area_under_roc(kept, "dessert")
        facts = E.precision_recall(kept, "dessert").collect()  # one row per label
    return t.spark.createDataFrame(
        [(f.label, f.precision, f.recall, area) for f in facts], "label double, precision double, recall double, area_under_roc double"
    )


@query("job_recipe_model", f"{PLAIN_SQL}, {STEPS_SQL} SELECT *, (SELECT {AREA_SQL} FROM stepped) AS area_under_roc FROM ({LABEL_RATES_SQL})")
def job_recipe_model(t: Tables):
    rows, kept = R.featured(recipes(t.customer, t.orders))
    return verdict(t, R.newton_fitted(rows, kept)[1])


@query("job_recipe_model_custom", f"{CUSTOM_SQL}, {STEPS_SQL} SELECT *, (SELECT {AREA_SQL} FROM stepped) AS area_under_roc FROM ({LABEL_RATES_SQL})")
def job_recipe_model_custom(t: Tables):
    rows, kept = custom_rows(t)
    return verdict(t, R.saved_and_loaded(t.spark, *R.fitted(rows, R.custom_stages(kept)), rows))
