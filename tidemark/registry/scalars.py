"""Scalar functions on strings, dates, numbers, arrays, maps and structs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import dates as D
from tidemark.functions import numbers as N
from tidemark.functions.nested import first_item, last_item
from tidemark.functions.text import is_number, tokens
from tidemark.registry import query
from tidemark.registry.projections import tidy_recipes
from tidemark.sources.tables import RECIPES_SQL, SHOWS_SQL, WEATHER_SQL, Tables, shows, weather

WEATHER = f"WITH {WEATHER_SQL}"
SHOWS = f"WITH {SHOWS_SQL}"
RECIPES = f"WITH {RECIPES_SQL}"
TOKENS_SQL = "WITH tokens AS (SELECT unnest(string_split_regex(text, '[ \n]')) AS token FROM documents) "


@query("str_split", TOKENS_SQL + "SELECT token, count(*) AS n FROM tokens GROUP BY 1")
def str_split(t: Tables):
    return tokens(t.documents, "text").groupBy("token").agg(F.count("*").alias("n"))


@query("str_lower", TOKENS_SQL + "SELECT lower(token) AS token, count(*) AS n FROM tokens GROUP BY 1")
def str_lower(t: Tables):
    return tokens(t.documents, "text").groupBy(F.lower("token").alias("token")).agg(F.count("*").alias("n"))


@query(
    "str_regexp_extract",
    TOKENS_SQL + "SELECT regexp_extract(lower(token), '[a-z]*', 0) AS word, count(*) AS n FROM tokens GROUP BY 1",
)
def str_regexp_extract(t: Tables):
    word = F.regexp_extract(F.lower("token"), "[a-z]*", 0)
    return tokens(t.documents, "text").groupBy(word.alias("word")).agg(F.count("*").alias("n"))


@query(
    "str_regexp_extract_any",
    TOKENS_SQL + "SELECT regexp_extract(lower(token), '[a-z'']+', 0) AS word, count(*) AS n FROM tokens GROUP BY 1",
)
def str_regexp_extract_any(t: Tables):
    word = F.regexp_extract(F.lower("token"), "[a-z']+", 0)
    return tokens(t.documents, "text").groupBy(word.alias("word")).agg(F.count("*").alias("n"))


@query("str_substring", "SELECT event_id, substr(event_type, 1, 1) AS a, substr(event_type, 2, 3) AS b FROM events")
def str_substring(t: Tables):
    return t.events.select("event_id", F.substring("event_type", 1, 1).alias("a"), F.col("event_type").substr(2, 3).alias("b"))


@query("str_trim", "SELECT p_partkey, trim('  ' || p_type || ' ') AS kind FROM part")
def str_trim(t: Tables):
    return t.part.select("p_partkey", F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("kind"))


@query("str_length", "SELECT conv_id, turn, length(text) AS n FROM conversations")
def str_length(t: Tables):
    return t.conversations.select("conv_id", "turn", F.length("text").alias("n"))


@query("str_concat_ws", WEATHER + "SELECT stn, concat_ws('-', year, mo, da) AS day FROM weather")
def str_concat_ws(t: Tables):
    return weather(t.events).select("stn", F.concat_ws("-", "year", "mo", "da").alias("day"))


@query(
    "str_is_number",
    RECIPES
    + r"""SELECT title, rating IS NULL OR rating = '' OR regexp_matches(rating, '^\s*[+-]?[0-9.]+\s*$') AS rating_ok,
          calories IS NULL OR calories = '' OR regexp_matches(calories, '^\s*[+-]?[0-9.]+\s*$') AS calories_ok FROM recipes""",
)
def str_is_number(t: Tables):
    return tidy_recipes(t).select(
        "title", is_number(F.col("rating")).alias("rating_ok"), is_number(F.col("calories")).alias("calories_ok")
    )


@query("dt_to_date", WEATHER + "SELECT DISTINCT CAST(CAST(year || '-' || mo || '-' || da AS DATE) AS VARCHAR) AS dt FROM weather")
def dt_to_date(t: Tables):
    day = F.to_date(F.concat_ws("-", "year", "mo", "da"))
    return weather(t.events).select(day.cast("string").alias("dt")).distinct()


@query(
    "dt_to_timestamp",
    "SELECT event_id, hour(ts)::INT AS h, minute(ts)::INT AS m, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events",
)
def dt_to_timestamp(t: Tables):
    text = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"))
    stamped = text.select("event_id", F.try_to_timestamp("stamp").alias("ts"))
    return stamped.select(
        "event_id", F.hour("ts").alias("h"), F.minute("ts").alias("m"), F.to_date("ts").cast("string").alias("day")
    )


@query(
    "dt_unix",
    """SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS at, epoch(TIMESTAMP '2002-01-01')::BIGINT - epoch(o_orderdate)::BIGINT AS age
       FROM orders""",
)
def dt_unix(t: Tables):
    at = D.epoch_seconds(F.col("o_orderdate"))
    end = F.unix_timestamp(F.lit("2002-01-01 00:00:00"))
    return t.orders.select("o_orderkey", at.alias("at"), (end - at).alias("age"))


@query("dt_datediff", "SELECT o_orderkey, datediff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')::INT AS days FROM orders")
def dt_datediff(t: Tables):
    return t.orders.select("o_orderkey", F.datediff(F.lit("2002-01-01").cast("date"), "o_orderdate").alias("days"))


@query("dt_extract", "SELECT day(o_orderdate)::INT AS day, count(*) AS n FROM orders GROUP BY 1")
def dt_extract(t: Tables):
    return t.orders.selectExpr("extract(day from o_orderdate) AS day").groupBy("day").agg(F.count("*").alias("n"))


@query("dt_cast_date", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def dt_cast_date(t: Tables):
    days = t.events.selectExpr("cast(cast(ts as date) as string) AS day")
    return days.groupBy("day").agg(F.count("*").alias("n"))


@query(
    "dt_from_parts",
    """SELECT p_partkey, CAST(TRY_CAST('2023-' || (p_size % 12 + 1) || '-' || (p_partkey % 31 + 1) AS DATE) AS VARCHAR) AS day FROM part""",
)
def dt_from_parts(t: Tables):
    day = D.date_of_parts(F.lit("2023"), F.col("p_size") % 12 + 1, F.col("p_partkey") % 31 + 1)
    return t.part.select("p_partkey", day.cast("string").alias("day"))


@query(
    "dt_hms_seconds",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
         ELSE (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE END AS seconds FROM events""",
)
def dt_hms_seconds(t: Tables):
    clock = F.when(F.col("event_type") == "error", "--:--:--").otherwise(F.date_format("ts", "HH:mm:ss.SSSSSS"))
    return t.events.select("event_id", D.hms_seconds(clock).cast("double").alias("seconds"))


@query(
    "math_arith",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 4 + l_linenumber - 1 AS a,
         round(l_quantity / nullif(l_discount * 100, 0), 6) AS b FROM lineitem""",
)
def math_arith(t: Tables):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        (F.col("l_quantity") * 4 + F.col("l_linenumber") - 1).alias("a"),
        F.round(N.ratio(F.col("l_quantity"), F.col("l_discount") * 100), 6).alias("b"),
    )


@query("math_pow", "SELECT o_orderkey, o_totalprice / pow(1024, 3) AS gib, o_totalprice / pow(1024, 4) AS tib FROM orders")
def math_pow(t: Tables):
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", N.gibibytes(price).alias("gib"), (price / F.pow(F.lit(1024), 4)).alias("tib"))


@query("math_round", "SELECT round(l_quantity / 3, 1) AS v, count(*) AS n FROM lineitem GROUP BY 1")
def math_round(t: Tables):
    return t.lineitem.groupBy(F.round(F.col("l_quantity") / 3, 1).alias("v")).agg(F.count("*").alias("n"))


@query("math_least_cap", RECIPES + "SELECT title, CASE WHEN sodium IS NOT NULL THEN least(sodium, 5661.0) END AS sodium FROM recipes")
def math_least_cap(t: Tables):
    return tidy_recipes(t).select("title", N.capped(F.col("sodium"), 5661.0).alias("sodium"))


@query(
    "cast_numeric",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT)::DOUBLE AS k, TRY_CAST(event_type AS DOUBLE) AS bad,
         CAST(trunc(value) AS BIGINT) AS whole FROM events""",
)
def cast_numeric(t: Tables):
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").try_cast("int").cast("double").alias("k"),
        F.col("event_type").try_cast("double").alias("bad"),
        F.col("value").cast("bigint").alias("whole"),
    )


@query(
    "cond_case",
    "SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value > 20 THEN 'middle' ELSE 'low' END AS level FROM events",
)
def cond_case(t: Tables):
    level = F.when(F.col("value") > 100, "high").when(F.col("value") > 20, "middle").otherwise("low")
    return t.events.select("event_id", level.alias("level"))


@query("cond_lit", "SELECT o_orderkey, 'parcel' AS sent_as, 2::INT AS copies, false AS insured FROM orders")
def cond_lit(t: Tables):
    constants = {"sent_as": "parcel", "copies": 2, "insured": False}
    return t.orders.select("o_orderkey", *[F.lit(v).alias(n) for n, v in constants.items()])


@query("arr_build", SHOWS + "SELECT id, array_to_string([language, type, status], ',') AS some FROM shows")
def arr_build(t: Tables):
    return shows(t.documents).select("id", F.concat_ws(",", F.array("language", "type", "status")).alias("some"))


@query("arr_repeat", SHOWS + "SELECT id, rtrim(repeat(language || ',', 5), ',') AS repeated FROM shows")
def arr_repeat(t: Tables):
    return shows(t.documents).select("id", F.concat_ws(",", F.array_repeat("language", 5)).alias("repeated"))


@query(
    "arr_index",
    """SELECT vec_id, embedding[2]::DOUBLE AS by_place, embedding[1]::DOUBLE AS head, embedding[len(embedding)]::DOUBLE AS tail,
         embedding[100000]::DOUBLE AS outside FROM embeddings""",
)
def arr_index(t: Tables):
    vector = F.col("embedding")
    picked = {"by_place": vector[1], "head": first_item(vector), "tail": last_item(vector), "outside": F.get(vector, F.lit(99_999))}
    return t.embeddings.select("vec_id", *[c.cast("double").alias(n) for n, c in picked.items()])


@query("arr_last", SHOWS + "SELECT id, lines[-1] AS final_name FROM shows")
def arr_last(t: Tables):
    return shows(t.documents).select("id", last_item(F.col("document.lines.name")).alias("final_name"))


@query("arr_size", SHOWS + "SELECT id, len(lines)::INT AS n FROM shows")
def arr_size(t: Tables):
    return shows(t.documents).select("id", F.size("document.lines").alias("n"))


@query("arr_distinct", SHOWS + "SELECT id, len(list_distinct(lines))::INT AS n, 1::INT AS one FROM shows")
def arr_distinct(t: Tables):
    repeated = F.array_distinct(F.array_repeat("language", 5))
    lines = F.array_distinct("document.lines.name")
    return shows(t.documents).select("id", F.size(lines).alias("n"), F.size(repeated).alias("one"))


@query("arr_intersect", SHOWS + "SELECT id, CASE WHEN language IN ('en', 'fr') THEN language ELSE '' END AS common FROM shows")
def arr_intersect(t: Tables):
    common = F.array_intersect(F.array(F.lit("fr"), F.lit("en")), "genres")
    return shows(t.documents).select("id", F.concat_ws(",", common).alias("common"))


@query("arr_min_max", SHOWS + "SELECT id, CAST(min(on_day) AS VARCHAR) AS first, CAST(max(on_day) AS VARCHAR) AS last FROM episodes GROUP BY 1")
def arr_min_max(t: Tables):
    dates = "document.lines.on_day"
    return shows(t.documents).select(
        "id", F.array_min(dates).cast("string").alias("first"), F.array_max(dates).cast("string").alias("last")
    )


@query("arr_explode", SHOWS + "SELECT id, ep_id, ep_name FROM episodes")
def arr_explode(t: Tables):
    return shows(t.documents).select("id", F.explode("document.lines").alias("e")).select(
        "id", F.col("e.id").alias("ep_id"), F.col("e.name").alias("ep_name")
    )


@query("map_posexplode", SHOWS + "SELECT id, (ep_id - 1)::INT AS position, ep_id, ep_name FROM episodes")
def map_posexplode(t: Tables):
    named = F.map_from_arrays("document.lines.id", "document.lines.name")
    return shows(t.documents).select("id", F.posexplode(named).alias("position", "ep_id", "ep_name"))


@query(
    "map_from_arrays",
    "SELECT p_partkey, 2::INT AS entries, p_brand || ' ' || p_type AS described FROM part",
)
def map_from_arrays(t: Tables):
    facts = F.map_from_arrays(F.array(F.lit("maker"), F.lit("line")), F.array("p_brand", "p_type"))
    return t.part.select("p_partkey", F.size(facts).alias("entries"), F.array_join(F.map_values(facts), " ").alias("described"))


@query(
    "map_lookup",
    """SELECT o_orderkey, o_orderstatus AS state, o_orderpriority AS urgency, NULL::VARCHAR AS unknown_key,
         CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS named FROM orders""",
)
def map_lookup(t: Tables):
    facts = F.create_map(F.lit("state"), "o_orderstatus", F.lit("urgency"), "o_orderpriority")
    names = F.create_map(F.lit("F"), F.lit("done"), F.lit("O"), F.lit("open"))
    return t.orders.select("o_orderkey", facts.alias("facts"), "o_orderstatus").select(
        "o_orderkey",
        F.col("facts.state"),
        F.element_at("facts", "urgency").alias("urgency"),
        F.try_element_at("facts", F.lit("weight")).alias("unknown_key"),
        F.try_element_at(names, F.col("o_orderstatus")).alias("named"),
    )


@query("struct_build", "SELECT o_orderkey, o_totalprice AS amount, year(o_orderdate)::INT AS in_year, o_totalprice > 100000 AS dear FROM orders")
def struct_build(t: Tables):
    price = F.col("o_totalprice")
    bill = F.struct(price.alias("amount"), F.year("o_orderdate").alias("in_year"), (price > 100_000).alias("dear"))
    return t.orders.withColumn("bill", bill).select("o_orderkey", "bill.amount", F.col("bill")["in_year"].alias("in_year"), "bill.dear")


# The directed pairs of temperature scales.
PAIRS = ["CF", "FC", "CK", "KC", "CR", "RC", "FK", "KF", "FR", "RF", "KR", "RK"]
CONVERSIONS_SQL = """round(temp * 1.8 + 32, 6) AS cf, round((temp - 32) / 1.8, 6) AS fc, round(temp + 273.15, 6) AS ck,
  round(temp - 273.15, 6) AS kc, round(temp * 1.8 + 491.67, 6) AS cr, round((temp - 491.67) / 1.8, 6) AS rc,
  round((temp - 32) / 1.8 + 273.15, 6) AS fk, round((temp - 273.15) * 1.8 + 32, 6) AS kf, round(temp + 459.67, 6) AS fr,
  round(temp - 459.67, 6) AS rf, round(temp * 1.8, 6) AS kr, round(temp / 1.8, 6) AS rk"""


@query("convert_units", WEATHER + f"SELECT stn, mo, da, {CONVERSIONS_SQL} FROM weather")
def convert_units(t: Tables):
    converted = [F.round(N.convert_temperature(F.col("temp"), a, b), 6).alias((a + b).lower()) for a, b in PAIRS]
    return weather(t.events).select("stn", "mo", "da", *converted)


@query(
    "map_values",
    """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 1.0 WHEN 'SMALL' THEN 2.0 WHEN 'LARGE' THEN 3.0 END::DOUBLE AS num FROM part""",
)
def map_values(t: Tables):
    num = N.coded(F.col("p_type"), {"PROMO": 1.0, "SMALL": 2.0, "LARGE": 3.0})
    return t.part.select("p_partkey", num.alias("num"))


@query(
    "min_max_norm",
    WEATHER
    + """, ends AS (SELECT *, min(temp) OVER w AS low, max(temp) OVER w AS high FROM weather WINDOW w AS (PARTITION BY stn, year, mo))
    SELECT stn, year, mo, da, temp, CASE WHEN low = high THEN 0.5 ELSE round((temp - low) / (high - low), 6) END AS temp_norm FROM ends""",
)
def min_max_norm(t: Tables):
    month = Window.partitionBy("stn", "year", "mo")  # at most 31 readings
    norm = N.range_scaled(F.col("temp"), F.min("temp").over(month), F.max("temp").over(month))
    return weather(t.events).select("stn", "year", "mo", "da", "temp", F.round(norm, 6).alias("temp_norm"))
