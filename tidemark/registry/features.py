"""Feature preparation, own pipeline stages, models and their evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.features import evaluate as E
from tidemark.features import newton as N
from tidemark.features import prepare as P
from tidemark.features.stages import ExtremeValueCapper, ExtremeValueCapperModel, ScalarNAFiller, cap_column, fill_column
from tidemark.plans import recipes as R
from tidemark.registry import query
from tidemark.registry.projections import tidy_recipes
from tidemark.sources.tables import RECIPES_SQL, Tables, recipes
from tidemark.storage import new_folder, settled

RECIPES = f"WITH {RECIPES_SQL} "
MEASURES = ["protein", "fat", "sodium"]


def rounded(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def measured(t: Tables):
    return tidy_recipes(t).select("title", *MEASURES)


COMPLETE = "WHERE protein IS NOT NULL AND fat IS NOT NULL AND sodium IS NOT NULL"


@query("ml_assemble", RECIPES + f"SELECT title, protein AS f0, fat AS f1, sodium AS f2 FROM recipes {COMPLETE}")
def ml_assemble(t: Tables):
    assembled = P.assemble(measured(t), MEASURES, "features").select("title", "features")
    return P.vector_columns(assembled, "features", ["f0", "f1", "f2"])


@query(
    "ml_correlation",
    RECIPES
    + ", complete AS (FROM recipes "
    + COMPLETE
    + ") "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM complete" for a in MEASURES for b in MEASURES),
)
def ml_correlation(t: Tables):
    return rounded(P.correlations(measured(t), MEASURES), ["r"])


@query(
    "ml_impute_mean",
    RECIPES + "SELECT title, " + ", ".join(f"round(coalesce({c}, avg({c}) OVER ()), 6) AS {c}_i" for c in MEASURES) + " FROM recipes",
)
def ml_impute_mean(t: Tables):
    names = [f"{c}_i" for c in MEASURES]
    return rounded(P.impute_mean(measured(t), MEASURES, names).select("title", *names), names)


def minmax_sql(c: str) -> str:
    return f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}_s"


@query("ml_minmax", RECIPES + "SELECT title, " + ", ".join(map(minmax_sql, MEASURES)) + f" FROM recipes {COMPLETE}")
def ml_minmax(t: Tables):
    names = [f"{c}_s" for c in MEASURES]
    return rounded(P.min_max(measured(t), MEASURES, names).select("title", *names), names)


@query(
    "ml_ratio_features",
    RECIPES
    + """SELECT title, round(coalesce(protein * 4 / nullif(sodium, 0), 0), 6) AS protein_ratio,
         round(coalesce(fat * 9 / nullif(sodium, 0), 0), 6) AS fat_ratio FROM recipes""",
)
def ml_ratio_features(t: Tables):
    ratios = {"protein_ratio": ("protein", 4.0, "sodium"), "fat_ratio": ("fat", 9.0, "sodium")}
    return rounded(P.with_ratios(measured(t), ratios), list(ratios)).select("title", *ratios)


@query(
    "ml_pipeline_prep",
    RECIPES
    + ", filled AS (SELECT title, has_f, "
    + ", ".join(f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in MEASURES)
    + " FROM (SELECT *, quick_22_meals AS has_f FROM recipes)) SELECT title, has_f AS f0, "
    + ", ".join(minmax_sql(c).replace(f"{c}_s", f"f{i + 1}") for i, c in enumerate(MEASURES))
    + " FROM filled",
)
def ml_pipeline_prep(t: Tables):
    rows = tidy_recipes(t).select("title", "quick_22_meals", *MEASURES)
    ready = P.prepare(rows, MEASURES, [], ["quick_22_meals"]).select("title", "features")
    return rounded(P.vector_columns(ready, "features", ["f0", "f1", "f2", "f3"]), ["f0", "f1", "f2", "f3"])


@query(
    "ml_feature_names",
    RECIPES
    + """SELECT 0 AS place, 'quick_22_meals' AS name, count(*) AS n FROM recipes UNION ALL SELECT 1, 'continuous_scaled_0', count(*) FROM recipes
         UNION ALL SELECT 2, 'continuous_scaled_1', count(*) FROM recipes UNION ALL SELECT 3, 'continuous_scaled_2', count(*) FROM recipes""",
)
def ml_feature_names(t: Tables):
    rows = tidy_recipes(t).select("title", "quick_22_meals", *MEASURES)
    ready = P.prepare(rows, MEASURES, [], ["quick_22_meals"])
    names = P.feature_names(ready)
    entries = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("name")) for i, n in enumerate(names)])
    return ready.agg(F.count("features").alias("n")).select(F.inline(entries), "n")


FLAGS = ["cakeweek", "wasteless", "clove", "rare_herb", "quick_22_meals", "appetite_and_more"]
IMPUTED = ["calories", "protein", "fat", "sodium"]
NAMES = [*FLAGS, "protein_ratio", "fat_ratio", "rating", *IMPUTED]
WIDTH = len(NAMES) + 1

# The rows that the classifier learns from and those held back, as the plan prepares them, with their lots.
MODEL_ROWS_SQL = (
    f"WITH RECURSIVE {RECIPES_SQL}, readable AS (SELECT title, dessert, TRY_CAST(rating AS DOUBLE) AS rating, TRY_CAST(calories AS DOUBLE) AS calories,"
    " protein, fat, sodium, "
    + ", ".join(f"coalesce({c}, 0.0::DOUBLE) AS {c}" for c in FLAGS)
    + """ FROM recipes WHERE (cakeweek IN (0.0, 1.0) OR cakeweek IS NULL) AND (wasteless IN (0.0, 1.0) OR wasteless IS NULL)
      AND dessert IS NOT NULL AND (rating IS NULL OR rating = '' OR TRY_CAST(rating AS DOUBLE) IS NOT NULL)
      AND (calories IS NULL OR calories = '' OR TRY_CAST(calories AS DOUBLE) IS NOT NULL)),
    bounds AS (SELECT """
    + ", ".join(f"quantile_cont({c}, 0.99) AS {c}_top" for c in IMPUTED)
    + ", "
    + ", ".join(f"(sum({c}) >= 10 AND sum({c}) <= count(*) - 10) AS {c}_kept" for c in FLAGS)
    + " FROM readable), capped AS (SELECT title, dessert, rating, "
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least({c}, {c}_top) END AS {c}" for c in IMPUTED)
    + ", "
    + ", ".join(f"CASE WHEN {c}_kept THEN {c} ELSE 0.0::DOUBLE END AS {c}" for c in FLAGS)
    + """ FROM readable, bounds WHERE rating IS NOT NULL),
    rated AS (SELECT *, coalesce(protein * 4 / nullif(calories, 0), 0) AS protein_ratio, coalesce(fat * 9 / nullif(calories, 0), 0) AS fat_ratio,
      ('0x' || substr(md5('13|' || title), 1, 8))::BIGINT AS hash FROM capped),
    model_rows AS (SELECT title, dessert AS y, hash % 10000 < 7000 AS learned, hash % 3 AS fold, ["""
    + ", ".join(f"{c}::DOUBLE" for c in NAMES)
    + "] AS x FROM rated)"
)


# Those of the pipeline with own stages: ratios of the plain values, unknown where undefined, and values capped at two
# spreads around the mean of the training rows.
CUSTOM_ROWS_SQL = (
    MODEL_ROWS_SQL[: MODEL_ROWS_SQL.index("bounds AS")]
    + "hashed AS (SELECT *, ('0x' || substr(md5('13|' || title), 1, 8))::BIGINT AS hash FROM readable), sides AS (SELECT "
    + ", ".join(f"avg({c}) - 2 * stddev_samp({c}) AS {c}_low, avg({c}) + 2 * stddev_samp({c}) AS {c}_top" for c in IMPUTED)
    + " FROM hashed WHERE rating IS NOT NULL AND hash % 10000 < 7000), flagged AS (SELECT "
    + ", ".join(f"(sum({c}) >= 10 AND sum({c}) <= count(*) - 10) AS {c}_kept" for c in FLAGS)
    + " FROM readable), model_rows AS (SELECT title, dessert AS y, hash % 10000 < 7000 AS learned, hash % 3 AS fold, ["
    + ", ".join(f"CASE WHEN {c}_kept THEN {c} ELSE 0.0::DOUBLE END" for c in FLAGS)
    + ", protein * 4 / nullif(calories, 0), fat * 9 / nullif(calories, 0), rating, "
    + ", ".join(f"CASE WHEN {c} > {c}_top THEN {c}_top WHEN {c} < {c}_low THEN {c}_low ELSE {c} END" for c in IMPUTED)
    + "] AS x FROM hashed, sides, flagged WHERE rating IS NOT NULL)"
)


def newton_sql(models: str, rows: str = MODEL_ROWS_SQL, steps: int = 8, sweeps: int = 60) -> str:
    """CTEs up to ``fit``: (m, b) for models (m, left_out, strength, mix); b has the intercept first, on spreads of one.

    Each step adds up gradient and Hessian over the rows, then improves one coefficient after another.
    """
    w = WIDTH
    return (
        rows
        + f""", models(m, left_out, strength, mix) AS (VALUES {models}),
    seen AS MATERIALIZED (SELECT m, x, y FROM models JOIN model_rows ON learned AND fold IS DISTINCT FROM left_out),
    long AS (SELECT m, i, x[i] AS v FROM seen, range(1, {w}) AS r(i)),
    moments AS (SELECT m, i, avg(v) AS mean, sqrt(greatest(sum(v * v) - count(v) * avg(v) * avg(v), 0) / (count(*) - 1)) AS spread FROM long GROUP BY m, i),
    prepared AS MATERIALIZED (SELECT m, list(mean ORDER BY i) AS means, list(CASE WHEN spread <= 1e-9 * abs(mean) THEN 0 ELSE spread END ORDER BY i) AS spreads FROM moments GROUP BY m),
    z AS MATERIALIZED (SELECT m, y, list_prepend(1.0::DOUBLE, list_transform(range(1, {w}), lambda i: CASE WHEN spreads[i] > 0 THEN (coalesce(x[i], means[i]) - means[i]) / spreads[i] ELSE 0 END)) AS z
      FROM seen JOIN prepared USING (m)),
    steps AS (
      SELECT m, 0 AS step, list_transform(range({w}), lambda i: 0.0::DOUBLE) AS b, strength, mix FROM models
      UNION ALL
      SELECT m, step + 1, list_transform(list_zip(b, list_reduce(
          list_prepend({{'e': list_transform(range({w}), lambda i: 0.0::DOUBLE), 'j': 0}}, list_transform(range({w * sweeps}), lambda i: {{'e': []::DOUBLE[], 'j': i % {w} + 1}})),
          lambda s, t: {{'e': list_transform(s.e, lambda v, i: CASE WHEN i != t.j THEN v ELSE coalesce(
              sign(h[(i - 1) * {w} + i] * (b[i] + v) - g[i] - list_inner_product(h[(i - 1) * {w} + 1 : i * {w}], s.e))
              * greatest(abs(h[(i - 1) * {w} + i] * (b[i] + v) - g[i] - list_inner_product(h[(i - 1) * {w} + 1 : i * {w}], s.e)) - CASE WHEN i > 1 THEN strength * mix ELSE 0 END, 0)
              / nullif(h[(i - 1) * {w} + i] + CASE WHEN i > 1 THEN strength * (1 - mix) ELSE 0 END, 0), 0) - b[i] END), 'j': t.j}}).e), lambda q: q[1] + q[2]), strength, mix
      FROM (
        SELECT m, step, any_value(b) AS b, any_value(strength) AS strength, any_value(mix) AS mix, list(h ORDER BY k) AS h, list(g ORDER BY k) FILTER (WHERE k < {w}) AS g
        FROM (
          SELECT m, step, k, any_value(b) AS b, any_value(strength) AS strength, any_value(mix) AS mix, avg(p * (1 - p) * z[k // {w} + 1] * z[k % {w} + 1]) AS h, avg((p - y) * z[k % {w} + 1]) AS g
          FROM (SELECT steps.m, step, b, strength, mix, z, y, 1 / (1 + exp(-list_inner_product(b, z))) AS p FROM steps JOIN z ON steps.m = z.m WHERE step < {steps}), range({w * w}) AS r(k)
          GROUP BY m, step, k)
        GROUP BY m, step)
    ),
    fit AS MATERIALIZED (SELECT m, b, means, spreads, strength, mix FROM steps JOIN prepared USING (m) WHERE step = {steps})"""
    )


def score_sql(rows: str) -> str:
    """Log odds of ``rows`` (with x) by ``fit``."""
    parts = " + ".join(f"CASE WHEN spreads[{i}] > 0 THEN b[{i + 1}] * (coalesce(x[{i}], means[{i}]) - means[{i}]) / spreads[{i}] ELSE 0 END" for i in range(1, WIDTH))
    return f"(SELECT *, b[1] + {parts} AS score FROM {rows})"


PREDICTED_SQL = f"predicted AS (SELECT title, y AS dessert, score, CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM {score_sql('(SELECT * FROM model_rows, fit WHERE NOT learned)')})"
NO_PENALTY = "(0, NULL::INT, 0.0::DOUBLE, 0.0::DOUBLE)"
# Without a penalty, features that go together need more rounds.
PLAIN_SQL = f"{newton_sql(NO_PENALTY, steps=14, sweeps=100)}, {PREDICTED_SQL}"
CUSTOM_SQL = f"{newton_sql(NO_PENALTY, CUSTOM_ROWS_SQL, steps=14, sweeps=100)}, {PREDICTED_SQL}"
# Per score, highest first: rows of each label with it and down to it.
STEPS_SQL = """stepped AS (SELECT score, hit, miss, sum(hit) OVER w AS hit_upto, sum(miss) OVER w AS miss_upto, sum(hit) OVER () AS hits, sum(miss) OVER () AS misses
    FROM (SELECT score, count(*) FILTER (WHERE dessert = 1) AS hit, count(*) FILTER (WHERE dessert <> 1) AS miss FROM predicted GROUP BY score)
    WINDOW w AS (ORDER BY score DESC))"""
AREA_SQL = "sum(miss * (hit_upto - hit / 2)) / nullif(sum(hit) * sum(miss), 0)::DOUBLE"
LABEL_RATES_SQL = """SELECT label, count(*) FILTER (WHERE dessert = label AND prediction = label) / nullif(count(*) FILTER (WHERE prediction = label), 0) AS precision,
    count(*) FILTER (WHERE dessert = label AND prediction = label) / nullif(count(*) FILTER (WHERE dessert = label), 0) AS recall
    FROM predicted, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) AS l(label) GROUP BY label"""


def model_and_predictions(t: Tables):
    rows, kept = R.featured(recipes(t.customer, t.orders))
    return R.newton_fitted(rows, kept)


@query("ml_logistic", PLAIN_SQL + " SELECT title, dessert, prediction FROM predicted")
def ml_logistic(t: Tables):
    _, predictions = model_and_predictions(t)
    return predictions.select("title", "dessert", "prediction")


@query(
    "ml_confusion",
    PLAIN_SQL + """ SELECT dessert, count(*) FILTER (WHERE prediction = 0) AS "0.0", count(*) FILTER (WHERE prediction = 1) AS "1.0" FROM predicted GROUP BY dessert""",
)
def ml_confusion(t: Tables):
    _, predictions = model_and_predictions(t)
    return E.confusion(predictions, "dessert")


@query("ml_precision_recall", PLAIN_SQL + " " + LABEL_RATES_SQL)
def ml_precision_recall(t: Tables):
    _, predictions = model_and_predictions(t)
    return E.precision_recall(predictions, "dessert")


@query("ml_auc", PLAIN_SQL + f", {STEPS_SQL} SELECT (sum(hit) + sum(miss))::BIGINT AS n, {AREA_SQL} AS area_under_roc FROM stepped")
def ml_auc(t: Tables):
    _, predictions = model_and_predictions(t)
    area = E.area_under_roc(predictions, "dessert")
    return predictions.agg(F.count("*").alias("n")).withColumn("area_under_roc", F.lit(area))


@query("ml_roc_points", PLAIN_SQL + f", {STEPS_SQL} SELECT miss_upto / nullif(misses, 0) AS fpr, hit_upto / nullif(hits, 0) AS tpr FROM stepped UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE")
def ml_roc_points(t: Tables):
    _, predictions = model_and_predictions(t)
    return E.roc_points(predictions, "dessert")


# Points 0 and 1 (square and absolute penalty) on folds 0 to 2, and on all training rows (fold null).
GRID = [(0.01, 0.0), (0.01, 1.0)]
SEARCH_SQL = newton_sql(", ".join(f"({10 * p + f}, {f if f < 3 else 'NULL'}::INT, {s}::DOUBLE, {x}::DOUBLE)" for p, (s, x) in enumerate(GRID) for f in range(4))) + f""",
    held AS {score_sql("(SELECT m // 10 AS point, * FROM model_rows JOIN fit ON fold = m % 10 WHERE learned)")},
    ranks AS (SELECT point, fold, score, hit, miss, sum(hit) OVER (PARTITION BY point, fold ORDER BY score DESC) AS hit_upto
      FROM (SELECT point, fold, score, count(*) FILTER (WHERE y = 1) AS hit, count(*) FILTER (WHERE y <> 1) AS miss FROM held GROUP BY point, fold, score)),
    areas AS (SELECT point::INT AS point, fold::INT AS fold, (sum(hit) + sum(miss))::BIGINT AS n_rows, {AREA_SQL} AS area_under_roc FROM ranks GROUP BY point, fold),
    points AS (SELECT point, avg(area_under_roc) AS area_under_roc FROM areas GROUP BY point),
    best AS (SELECT fit.* FROM fit JOIN (SELECT point FROM points ORDER BY area_under_roc DESC, point LIMIT 1) ON m = 10 * point + 3)"""
POINT_SQL = "CASE point " + " ".join(f"WHEN {p} THEN 'elasticNetParam={x}, regParam={s}'" for p, (s, x) in enumerate(GRID)) + " END AS params"


def search(t: Tables) -> tuple[R.Search, list[str], DataFrame, DataFrame]:
    rows, kept = R.featured(recipes(t.customer, t.orders))
    train, test = R.parts(rows)
    return R.searched(train, kept, GRID), kept, train, test


def point_name() -> Column:
    names = [F.lit(f"elasticNetParam={x}, regParam={s}") for s, x in GRID]
    return F.array(*names)[F.col("point")].alias("params")


@query("ml_cross_validate", SEARCH_SQL + f" SELECT {POINT_SQL}, round(area_under_roc, 9) AS area_under_roc FROM points")
def ml_cross_validate(t: Tables):
    found, *_ = search(t)
    return found.areas.groupBy("point").agg(F.round(F.avg("area_under_roc"), 9).alias("area_under_roc")).select(point_name(), "area_under_roc")


@query("ml_grid", SEARCH_SQL + f" SELECT {POINT_SQL}, fold, n_rows, area_under_roc FROM areas")
def ml_grid(t: Tables):
    """One row per point of the grid and fold, with the rows that were held back and the score on them."""
    found, *_ = search(t)
    return found.areas.select(point_name(), "fold", "n_rows", "area_under_roc")


@query(
    "ml_holdout",
    SEARCH_SQL + f""", predicted AS (SELECT y AS dessert, score FROM {score_sql("(SELECT * FROM model_rows, best WHERE NOT learned)")}), {STEPS_SQL}
      SELECT (sum(hit) + sum(miss))::BIGINT AS n, {AREA_SQL} AS area_under_roc FROM stepped""",
)
def ml_holdout(t: Tables):
    """The best model of the search, judged on rows that no fold has seen."""
    found, _, _, test = search(t)
    area = E.area_under_roc(N.predicted(test, found.fit), "dessert")
    return test.agg(F.count("*").alias("n")).withColumn("area_under_roc", F.lit(area))


# Coefficients are told for continuous features mapped to 0..1 between the ends of the training rows.
COEFFICIENTS_SQL = SEARCH_SQL + f""", ends AS (SELECT i, min(x[i]) AS low, max(x[i]) AS high FROM model_rows, range(1, {WIDTH}) AS r(i) WHERE learned GROUP BY i),
    told AS (SELECT i, CASE WHEN spreads[i] > 0 THEN b[i + 1] / spreads[i] ELSE 0 END AS w, means[i] AS mean, CASE WHEN i > 8 THEN low ELSE 0 END AS low, CASE WHEN i > 8 THEN high ELSE 1 END AS high, b[1] AS first
      FROM best, ends),
    names(i, name, kept) AS ({" UNION ALL ".join(f"SELECT {i}, '{n if i <= 8 else f'continuous_scaled_{i - 9}'}', {f'{n}_kept FROM bounds' if n in FLAGS else 'true'}" for i, n in enumerate(NAMES, 1))}),
    coefs AS (SELECT name, w * (high - low) AS coef FROM told JOIN names USING (i) WHERE kept UNION ALL SELECT '(intercept)', any_value(first) + sum(w * (low - mean)) FROM told)
    SELECT name, round(coef, 6) AS coef, abs(round(coef, 6)) AS abs_coef FROM coefs"""


@query("ml_coefficients", COEFFICIENTS_SQL)
def ml_coefficients(t: Tables):
    """Intercept and coefficients of the best model of the search, smallest magnitude first."""
    found, kept, train, _ = search(t)
    fit, plain = found.fit, len(kept) + len(R.RATIOS)
    ends = train.agg(*[F.min(n).alias(f"low_{n}") for n in fit.names], *[F.max(n).alias(f"high_{n}") for n in fit.names]).first()
    lows, highs = ([d if i < plain else ends[f"{side}_{n}"] for i, n in enumerate(fit.names)] for side, d in (("low", 0.0), ("high", 1.0)))
    intercept, weights = fit.scaled(lows, highs)
    names = ["(intercept)", *fit.names[:plain], *[f"continuous_scaled_{i}" for i in range(len(fit.names) - plain)]]
    rows = [(n, round(c, 6) + 0.0, abs(round(c, 6))) for n, c in zip(names, [intercept, *weights], strict=True)]
    return t.spark.createDataFrame(sorted(rows, key=lambda r: (r[2], r[0])), "name string, coef double, abs_coef double")


FILLED_SQL = RECIPES + "SELECT title, coalesce(protein, {}) AS protein_f FROM recipes"


@query("ml_na_filler_fn", FILLED_SQL.format("-99.0"))
def ml_na_filler_fn(t: Tables):
    return fill_column(measured(t), "protein", "protein_f", -99.0).select("title", "protein_f")


@query("ml_na_filler", FILLED_SQL.format("-99.0"))
def ml_na_filler(t: Tables):
    filler = ScalarNAFiller(inputCol="protein", outputCol="protein_f", filler=-99)
    return filler.transform(measured(t)).select("title", "protein_f")


@query("ml_na_filler_multi", RECIPES + "SELECT title, " + ", ".join(f"coalesce({c}, 0.5) AS {c}" for c in MEASURES) + " FROM recipes")
def ml_na_filler_multi(t: Tables):
    return ScalarNAFiller(inputCols=MEASURES, outputCols=MEASURES, filler=0.5).transform(measured(t))


@query("ml_param_override", FILLED_SQL.format("17.0") + " UNION ALL SELECT title, coalesce(protein, 3.0) FROM recipes")
def ml_param_override(t: Tables):
    filler = ScalarNAFiller(inputCol="protein", outputCol="protein_f", filler=-99)
    once = filler.transform(measured(t), params={filler.filler: 17.0})
    changed = filler.setFiller(3.0).transform(measured(t))
    return once.union(changed).select("title", "protein_f")


def capped_sql(c: str, k: float) -> str:
    low, high = (f"avg({c}) OVER () {sign} {k} * stddev_samp({c}) OVER ()" for sign in "-+")
    return f"round(CASE WHEN {c} > {high} THEN {high} WHEN {c} < {low} THEN {low} ELSE {c} END, 6) AS {c}_c"


@query("ml_capper_fn", RECIPES + f"SELECT title, {capped_sql('sodium', 1.0)} FROM recipes")
def ml_capper_fn(t: Tables):
    return rounded(cap_column(measured(t), "sodium", "sodium_c", 1.0).select("title", "sodium_c"), ["sodium_c"])


@query("ml_capper", RECIPES + "SELECT title, " + ", ".join(capped_sql(c, 1.5) for c in MEASURES) + " FROM recipes")
def ml_capper(t: Tables):
    names = [f"{c}_c" for c in MEASURES]
    capper = ExtremeValueCapper(inputCols=MEASURES, outputCols=names, boundary=1.5)
    rows = measured(t)
    return rounded(capper.fit(rows).transform(rows).select("title", *names), names)


@query("ml_custom_persist", RECIPES + f"SELECT title, {capped_sql('sodium', 1.0)}, coalesce(protein, -1.0) AS protein_f FROM recipes")
def ml_custom_persist(t: Tables):
    rows, path = measured(t), new_folder(t.spark, "stages")
    ExtremeValueCapper(inputCol="sodium", outputCol="sodium_c", boundary=1.0).fit(rows).write().overwrite().save(f"{path}/capper")
    ScalarNAFiller(inputCol="protein", outputCol="protein_f", filler=-1.0).write().overwrite().save(f"{path}/filler")
    out = ScalarNAFiller.load(f"{path}/filler").transform(ExtremeValueCapperModel.load(f"{path}/capper").transform(rows))
    return rounded(out.select("title", "sodium_c", "protein_f"), ["sodium_c"])


def custom_rows(t: Tables):
    clean = settled(R.cleaned(recipes(t.customer, t.orders), fill_binaries=False))
    return P.with_ratios(clean, R.RATIOS, filler=None), R.telling_binaries(clean)


@query("ml_pipeline_custom", CUSTOM_SQL + " SELECT title, dessert, prediction FROM predicted")
def ml_pipeline_custom(t: Tables):
    rows, kept = custom_rows(t)
    _, predictions = R.fitted(rows, R.custom_stages(kept))
    return predictions.select("title", "dessert", "prediction")


@query(
    "ml_pipeline_save",
    RECIPES
    + f", filled AS (SELECT title, coalesce(protein, -1.0) AS protein_f, sodium FROM recipes) SELECT title, protein_f, {capped_sql('sodium', 1.0)} FROM filled",
)
def ml_pipeline_save(t: Tables):
    rows, path = measured(t), new_folder(t.spark, "fitted")
    stages = Pipeline(
        stages=[
            ScalarNAFiller(inputCol="protein", outputCol="protein_f", filler=-1.0),
            ExtremeValueCapper(inputCol="sodium", outputCol="sodium_c", boundary=1.0),
        ]
    )
    stages.fit(rows).write().overwrite().save(path)
    out = PipelineModel.load(path).transform(rows)
    return rounded(out.select("title", "protein_f", "sodium_c"), ["sodium_c"])
