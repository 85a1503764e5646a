"""Is it a dessert? Cleaning wide recipe rows, preparing features, fitting and judging a model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, MinMaxScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.features import evaluate as E
from tidemark.features import newton as N
from tidemark.features.prepare import preparation_stages, with_ratios
from tidemark.features.stages import ExtremeValueCapper, ScalarNAFiller
from tidemark.functions.numbers import capped
from tidemark.functions.text import is_number
from tidemark.operators.columns import with_tidy_names
from tidemark.operators.profile import percentiles, rare_columns
from tidemark.operators.reuse import reused
from tidemark.operators.rowsets import row_lot, split_rows
from tidemark.storage import new_folder, settled

# Energy in kilocalories per gram, and the caps set for a data set by looking at it.
KCAL_PER_GRAM = {"protein": 4.0, "fat": 9.0}
RECIPE_CAPS = {"calories": 3203.0, "protein": 173.0, "fat": 207.0, "sodium": 5661.0}

RATIOS = {f"{c}_ratio": (c, kcal, "calories") for c, kcal in KCAL_PER_GRAM.items()}


@dataclass(frozen=True)
class Roles:
    """Which column plays which part. All columns not named are binary."""

    identifier: str = "title"
    target: str = "dessert"
    continuous: tuple[str, ...] = ("rating", "calories", "protein", "fat", "sodium")
    imputed: tuple[str, ...] = ("calories", "protein", "fat", "sodium")
    textual: tuple[str, ...] = ("rating", "calories")
    checked: tuple[str, ...] = ("cakeweek", "wasteless")
    ratios: dict = field(default_factory=lambda: dict(RATIOS))

    def binaries(self, df: DataFrame) -> list[str]:
        others = {self.identifier, self.target, *self.continuous, *self.ratios}
        return [c for c in df.columns if c not in others]


ROLES = Roles()


def cleaned(raw: DataFrame, roles: Roles = ROLES, fill_binaries: bool = True) -> DataFrame:
    """Tidy names; rows with sane flags, a target and readable numbers; missing flags are 0."""
    df = with_tidy_names(raw)
    for name in roles.checked:
        df = df.where(F.col(name).isin(0.0, 1.0) | F.col(name).isNull())
    df = df.dropna(how="all", subset=[c for c in df.columns if c != roles.identifier])
    df = df.dropna(subset=[roles.target])
    for name in roles.textual:
        df = df.where(is_number(F.col(name)))
    df = df.withColumns({n: F.col(n).try_cast("double") for n in roles.textual})
    return df.fillna(0.0, subset=roles.binaries(df)) if fill_binaries else df


def upper_bounds(df: DataFrame, columns, share: float = 0.99) -> dict[str, float]:
    """A high percentile per column, as numbers: the look at the data before capping."""
    return {r["column"]: r["bound"] for r in percentiles(df, list(columns), {"bound": share}).collect()}


def with_caps(df: DataFrame, bounds: dict[str, float]) -> DataFrame:
    return df.withColumns({n: capped(F.col(n), b) for n, b in bounds.items()})


def telling_binaries(df: DataFrame, roles: Roles = ROLES, at_least: int = 10) -> list[str]:
    """The binary columns that are neither nearly always 0 nor nearly always 1, in input order."""
    names = roles.binaries(df)
    rare = {r["column"] for r in rare_columns(df, names, at_least).collect()}
    return [n for n in names if n not in rare]


def featured(raw: DataFrame, roles: Roles = ROLES, bounds: dict[str, float] | None = None) -> tuple[DataFrame, list[str]]:
    """Cleaned rows with caps and ratios, and the binary columns worth keeping.

    Without bounds the caps are the 99th percentiles; RECIPE_CAPS holds those set by hand.
    """
    clean = settled(cleaned(raw, roles))  # read several times below
    capped_rows = with_caps(clean, upper_bounds(clean, roles.imputed) if bounds is None else bounds)
    kept = telling_binaries(capped_rows, roles)
    rows = with_ratios(capped_rows, roles.ratios)
    return rows.select(roles.identifier, roles.target, *roles.continuous, *kept, *roles.ratios), kept


def model_stages(kept: list[str], roles: Roles = ROLES, **logistic) -> Pipeline:
    scaled_only = [c for c in roles.continuous if c not in roles.imputed]
    stages = preparation_stages(roles.imputed, scaled_only, [*kept, *roles.ratios])
    return Pipeline(stages=[*stages, E.logistic(roles.target, **logistic)])


def complete(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """Rows without a rating cannot be assembled."""
    return df.dropna(subset=[c for c in roles.continuous if c not in roles.imputed])


def parts(rows: DataFrame, roles: Roles = ROLES, share: float = 0.7, seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from and rows held back."""
    return split_rows(complete(rows, roles), [roles.identifier], share, seed)


def fitted(rows: DataFrame, stages: Pipeline, roles: Roles = ROLES, share: float = 0.7, seed: int = 13) -> tuple[PipelineModel, DataFrame]:
    """A model of the training part and its predictions for the other."""
    train, test = parts(rows, roles, share, seed)
    with reused(train) as kept:
        model = stages.fit(kept)
    return model, model.transform(test)


def model_columns(kept: list[str], roles: Roles = ROLES) -> list[str]:
    """The features in the order of the vector that ``model_stages`` assembles, on their own scale."""
    return [*kept, *roles.ratios, *[c for c in roles.continuous if c not in roles.imputed], *roles.imputed]


def newton_fitted(rows: DataFrame, kept: list[str], roles: Roles = ROLES, share: float = 0.7, seed: int = 13) -> tuple[N.Fit, DataFrame]:
    """A model of the training part by Newton steps, and its predictions for the other."""
    train, test = parts(rows, roles, share, seed)
    names = model_columns(kept, roles)
    fit = N.fitted(N.weighted_cells(train, roles.target, names), names, [N.Wanted()])[0]
    return fit, N.predicted(test, fit)


@dataclass(frozen=True)
class Search:
    """Every grid point on every fold, and the best point fitted to all training rows."""

    points: tuple[tuple[float, float], ...]
    areas: DataFrame
    best: int
    fit: N.Fit


def searched(train: DataFrame, kept: list[str], points=((0.01, 0.0), (0.01, 1.0)), folds: int = 3, seed: int = 13, roles: Roles = ROLES) -> Search:
    """Cross-validate (strength, mix) points; a row's fold follows from its key. One read of ``train``.

    All models, those for the folds and one of all rows for each point, are fitted in the same passes over
    the cells, and all held-back folds are scored in one. ``areas`` has (point, fold, n_rows, area_under_roc).
    """
    names = model_columns(kept, roles)
    cells = N.weighted_cells(train, roles.target, names, row_lot([roles.identifier], seed, folds))
    tried = [(p, f) for p in range(len(points)) for f in range(folds)]
    fits = N.fitted(cells, names, [N.Wanted(*points[p], f) for p, f in tried] + [N.Wanted(*p) for p in points])
    held = cells.select("fold", "label", "n", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    scores = [F.struct(F.lit(p).alias("point"), F.coalesce(*[F.when(F.col("fold") == f, fit.score()) for (q, f), fit in zip(tried, fits) if q == p]).alias("score")) for p in range(len(points))]
    scored = held.select("fold", "label", "n", F.inline(F.array(*scores)))
    sizes = cells.groupBy("fold").agg(F.sum("n").alias("n_rows"))
    areas = settled(E.areas_under_roc(scored, ["point", "fold"]).join(sizes, "fold").select("point", "fold", "n_rows", "area_under_roc"))
    means = {r.point: r.mean for r in areas.groupBy("point").agg(F.avg("area_under_roc").alias("mean")).collect()}
    best = max(sorted(means), key=lambda p: means[p])
    return Search(tuple(points), areas, best, fits[len(tried) + best])


def custom_stages(kept: list[str], roles: Roles = ROLES, boundary: float = 2.0) -> Pipeline:
    """The same model with filling and capping learned inside the pipeline."""
    continuous = list(roles.imputed)
    ratios = list(roles.ratios)
    filled = [f"{c}_i" for c in (*continuous, *ratios)]
    return Pipeline(
        stages=[
            ScalarNAFiller(inputCols=kept, outputCols=kept, filler=0.0),
            ExtremeValueCapper(inputCols=continuous, outputCols=continuous, boundary=boundary),
            Imputer(strategy="mean", inputCols=[*continuous, *ratios], outputCols=filled),
            VectorAssembler(inputCols=["rating", *[f"{c}_i" for c in continuous]], outputCol="continuous"),
            MinMaxScaler(inputCol="continuous", outputCol="continuous_scaled"),
            VectorAssembler(inputCols=[*kept, "continuous_scaled", *[f"{c}_i" for c in ratios]], outputCol="features"),
            E.logistic(roles.target, maxIter=300, tol=1e-12),
        ]
    )


def saved_and_loaded(spark, model: PipelineModel, predictions: DataFrame, rows: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """Predictions of the model after a round trip through storage, for the rows not trained on."""
    path = new_folder(spark, "model")
    model.write().overwrite().save(path)
    held_back = predictions.select(roles.identifier)
    return PipelineModel.load(path).transform(complete(rows, roles).join(held_back, roles.identifier, "left_semi"))
