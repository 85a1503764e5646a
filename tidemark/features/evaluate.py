"""How well predictions fit their labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline, PipelineModel
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import attach, ladder
from tidemark.operators.rowsets import row_lot
from tidemark.storage import settled


def logistic(label: str, **params) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol=label, predictionCol="prediction", **params)


def confusion(predictions: DataFrame, label: str, labels: Sequence[float] = (0.0, 1.0)) -> DataFrame:
    """Rows are labels, columns are predictions."""
    return predictions.groupBy(label).pivot("prediction", list(labels)).count().fillna(0)


def precision_recall(predictions: DataFrame, label: str, labels: Sequence[float] = (0.0, 1.0)) -> DataFrame:
    """(label, precision, recall), null where nothing was predicted or present; one pass."""
    truth, guess = F.col(label), F.col("prediction")

    def facts(value):
        hits = F.count_if((truth == value) & (guess == value))
        return F.struct(
            F.lit(float(value)).alias("label"),
            F.try_divide(hits, F.count_if(guess == value)).alias("precision"),
            F.try_divide(hits, F.count_if(truth == value)).alias("recall"),
        )

    return predictions.agg(F.array(*[facts(v) for v in labels]).alias("facts")).selectExpr("inline(facts)")


def _score_steps(predictions: DataFrame, label: str) -> DataFrame:
    """One row per different score, highest first: rows of either label with it and down to it."""
    scored = predictions.select(vector_to_array("rawPrediction")[1].alias("score"), F.col(label).alias("_label"))
    return ladder(scored, [], "score", {"hit": F.count_if(F.col("_label") == 1), "miss": F.count_if(F.col("_label") != 1)}, descending=True)


def area_under_roc(predictions: DataFrame, label: str) -> float:
    """The share of pairs of both labels that the score orders rightly, ties counting half; exact."""
    steps = _score_steps(predictions, label)
    # Per step: rows of label 0 with this score, times rows of label 1 with a higher one and half of the equal ones.
    won = F.sum(F.col("miss") * (F.col("hit_upto") - F.col("hit") / 2))
    return steps.agg(F.try_divide(won, (F.sum("hit") * F.sum("miss")).cast("double"))).head()[0]


def areas_under_roc(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, area_under_roc) for rows (keys, score, label, n), each counting n times; exact for every key at once."""
    sums = {"hit": F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)), "miss": F.sum(F.when(F.col("label") != 1, F.col("n")).otherwise(0))}
    steps = ladder(scored, keys, "score", sums, descending=True)
    won = F.sum(F.col("miss") * (F.col("hit_upto") - F.col("hit") / 2))
    return steps.groupBy(*keys).agg(F.try_divide(won, (F.sum("hit") * F.sum("miss")).cast("double")).alias("area_under_roc"))


class ExactArea(Evaluator):
    """area_under_roc as the measure of a search."""

    def __init__(self, label: str):
        super().__init__()
        self.label = label

    def _evaluate(self, dataset: DataFrame) -> float:
        return area_under_roc(dataset, self.label)

    def isLargerBetter(self) -> bool:
        return True


def roc_points(predictions: DataFrame, label: str) -> DataFrame:
    """(fpr, tpr) at each different score as threshold, and the corner above them all."""
    steps = settled(_score_steps(predictions, label))
    whole = steps.agg(F.sum("hit").alias("hits"), F.sum("miss").alias("misses"))
    placed = attach(steps, whole, [])
    rates = placed.select(F.try_divide("miss_upto", "misses").alias("fpr"), F.try_divide("hit_upto", "hits").alias("tpr"))
    return rates.unionAll(whole.select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def coefficients(model: LogisticRegressionModel, names: Sequence[str], spark) -> DataFrame:
    """Intercept and coefficients by name, smallest magnitude first."""
    values = [float(model.intercept), *[float(c) for c in model.coefficients.toArray()]]
    rows = [(n, c, abs(c)) for n, c in zip(["(intercept)", *names], values, strict=True)]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[2]), "name string, coef double, abs_coef double")


def penalty_grid(stage: LogisticRegression, strengths: Sequence[float] = (0.01,), mixes: Sequence[float] = (0.0, 1.0)) -> list[dict]:
    """Grid over the kind of penalty; its strength must not be 0, or the kind has no effect."""
    return ParamGridBuilder().addGrid(stage.regParam, list(strengths)).addGrid(stage.elasticNetParam, list(mixes)).build()


def cross_validated(stages: Pipeline, grid: list[dict], label: str, train: DataFrame, keys: Sequence[str], folds: int = 3, seed: int = 13, parallelism: int = 2) -> CrossValidatorModel:
    """A row's fold follows from its key alone, for any partitioning."""
    validator = CrossValidator(
        estimator=stages,
        estimatorParamMaps=grid,
        evaluator=ExactArea(label),
        numFolds=folds,
        foldCol="_fold",
        collectSubModels=True,
        parallelism=parallelism,
    )
    return validator.fit(train.withColumn("_fold", row_lot(keys, seed, folds).cast("int")))


def grid_scores(model: CrossValidatorModel, spark) -> DataFrame:
    """One row per grid point: its parameters and mean score over the folds."""
    rows = [
        (", ".join(sorted(f"{p.name}={v}" for p, v in point.items())), float(score))
        for point, score in zip(model.getEstimatorParamMaps(), model.avgMetrics)
    ]
    return spark.createDataFrame(rows, "params string, area_under_roc double")


def last_stage(model: PipelineModel) -> LogisticRegressionModel:
    return model.stages[-1]
