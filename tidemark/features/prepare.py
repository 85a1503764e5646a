"""Feature vectors: assembling, imputing, scaling, correlating."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio


def assemble(df: DataFrame, columns: Sequence[str], output: str) -> DataFrame:
    """A vector column from the rows that have every value."""
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df.dropna(subset=list(columns)))


def vector_columns(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """The elements of a vector as columns of their own."""
    unpacked = vector_to_array(vector)
    return df.withColumns({n: unpacked[i] for i, n in enumerate(names)}).drop(vector)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns as rows (a, b, r)."""
    matrix = Correlation.corr(assemble(df.select(*columns), columns, "_features"), "_features").head()[0].toArray()
    pairs = [(a, b, float(matrix[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(pairs, "a string, b string, r double")


def impute_mean(df: DataFrame, columns: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    return Imputer(strategy="mean", inputCols=list(columns), outputCols=list(outputs)).fit(df).transform(df)


def min_max(df: DataFrame, columns: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """Each column scaled to 0..1; 0.5 where all values are the same."""
    assembled = assemble(df, columns, "_raw")
    scaled = MinMaxScaler(inputCol="_raw", outputCol="_scaled").fit(assembled).transform(assembled)
    return vector_columns(scaled, "_scaled", outputs).drop("_raw")


def with_ratios(df: DataFrame, ratios: dict[str, tuple[str, float, str]], filler: float | None = 0.0) -> DataFrame:
    """New columns part * weight / whole: ``{name: (part, weight, whole)}``.

    An undefined ratio becomes the filler; with None it stays null.
    """
    shares = {n: ratio(F.col(part) * weight, F.col(whole)) for n, (part, weight, whole) in ratios.items()}
    df = df.withColumns(shares)
    return df if filler is None else df.fillna(filler, subset=list(shares))


def preparation_stages(imputed: Sequence[str], scaled_only: Sequence[str], unscaled: Sequence[str]) -> list:
    """Impute, assemble, scale, and assemble again into ``features``.

    ``imputed`` columns get their mean for null and are scaled together with ``scaled_only``;
    ``unscaled`` columns enter as they are.
    """
    filled = [f"{c}_i" for c in imputed]
    return [
        Imputer(strategy="mean", inputCols=list(imputed), outputCols=filled),
        VectorAssembler(inputCols=[*scaled_only, *filled], outputCol="continuous"),
        MinMaxScaler(inputCol="continuous", outputCol="continuous_scaled"),
        VectorAssembler(inputCols=[*unscaled, "continuous_scaled"], outputCol="features"),
    ]


def prepare(df: DataFrame, imputed: Sequence[str], scaled_only: Sequence[str], unscaled: Sequence[str]) -> DataFrame:
    return Pipeline(stages=preparation_stages(imputed, scaled_only, unscaled)).fit(df).transform(df)


def feature_names(df: DataFrame, vector: str = "features") -> list[str]:
    """Names of the vector's elements, in order, from the column's metadata."""
    groups = df.schema[vector].metadata["ml_attr"]["attrs"]
    return [a["name"] for a in sorted((a for g in groups.values() for a in g), key=lambda a: a["idx"])]
