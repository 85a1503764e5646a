"""Text, CSV, JSON and Parquet scans, and CSV sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    quote: str = '"',
    schema: T.StructType | str | None = None,
    infer: bool = False,
    date_format: str | None = None,
) -> DataFrame:
    """A CSV file, folder or glob with a header. Inference reads the data twice: declare a schema
    where it is known. Without either, every column is a string."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", quote)
    if date_format is not None:
        reader = reader.option("timestampFormat", date_format).option("dateFormat", date_format)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def read_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    whole_files: bool = False,
    strict: bool = False,
) -> DataFrame:
    """JSON lines, or with ``whole_files`` one document (or array of documents) per file.

    ``strict`` fails on the first value that does not fit the declared schema.
    """
    reader = spark.read.option("multiLine", whole_files)
    if strict:
        reader = reader.option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_parquet_drifting(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Several Parquet folders as one table; a column missing somewhere is null there."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def json_column_schema(df: DataFrame, column: str) -> T.StructType:
    """The schema of all documents in a string column, merged by one distributed aggregate."""
    text = df.agg(F.schema_of_variant_agg(F.parse_json(column)).alias("s")).head().s
    return T._parse_datatype_string(text.replace("OBJECT<", "STRUCT<"))


def parse_json_column(df: DataFrame, column: str, name: str = "parsed") -> DataFrame:
    return df.withColumn(name, F.from_json(column, json_column_schema(df, column)))


def literal_rows(spark: SparkSession, rows: Sequence, schema) -> DataFrame:
    """A small lookup frame; its size is what the caller typed, so it may be broadcast."""
    return spark.createDataFrame(rows, schema, verifySchema=True)


def scalar_row(spark: SparkSession, value: int, name: str) -> DataFrame:
    return spark.createDataFrame([value], T.IntegerType()).toDF(name)


def write_csv(
    df: DataFrame, path: str, overwrite: bool = False, one_file: bool = False, options: Mapping[str, str] | None = None
) -> str:
    """Write with a header; an existing path is an error unless ``overwrite``.

    ``one_file`` is for frames already reduced to a report. It shuffles to one partition, so the
    work before it stays parallel, which coalesce(1) would not allow.
    """
    if one_file:
        df = df.repartition(1)
    mode = "overwrite" if overwrite else "errorifexists"
    df.write.mode(mode).options(header="true", **(options or {})).csv(path)
    return path
