"""Views by name in the session catalog."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def temp_view_names(spark: SparkSession) -> list[str]:
    return sorted(v.name for v in spark.catalog.listTables() if v.isTemporary)


def sql_or_none(spark: SparkSession, text: str) -> DataFrame | None:
    """The frame of a SQL text, or None if it names something that does not exist."""
    try:
        return spark.sql(text)
    except AnalysisException:
        return None


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The plan explain() prints, as a string."""
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(
        jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )
