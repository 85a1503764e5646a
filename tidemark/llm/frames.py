"""Small steps shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import os
import sys
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.storage import settled

BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20

__all__ = ["settled", "id_lot", "lot_of", "in_batches", "in_streams", "carried", "read_table", "only"]


def id_lot(column: str, n: int) -> Column:
    """crc32 of the identifier as text, modulo n: the fold of a row. Null has no fold."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def lot_of(value, n: int) -> int | None:
    return None if value is None else zlib.crc32(str(value).encode()) % n


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, so that extra ones (of any name) never reach an operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def _prepare(spark: SparkSession) -> None:
    """Small batches, as rows are whole texts. Workers look for this package where the driver has it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # not set by the user
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), root])


def _given_back() -> None:
    """Return freed memory to the system: workers stay on for other tasks beside the next ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, keeps_words: bool = False) -> DataFrame:
    """Apply ``work`` to each Arrow batch; empty batches are skipped.

    Without ``keeps_words`` a worker first drops the table of words that other steps may have left in it.
    """

    return in_streams(df, lambda batches: map(work, batches), schema, keeps_words)


def in_streams(df: DataFrame, work: Callable[[Iterator], Iterator], schema: str | T.StructType, keeps_words: bool = False) -> DataFrame:
    """Like ``in_batches``, for work that needs the batches of a partition one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps_words and (words := sys.modules.get("tidemark.llm.word_tokens")):
            words.encoder.cache_clear()
        yield from work(batch for batch in batches if batch.num_rows)
        _given_back()

    _prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def carried(docs: DataFrame, names: tuple[str, ...], schema: str) -> T.StructType:
    """A schema with the named columns of ``docs`` behind it."""
    return T.StructType([*T.StructType.fromDDL(schema).fields, *(T.StructField(n, docs.schema[n].dataType) for n in names)])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
