"""Python on groups in ways that scale: partial results before the shuffle, and growing frames in one stream.

A grouped Python function sees a group only as a whole, so its raw rows are shuffled to one worker, and over
a growing frame it gets every row of the group anew for each row. ``partial_results`` runs Python on Arrow batches
where the rows lie, and the JVM adds up what it gives. ``grown`` sends every row to Python once, in order,
to a state that takes values in and gives its result at any time.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from heapq import heappush, heappushpop

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import attach
from tidemark.storage import settled

# Workers receive the functions of this module by value, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def partial_results(df: DataFrame, partial: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """``partial`` in Python on each Arrow batch where it lies: the first of two phases of an aggregate.

    It turns a batch into mergeable partial results (``schema``), a row per key at best; the JVM adds those up.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pandas(partial(batch.to_pandas()), preserve_index=False)

    return df.mapInArrow(work, schema)


def line_moments(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, n, mx, my, sxx, sxy) of the pairs in each Arrow batch: count, means, and products about the means.

    Pairs with a null or NaN are left out.
    """
    pairs = df.select(*keys, *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(n) for c, n in ((x, "_x"), (y, "_y"))])
    pairs = pairs.where("_x is not null and _y is not null")
    names = list(keys)

    def moments(batch: pd.DataFrame) -> pd.DataFrame:
        key = batch.groupby(names, dropna=False, sort=False).ngroup().to_numpy() if names else np.zeros(len(batch), int)
        a, b, n = batch["_x"].to_numpy(), batch["_y"].to_numpy(), np.bincount(key)
        mx, my = np.bincount(key, a) / n, np.bincount(key, b) / n
        da, db = a - mx[key], b - my[key]
        _, first = np.unique(key, return_index=True)
        return batch[names].iloc[first].assign(n=n, mx=mx, my=my, sxx=np.bincount(key, da * da), sxy=np.bincount(key, da * db))

    fields = [*(pairs.schema[k] for k in names), T.StructField("n", T.LongType()), *(T.StructField(m, T.DoubleType()) for m in ("mx", "my", "sxx", "sxy"))]
    return partial_results(pairs, moments, T.StructType(fields))


def fitted_lines(df: DataFrame, keys: Sequence[str], x: str, y: str, slope: str = "slope", intercept: str = "intercept") -> DataFrame:
    """Least-squares line of each group, by moments of Arrow batches; raw rows are not shuffled.

    Pairs with a null or NaN count as in regr_slope: not at all; a group without others has no row. Both results are
    null where x does not vary. Moments of batches are moved to the group's own means before they are added, so a
    large offset costs no digits.
    """
    names, n = list(keys), F.col("n")
    parts = settled(line_moments(df, names, x, y))
    means = [(F.sum(n * F.col(m)) / F.sum("n")).alias(f"_{m}") for m in ("mx", "my")]
    centres = parts.groupBy(*names).agg(F.sum("n").alias("_n"), *means).where("_n > 0")
    near = attach(parts, settled(centres) if names else centres, names)
    dx, dy = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    sums = near.groupBy(*names).agg(
        F.sum(F.col("sxx") + n * dx * dx).alias("_sxx"), F.sum(F.col("sxy") + n * dx * dy).alias("_sxy"), *[F.max(c).alias(c) for c in ("_n", "_mx", "_my")]
    )
    # Rounding leaves a trace of spread where x is one value; it lies far below the square of that value.
    varies = (F.col("_n") > 1) & (F.col("_sxx") > 1e-28 * F.col("_n") * F.col("_mx") * F.col("_mx"))
    fitted = sums.withColumn(slope, F.when(varies, F.col("_sxy") / F.col("_sxx")))
    return fitted.select(*names, slope, (F.col("_my") - F.col(slope) * F.col("_mx")).alias(intercept))


class GrowingMean:
    """Mean of the values so far."""

    def __init__(self):
        self.total, self.n = 0.0, 0

    def add(self, values: np.ndarray) -> None:
        self.total += float(values.sum())
        self.n += len(values)

    def result(self) -> float | None:
        return self.total / self.n if self.n else None


class GrowingMedian:
    """Median of the values so far: two heaps that meet in the middle, a logarithmic step per value."""

    def __init__(self):
        self.low, self.high = [], []  # the lower half negated, and the upper half

    def add(self, values: np.ndarray) -> None:
        for v in values.tolist():
            if len(self.low) > len(self.high):
                heappush(self.high, -heappushpop(self.low, -v))
            else:
                heappush(self.low, -heappushpop(self.high, v))

    def result(self) -> float | None:
        if not self.low:
            return None
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2


def grown(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, state: Callable) -> DataFrame:
    """One row per group and step of ``order``: ``state`` over the values of the step and all before it.

    ``state()`` has ``add(values)`` and ``result()``; nulls and NaN are not added. Rows of one step share the result, as
    peers of a range window do, and null steps come first. Rows are sorted by Spark and streamed: a worker
    holds one batch and the state of one group, so a group may have as many rows as its state can hold.
    """
    names = [*keys, *order]
    rows = df.select(*names, F.col(value).cast("double").alias("_v"))
    dealt = rows.repartition(*keys) if keys else rows.coalesce(1)
    schema = T.StructType([*(df.schema[n] for n in names), T.StructField(name, T.DoubleType())])
    n_keys = len(keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = open_step = None
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(float)
            step = list(zip(*[_alike(batch.column(i)) for i in range(len(names))]))
            ends = [i for i in range(1, len(step)) if step[i] != step[i - 1]] + [len(step)]
            done, at = [], 0
            for end in ends:
                if step[at] != open_step:
                    if open_step is not None:
                        done.append((*open_step, now.result()))
                    if open_step is None or step[at][:n_keys] != open_step[:n_keys]:
                        now = state()
                    open_step = step[at]
                part = v[at:end]
                now.add(part[~np.isnan(part)])
                at = end
            if done:
                yield _rows(done, batch, name)
            last = batch
        if open_step is not None:
            yield _rows([(*open_step, now.result())], last, name)

    return dealt.sortWithinPartitions(*names).mapInArrow(work, schema)


_NAN = float("nan")


def _alike(column: pa.Array) -> list:
    """Values that are equal where Spark calls them so: every NaN is the same object."""
    values = column.to_pylist()
    return [_NAN if v != v else v for v in values] if pa.types.is_floating(column.type) else values


def _rows(rows: list[tuple], like: pa.RecordBatch, name: str) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [*(like.schema.field(i).type for i in range(len(columns) - 1)), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*like.schema.names[: len(columns) - 1], name])
