"""Splits of a frame by rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_lot(keys: Sequence[str], seed: int = 0, lots: int = 10_000) -> Column:
    """A number below ``lots`` that depends only on the key and the seed."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % lots


def split_rows(df: DataFrame, keys: Sequence[str], share: float, seed: int = 0, lots: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Two parts of about ``share`` and ``1 - share``.

    A row's part follows from its key alone. It is the same in every run, for every partitioning
    and after the loss of an executor, which a random draw per partition does not give.
    """
    lot = row_lot(keys, seed, lots)
    bound = int(share * lots)
    return df.where(lot < bound), df.where(lot >= bound)
