"""Positions in ordered groups, for groups of any size.

A ranking window puts a whole group into one task. That is the right plan while groups are
moderate, and a dead end when one key holds a third of the rows. The functions here look at the
largest group first. Below the limit they use a plain window. Above it they range-partition the
rows by (keys, order), which spreads a large group over many tasks, number the rows inside each
piece, and add the sizes of the earlier pieces of the group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.storage import settled

LIMIT_SETTING = "spark.tidemark.window.maxGroupRows"
DEFAULT_LIMIT = 500_000


def group_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_SETTING, str(DEFAULT_LIMIT)))


def fits_one_task(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """Whether every group stays below the limit: one count with map-side combine."""
    limit = group_limit(df) if limit is None else limit
    sizes = df.groupBy(*keys).count()
    return sizes.where(F.col("count") > limit).isEmpty()


def same_keys(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Null-safe equality on all names; still an equi-join for the planner."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-key columns back onto the rows, keeping the rows' own key columns. Null keys meet.

    A hot key is split at run time, also where ``stats`` is an aggregate over the keys: null-safe equality is
    planned on derived keys, so both sides are shuffled for the join itself (``join_facts`` has the other case).
    """
    if not keys:
        whole = stats.select(F.struct(*stats.columns)).scalar()  # the one row of a global aggregate
        return df.withColumn("_whole", whole).select(
            *df.columns, *[F.col(f"_whole.{c}").alias(c) for c in stats.columns]
        )
    renamed = stats.select(
        *[F.col(k).alias(f"_{k}") for k in keys], *[c for c in stats.columns if c not in keys]
    )
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"_{k}"]) for k in keys])
    return df.join(renamed, on, how).drop(*[f"_{k}" for k in keys])


def join_facts(df: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Plain equi-join of rows with facts per key, such that a hot key among the rows is split at run time.

    The planner leaves out the shuffle of a side that an aggregate over the keys has already dealt out, and only
    joins with a shuffle right below each side are split. So the facts are written first. ``df`` must not
    be dealt out by the keys either: give it as it was read, or after another shuffle.
    """
    return df.join(settled(facts), list(keys), how)


def _order_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _pieces(written: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int | None) -> DataFrame:
    """Range-partitioned rows with the number of their piece, written once.

    There are enough pieces to keep one at about half the limit, however much data there is.
    """
    spark = written.sparkSession
    limit = group_limit(written) if limit is None else limit
    rows = written.count()  # from the file footers
    pieces = max(-(-2 * rows // limit), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = written.repartitionByRange(pieces, *[F.col(k) for k in keys], *order)
    return settled(ranged.withColumn("_piece", F.spark_partition_id()))


def _earlier_pieces(placed: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Totals of the earlier pieces of a group, for the pieces that have any.

    Pieces are ranges of (keys, order), so a boundary cuts at most one group: there are fewer rows
    here than pieces, however many groups there are.
    """
    per_piece = placed.groupBy(*keys, "_piece").agg(*[c.alias(n) for n, c in sums.items()])
    group = Window.partitionBy(*keys).orderBy("_piece")
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_piece.select(
        *keys, "_piece", F.row_number().over(group).alias("_nth"), *[F.sum(n).over(before).alias(f"_before_{n}") for n in sums]
    )
    return offsets.where("_nth > 1").drop("_nth")


def _with_offsets(local: DataFrame, offsets: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Raise the named columns of a piece by what the earlier pieces of its group hold."""
    joined = attach(local, offsets, [*keys, "_piece"], "left")  # fewer rows than pieces; Spark checks the size
    raised = {n: F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n in names}
    return joined.withColumns(raised).drop("_piece", *[f"_before_{n}" for n in names])


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str = "position",
    limit: int | None = None,
) -> DataFrame:
    """1-based row number per group. The order should be total to be reproducible."""
    order = _order_columns(order)
    if fits_one_task(df, keys, limit):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    # Equal rows must not end up in one piece, so the row's place in a written table breaks ties.
    # A task that is run again reads the same file split, so it marks its rows the same way.
    marked = settled(df).withColumn("_mark", F.monotonically_increasing_id())
    order = [*order, F.col("_mark")]
    placed = _pieces(marked, keys, order, limit)
    offsets = _earlier_pieces(placed, keys, {name: F.count("*")})
    within = Window.partitionBy(*keys, "_piece").orderBy(*order)
    local = placed.withColumn(name, F.row_number().over(within).cast("bigint"))
    return _with_offsets(local, offsets, keys, [name]).drop("_mark")


def ladder(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: dict[str, Column] | None = None,
    limit: int | None = None,
    descending: bool = False,
) -> DataFrame:
    """One row per distinct value of a group, with what lies below it.

    ``peers``: rows with the value; ``below``: rows with a smaller one; ``rung``: its place among
    the distinct values; for each entry of ``sums`` also ``<name>_upto``, the running total
    including the value. Copies of a value are combined before the first shuffle.
    """
    sums = sums or {}
    steps = df.groupBy(*keys, value).agg(F.count("*").alias("peers"), *[c.alias(n) for n, c in sums.items()])
    order = [F.col(value).desc() if descending else F.col(value).asc()]

    def climbed(frame: DataFrame, group_keys: Sequence[str]) -> DataFrame:
        group = Window.partitionBy(*group_keys).orderBy(*order)
        upto = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return frame.select(
            "*",
            (F.sum("peers").over(upto) - F.col("peers")).alias("below"),
            F.row_number().over(group).cast("bigint").alias("rung"),
            *[F.sum(n).over(upto).alias(f"{n}_upto") for n in sums],
        )

    steps = settled(steps)  # combined once; the size check and all later reads are of distinct values only
    if fits_one_task(steps, keys, limit):
        return climbed(steps, keys)
    placed = _pieces(steps, keys, order, limit)
    totals = {"below": F.sum("peers"), "rung": F.count("*"), **{f"{n}_upto": F.sum(n) for n in sums}}
    offsets = _earlier_pieces(placed, keys, totals)
    return _with_offsets(climbed(placed, [*keys, "_piece"]), offsets, keys, list(totals))


def group_sizes(df: DataFrame, keys: Sequence[str], name: str = "group_rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: dict[str, float],
    limit: int | None = None,
) -> DataFrame:
    """Interpolated quantiles per group, one column per entry of ``shares``; nulls are ignored.

    Works on distinct values with counts, so neither a large group nor a repeated value has to
    fit into one aggregation buffer.
    """
    known = df.where(F.col(value).isNotNull())
    steps = settled(ladder(known, keys, value, limit=limit))
    sized = attach(steps, settled(steps.groupBy(*keys).agg(F.sum("peers").alias("group_rows"))), keys)
    picks = []
    for name, share in shares.items():
        target = F.lit(float(share)) * (F.col("group_rows") - 1)
        low, high = F.floor(target), F.ceil(target)

        def value_at(place):
            return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("peers")), F.col(value)))

        picks += [value_at(low).alias(f"_low_{name}"), value_at(high).alias(f"_high_{name}")]
        picks.append(F.max(target - low).alias(f"_part_{name}"))
    picked = sized.groupBy(*keys).agg(*picks)
    return picked.select(
        *keys,
        *[
            (F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")).alias(n)
            for n in shares
        ],
    )


def collect_pages(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    item: Column,
    name: str = "items",
    page_rows: int = 10_000,
    limit: int | None = None,
) -> DataFrame:
    """Group rows into arrays of at most ``page_rows`` elements: columns keys, ``page``, ``name``.

    A group within the size gives one page, the usual collect_list. A larger one gives several
    pages, in order, so nothing is cut off and no array outgrows a task.
    """
    numbered = number_rows(df, keys, order, "_at", limit)
    page = F.floor((F.col("_at") - 1) / F.lit(page_rows)).cast("bigint")
    return (
        numbered.groupBy(*keys, page.alias("page"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col("_at"), item.alias("_item")))).alias("_sorted"))
        .select(*keys, "page", F.col("_sorted._item").alias(name))
    )
