"""Window results that hold up when a group is large.

Unordered windows become an aggregate joined back. Ordered ones use the built-in function while
every group fits into one task, and positions from operators.ordered beyond that. Sliding frames
over integers are computed per distinct step, in overlapping buckets when there are many steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.arrow_groups import GrowingMean, GrowingMedian, grown
from tidemark.operators.ordered import attach, exact_quantiles, fits_one_task, group_sizes, ladder, number_rows, same_keys
from tidemark.storage import settled


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Same as each aggregate over an unordered partition."""
    facts = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    # Written first, so that the planner knows how small they are and need not shuffle the rows by key.
    return attach(df, settled(facts) if keys else facts, keys)


def with_group_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    medians = exact_quantiles(df, keys, value, {name: 0.5})
    return attach(df, settled(medians) if keys else medians, keys, "left")


def with_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    rank: str | None = None,
    dense_rank: str | None = None,
    percent_rank: str | None = None,
    cume_dist: str | None = None,
    descending: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Add the wanted ranks of a value in its group under the given names."""
    if fits_one_task(df, keys, limit):
        w = Window.partitionBy(*keys).orderBy(F.col(value).desc() if descending else F.col(value).asc())
        wanted = {
            rank: F.rank().over(w).cast("bigint"),
            dense_rank: F.dense_rank().over(w).cast("bigint"),
            percent_rank: F.percent_rank().over(w),
            cume_dist: F.cume_dist().over(w),
        }
        return df.select("*", *[c.alias(n) for n, c in wanted.items() if n is not None])
    steps = ladder(df, keys, value, limit=limit, descending=descending)
    steps = attach(steps, steps.groupBy(*keys).agg(F.sum("peers").alias("_n")), keys)
    below, peers, n = F.col("below"), F.col("peers"), F.col("_n")
    wanted = {
        rank: below + 1,
        dense_rank: F.col("rung"),
        percent_rank: F.when(n == 1, 0.0).otherwise(below / F.when(n > 1, n - 1)),
        cume_dist: (below + peers) / n,
    }
    places = steps.select(*keys, value, *[c.alias(n) for n, c in wanted.items() if n is not None])
    return attach(df, places, [*keys, value])


def with_ntile(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int, name: str, limit: int | None = None
) -> DataFrame:
    """Near-equal buckets; the first (rows mod buckets) of them hold one row more."""
    if fits_one_task(df, keys, limit):
        return df.withColumn(name, F.ntile(buckets).over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    numbered = attach(number_rows(df, keys, order, "_at", limit), group_sizes(df, keys, "_n"), keys)
    size = F.floor(F.col("_n") / buckets)
    longer = F.col("_n") - size * buckets
    at = F.col("_at") - 1
    in_long = at < longer * (size + 1)
    tile = F.when(in_long, F.floor(at / (size + 1))).otherwise(longer + F.floor(F.try_divide(at - longer * (size + 1), size)))
    return numbered.withColumn(name, (tile + 1).cast("bigint")).drop("_at", "_n")


def with_lags(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lags: dict[str, int], limit: int | None = None
) -> DataFrame:
    """Earlier values of the group: ``{new column: number of rows back}``."""
    if fits_one_task(df, keys, limit):
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: F.lag(value, back).over(w) for n, back in lags.items()})
    numbered = number_rows(df, keys, order, "_at", limit)
    for name, back in lags.items():
        earlier = numbered.select(*keys, (F.col("_at") + back).alias("_at"), F.col(value).alias(name))
        numbered = attach(numbered, earlier, [*keys, "_at"], "left")
    return numbered.drop("_at")


def with_running_mean(df: DataFrame, keys: Sequence[str], value: str, name: str, limit: int | None = None) -> DataFrame:
    """Mean of the group's values up to and including the current one; equal values share it."""
    if fits_one_task(df, keys, limit):
        return df.withColumn(name, F.avg(value).over(Window.partitionBy(*keys).orderBy(value)))
    steps = ladder(df, keys, value, {"_sum": F.sum(value), "_known": F.count(value)}, limit)
    means = steps.select(*keys, value, F.try_divide(F.col("_sum_upto"), F.col("_known_upto")).alias(name))
    return attach(df, means, [*keys, value])


def growing(df: DataFrame, keys: Sequence[str], order: Sequence[str], measure: Callable, **columns: str) -> DataFrame:
    """Apply ``measure(array of the values so far)`` as new columns.

    Every row holds the values before it, so this is for groups that are small by themselves, as
    a station and a year are (366 readings). Peers of the current row count as "so far".
    """
    w = Window.partitionBy(*keys).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({n: measure(F.collect_list(v).over(w)) for n, v in columns.items()})


def with_grown(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    state: Callable,
    whole: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """A Python aggregate over the group's values so far (peers included), and over the whole group as ``whole``.

    ``state`` is a class of functions.arrow_groups. Each row goes to Python once. Groups above the limit, which
    would keep one task busy, take built-in ways to the same results: GrowingMean from running totals,
    GrowingMedian from value buckets. Any other state has none and streams.
    """
    step = "_step"
    marked = df.withColumn(step, F.struct(*order))
    if state in (GrowingMean, GrowingMedian) and not fits_one_task(df, keys, limit):
        if state is GrowingMedian:
            found = settled(_growing_medians(marked, keys, step, value, name, 100))
        else:
            sums = ladder(marked, keys, step, {"_sum": F.sum(value), "_known": F.count(value)}, limit)
            found = settled(sums.select(*keys, step, F.try_divide("_sum_upto", "_known_upto").cast("double").alias(name)))
    else:
        found = settled(grown(df, keys, order, value, name, state).select(*keys, F.struct(*order).alias(step), name))
    rows = attach(marked, found, [*keys, step], "left").drop(step)
    if whole is None:
        return rows
    last = found.groupBy(*keys).agg(F.max_by(name, step).alias(whole))
    return attach(rows, settled(last) if keys else last, keys, "left")


def with_growing_median(
    df: DataFrame, keys: Sequence[str], step: str, value: str, name: str, limit: int = 500, buckets: int = 100
) -> DataFrame:
    """Median of the group's values at the current step and before; a step is a day or the like.

    Groups up to the limit gather their values. The rows of a larger group are dealt to value
    buckets; running counts per step and bucket tell which bucket holds the median of each step,
    and only that bucket's values are ranked for the step. Steps per group must be few (days of
    some years); rows per step and group may be any number.
    """
    if fits_one_task(df, keys, limit):
        return growing(df, keys, [step], middle, **{name: value})
    if not keys:
        hot = settled(df)
        return attach(hot, settled(_growing_medians(hot, keys, step, value, name, buckets)), [step], "left")
    large = settled(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).drop("_n"))
    on = same_keys(df, large, keys)
    hot, rest = settled(df.join(large, on, "left_semi")), df.join(large, on, "left_anti")
    medians = settled(_growing_medians(hot, keys, step, value, name, buckets))
    found = attach(hot, medians, [*keys, step], "left")
    return found.unionByName(growing(rest, keys, [step], middle, **{name: value}))


def _growing_medians(df: DataFrame, keys: Sequence[str], step: str, value: str, name: str, buckets: int) -> DataFrame:
    """(keys, step, name) for groups with many rows and few steps."""
    known = df.where(F.col(value).isNotNull())
    shares = F.array(*[F.lit((i + 1) / buckets) for i in range(buckets - 1)])
    cuts = settled(known.groupBy(*keys).agg(F.percentile_approx(value, shares).alias("_cuts")))
    counted = known.groupBy(*keys, step, value).agg(F.count("*").alias("_n"))
    bucket = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    placed = settled(attach(counted, cuts, keys).withColumn("_bucket", bucket).drop("_cuts"))

    # Running counts on the full grid of steps and buckets, small for each group.
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_bucket")
    grid = placed.select(*keys, step).distinct().select("*", every)
    filled = attach(grid, placed.groupBy(*keys, step, "_bucket").agg(F.sum("_n").alias("_n")), [*keys, step, "_bucket"], "left")
    by_step = Window.partitionBy(*keys, "_bucket").orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = filled.select(*keys, step, "_bucket", F.coalesce(F.sum("_n").over(by_step), F.lit(0)).alias("_n"))
    by_bucket = Window.partitionBy(*keys, step).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = so_far.select(
        "*",
        (F.sum("_n").over(by_bucket) - F.col("_n")).alias("_below"),
        F.sum("_n").over(Window.partitionBy(*keys, step)).alias("_all"),
    )

    # The two middle places of each step, as places within the bucket that holds them.
    place = F.explode(F.array(F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2))).alias("_place")
    inside = (F.col("_place") >= F.col("_below")) & (F.col("_place") < F.col("_below") + F.col("_n"))
    wanted = ranked.select(*keys, step, "_bucket", "_below", place).where(inside).distinct()
    targets = wanted.select(*keys, F.col(step).alias("_until"), F.col("_bucket"), "_place", (F.col("_place") - F.col("_below")).alias("_at"))
    # A null step comes before all others, as in a window.
    values = attach(placed, targets, [*keys, "_bucket"]).where(F.col(step).isNull() | (F.col(step) <= F.col("_until")))
    steps = ladder(values, [*keys, "_until", "_place", "_at"], value, {"_w": F.sum("_n")})
    hit = (F.col("_w_upto") - F.col("_w") <= F.col("_at")) & (F.col("_at") < F.col("_w_upto"))
    return steps.where(hit).groupBy(*keys, F.col("_until").alias(step)).agg(F.avg(value).alias(name))


def middle(values: Column) -> Column:
    """Median of an array."""
    ordered, n = F.sort_array(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    step: str,
    before: int,
    after: int,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One row per group and integer step, with totals and maxima over [step-before, step+after].

    Rows are first combined per step. Steps of a long group are dealt to buckets that overlap by
    the frame, so a bucket holds a bounded number of steps and sees its whole frame. Rows without a
    step are a frame of their own, as in a range window.
    """
    sums, maxima = sums or {}, maxima or {}
    if dict(df.dtypes)[step] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{step} must be an integer")
    steps = settled(
        df.groupBy(*keys, step).agg(*[c.alias(n) for n, c in sums.items()], *[c.alias(n) for n, c in maxima.items()])
    )

    def frames(w):
        return [F.sum(n).over(w).alias(n) for n in sums] + [F.max(n).over(w).alias(n) for n in maxima]

    if fits_one_task(steps, keys, limit):
        w = Window.partitionBy(*keys).orderBy(step).rangeBetween(-before, after)
        return steps.select(*keys, step, *frames(w))
    width = max(before + after + 1, 10_000)
    at = F.col(step)
    seen_by = F.sequence(F.floor((at - after) / width), F.floor((at + before) / width))
    dealt = steps.where(at.isNotNull()).withColumn("_bucket", F.explode(seen_by))
    w = Window.partitionBy(*keys, "_bucket").orderBy(step).rangeBetween(-before, after)
    framed = dealt.select(*keys, step, "_bucket", *frames(w)).where(F.col("_bucket") == F.floor(at / width)).drop("_bucket")
    # The type of a sum over sums may be wider than that of the sum itself.
    alone = steps.where(at.isNull()).select(*[F.col(f.name).cast(f.dataType) for f in framed.schema.fields])
    return framed.unionAll(alone)


def with_sliding_mean(
    df: DataFrame, keys: Sequence[str], step: str, value: str, reach: int, name: str, limit: int | None = None
) -> DataFrame:
    """Mean over the rows whose step lies within ``reach`` of the current row's."""
    totals = sliding(df, keys, step, reach, reach, {"_sum": F.sum(value), "_known": F.count(value)}, limit=limit)
    means = totals.select(*keys, step, F.try_divide(F.col("_sum"), F.col("_known")).alias(name))
    return attach(df, means, [*keys, step])


def with_sliding_max(
    df: DataFrame, keys: Sequence[str], step: str, value: str, reach: int, name: str, limit: int | None = None
) -> DataFrame:
    """Highest value within ``reach`` steps of the current row."""
    highest = sliding(df, keys, step, reach, reach, maxima={name: F.max(value)}, limit=limit)
    return attach(df, highest, [*keys, step])


def sliding_row_counts(df: DataFrame, order: Sequence[str], before: int, after: int, name: str, limit: int | None = None) -> DataFrame:
    """Rows within a distance of the current one in the order of the whole frame.

    Only the first and the last rows have fewer neighbours than the frame is wide, so only rows with
    the few values that lie there are numbered, and numbered within their value.
    """
    marked = df.withColumn("_step", F.struct(*order))
    steps = settled(ladder(marked, [], "_step", limit=limit).select("_step", "peers", "below"))
    n = steps.agg(F.coalesce(F.sum("peers"), F.lit(0))).head()[0]
    inside = (F.col("below") >= before) & (F.col("below") + F.col("peers") <= n - after)
    outer = settled(steps.where(~inside).select("_step", "below"))
    middle_rows = attach(marked, outer, ["_step"], "left").where("below is null").select(*df.columns, F.lit(before + after + 1).cast("bigint").alias(name))
    edge = number_rows(attach(marked, outer, ["_step"]), ["_step"], df.columns, "_at", limit)
    place = F.col("below") + F.col("_at")
    counts = F.least(place + after, F.lit(n)) - F.greatest(place - before, F.lit(1)) + 1
    return middle_rows.unionAll(edge.select(*df.columns, counts.cast("bigint").alias(name)))
