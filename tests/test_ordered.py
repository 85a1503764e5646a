"""Large groups: the split forms give the rows of the plain windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import ordered as O
from tidemark.operators import windows as W


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most of the rows, half of them copies, plus small groups and a null key."""
    rng = random.Random(7)
    data = [("hot", 5, i) for i in range(150)]
    data += [("hot", rng.randrange(40), 150 + i) for i in range(150)]
    data += [("mild", rng.randrange(6), 300 + i) for i in range(20)]
    data += [("one", 3, 400), (None, 2, 401), (None, 1, 402), ("mild", None, 403)]
    return spark.createDataFrame(data, "k string, v int, id int").repartition(5).cache()


def test_sizes(skewed):
    assert not O.fits_one_task(skewed, ["k"], 20)
    assert O.fits_one_task(skewed, ["k"], 300)
    assert not O.fits_one_task(skewed, [], 300)


def test_number_rows(skewed, as_rows):
    expected = skewed.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")))
    for limit in (10, 10_000):
        assert as_rows(O.number_rows(skewed, ["k"], ["v", "id"], "n", limit)) == as_rows(expected)


def test_number_rows_without_key(skewed, as_rows):
    expected = skewed.withColumn("n", F.row_number().over(Window.orderBy("id")))
    assert as_rows(O.number_rows(skewed, [], ["id"], "n", 10)) == as_rows(expected)


def test_number_rows_of_copies(spark):
    copies = spark.createDataFrame([("a", 1)] * 200, "k string, v int").repartition(4)
    numbers = O.number_rows(copies, ["k"], ["v"], "n", 10).select("n").collect()
    assert sorted(r.n for r in numbers) == list(range(1, 201))


def test_large_group_is_spread(skewed):
    placed = O._pieces(skewed, ["k"], [F.col("v"), F.col("id")], 50)
    sizes = placed.where("k = 'hot'").groupBy("_piece").count().collect()
    assert len(sizes) > 4 and max(r["count"] for r in sizes) <= 50


@pytest.mark.parametrize("descending", [False, True])
def test_ranks(skewed, as_rows, descending):
    w = Window.partitionBy("k").orderBy(F.col("v").desc() if descending else F.col("v"))
    expected = skewed.select(
        "*",
        F.rank().over(w).cast("bigint").alias("r"),
        F.dense_rank().over(w).cast("bigint").alias("d"),
        F.percent_rank().over(w).alias("p"),
        F.cume_dist().over(w).alias("c"),
    )
    for limit in (5, 10_000):
        got = W.with_ranks(skewed, ["k"], "v", "r", "d", "p", "c", descending, limit)
        assert as_rows(got) == as_rows(expected)


@pytest.mark.parametrize("buckets", [1, 3, 7, 500])
def test_ntile(skewed, as_rows, buckets):
    w = Window.partitionBy("k").orderBy("v", "id")
    expected = skewed.withColumn("t", F.ntile(buckets).over(w).cast("bigint"))
    assert as_rows(W.with_ntile(skewed, ["k"], ["v", "id"], buckets, "t", 10)) == as_rows(expected)


def test_lags(skewed, as_rows):
    w = Window.partitionBy("k").orderBy("v", "id")
    expected = skewed.withColumns({"a": F.lag("v", 1).over(w), "b": F.lag("v", 2).over(w)})
    got = W.with_lags(skewed, ["k"], ["v", "id"], "v", {"a": 1, "b": 2}, 10)
    assert as_rows(got) == as_rows(expected)


def test_running_mean(skewed, as_rows):
    expected = skewed.withColumn("m", F.avg("v").over(Window.partitionBy("k").orderBy("v")))
    for limit in (5, 10_000):
        assert as_rows(W.with_running_mean(skewed, ["k"], "v", "m", limit)) == as_rows(expected)


@pytest.mark.parametrize("limit", [5, 10_000])
def test_exact_quantiles(skewed, limit):
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r.k: r for r in O.exact_quantiles(skewed, ["k"], "v", shares, limit).collect()}
    expected = skewed.groupBy("k").agg(*[F.percentile("v", s).alias(n) for n, s in shares.items()]).collect()
    for row in expected:
        for name in shares:
            assert got[row.k][name] == pytest.approx(row[name])


@pytest.mark.parametrize("limit", [3, 10_000])
def test_sliding(spark, as_rows, limit):
    rng = random.Random(3)
    data = [("a", rng.randrange(-60_000, 60_000), i) for i in range(300)] + [("b", i // 3, i) for i in range(90)]
    df = spark.createDataFrame(data, "k string, at int, v int")
    w = Window.partitionBy("k").orderBy("at").rangeBetween(-700, 300)
    expected = df.select("k", "at", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m")).distinct()
    got = W.sliding(df, ["k"], "at", 700, 300, {"s": F.sum("v")}, {"m": F.max("v")}, limit)
    assert as_rows(got) == as_rows(expected)


def test_sliding_row_counts(skewed, as_rows):
    w = Window.orderBy("id").rowsBetween(-2, 2)
    expected = skewed.withColumn("n", F.count("*").over(w))
    for limit in (10, 10_000):
        assert as_rows(W.sliding_row_counts(skewed, ["id"], 2, 2, "n", limit)) == as_rows(expected)


def test_collect_pages_keeps_every_row(skewed):
    pages = O.collect_pages(skewed, ["k"], ["v", "id"], F.col("id"), "ids", page_rows=16, limit=10)
    got = sorted(i for r in pages.collect() for i in r.ids)
    assert got == sorted(r.id for r in skewed.select("id").collect())
    assert pages.agg(F.max(F.size("ids"))).head()[0] <= 16


def test_one_page_is_the_plain_list(skewed, as_rows):
    pages = O.collect_pages(skewed, ["k"], ["id"], F.col("id"), "ids").drop("page")
    plain = skewed.groupBy("k").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    assert as_rows(pages) == as_rows(plain)


def test_group_stats_and_median(skewed, as_rows):
    w = Window.partitionBy("k")
    expected = skewed.select("*", F.max("v").over(w).alias("m"), F.median("v").over(w).alias("med"))
    got = W.with_group_median(W.with_group_stats(skewed, ["k"], m=F.max("v")), ["k"], "v", "med")
    assert as_rows(got) == as_rows(expected)


@pytest.mark.parametrize("limit", [3, 10_000])
def test_sliding_means_and_maxima(spark, as_rows, limit):
    rng = random.Random(5)
    df = spark.createDataFrame([(k, rng.randrange(60), rng.randrange(9), i) for k in "ab" for i in range(50)], "k string, at int, v int, id int")
    w = Window.partitionBy("k").orderBy("at").rangeBetween(-4, 4)
    expected = df.select("*", F.avg("v").over(w).alias("m"), F.max("v").over(w).alias("x"))
    got = W.with_sliding_max(W.with_sliding_mean(df, ["k"], "at", "v", 4, "m", limit), ["k"], "at", "v", 4, "x", limit)
    assert as_rows(got) == as_rows(expected)


@pytest.mark.parametrize("limit, buckets", [(5, 4), (5, 100), (40, 7), (10_000, 100)])
def test_growing_median(spark, as_rows, limit, buckets):
    rng = random.Random(11)
    data = [("big", rng.randrange(12), float(rng.randrange(500)), i) for i in range(400)]
    data += [("big", rng.randrange(12), 77.0, 400 + i) for i in range(200)]
    data += [("small", i % 3, float(i), 600 + i) for i in range(9)] + [("one", 1, 5.0, 700), ("big", 3, None, 701), ("none", 1, None, 702)]
    df = spark.createDataFrame(data, "k string, at int, v double, id int").repartition(4)
    w = Window.partitionBy("k").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    expected = df.withColumn("m", W.middle(F.collect_list("v").over(w)))
    assert as_rows(W.with_growing_median(df, ["k"], "at", "v", "m", limit, buckets)) == as_rows(expected)


def test_growing_median_without_key(spark, as_rows):
    df = spark.createDataFrame([(i % 5, float((i * 37) % 101)) for i in range(200)], "at int, v double")
    expected = W.growing(df.withColumn("k", F.lit(1)), ["k"], ["at"], W.middle, m="v").drop("k")
    assert as_rows(W.with_growing_median(df, [], "at", "v", "m", 20, 8)) == as_rows(expected)


# One answer, and one schema, for every group size: null keys, null steps, null values and ties.

LIMITS = [1, 10, 10_000]


@pytest.fixture(scope="module")
def ragged(spark):
    rng = random.Random(21)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(12)]), rng.choice([None, 1, 1, 2, 5, 9]), i) for i in range(160)]
    return spark.createDataFrame(rows, "k string, at int, v int, id int").repartition(5)


def same_for_all_limits(as_rows, make, expected=None):
    frames = [make(limit) for limit in LIMITS]
    wanted = as_rows(expected if expected is not None else frames[-1])
    for frame in frames:
        assert [(f.name, f.dataType) for f in frame.schema.fields] == [(f.name, f.dataType) for f in frames[-1].schema.fields]
        assert as_rows(frame) == wanted


def test_row_numbers_of_any_group_size(ragged, as_rows):
    same_for_all_limits(as_rows, lambda limit: O.number_rows(ragged, ["k"], ["at", "v", "id"], "n", limit))


def test_sliding_of_any_group_size(ragged, as_rows):
    w = Window.partitionBy("k").orderBy("at").rangeBetween(-2, 1)
    expected = ragged.select("k", "at", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m")).distinct()
    same_for_all_limits(as_rows, lambda limit: W.sliding(ragged, ["k"], "at", 2, 1, {"s": F.sum("v")}, {"m": F.max("v")}, limit), expected)


def test_sliding_means_and_maxima_of_any_group_size(ragged, as_rows):
    w = Window.partitionBy("k").orderBy("at").rangeBetween(-3, 3)
    expected = ragged.withColumn("m", F.avg("v").over(w))
    same_for_all_limits(as_rows, lambda limit: W.with_sliding_mean(ragged, ["k"], "at", "v", 3, "m", limit), expected)
    expected = ragged.withColumn("m", F.max("v").over(w))
    same_for_all_limits(as_rows, lambda limit: W.with_sliding_max(ragged, ["k"], "at", "v", 3, "m", limit), expected)


def test_growing_median_of_any_group_size(ragged, as_rows):
    w = Window.partitionBy("k").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    expected = ragged.withColumn("m", W.middle(F.collect_list(F.col("v").cast("double")).over(w)))
    same_for_all_limits(as_rows, lambda limit: W.with_growing_median(ragged.withColumn("v", F.col("v").cast("double")), ["k"], "at", "v", "m", limit, 5), expected.withColumn("v", F.col("v").cast("double")))


def test_ranks_of_any_group_size(ragged, as_rows):
    same_for_all_limits(as_rows, lambda limit: W.with_ranks(ragged, ["k"], "v", "r", "d", "p", "c", limit=limit))


def test_pages_of_any_group_size(ragged, as_rows):
    same_for_all_limits(as_rows, lambda limit: O.collect_pages(ragged, ["k"], ["id"], F.col("v"), "vs", 7, limit))


def test_row_counts_of_any_group_size(ragged, as_rows):
    w = Window.orderBy("id").rowsBetween(-4, 2)
    same_for_all_limits(as_rows, lambda limit: W.sliding_row_counts(ragged, ["id"], 4, 2, "n", limit), ragged.withColumn("n", F.count("*").over(w)))
    tied = ragged.select("at")
    for limit in LIMITS:
        got = as_rows(W.sliding_row_counts(tied, ["at"], 4, 2, "n", limit))
        counts = as_rows(tied.withColumn("n", F.count("*").over(Window.orderBy("at").rowsBetween(-4, 2))))
        assert got == counts


def test_steps_must_be_integers(ragged):
    with pytest.raises(ValueError):
        W.sliding(ragged.withColumn("at", F.col("at") / 2), ["k"], "at", 1, 1)


def test_facts_per_group_do_not_shuffle_the_rows(spark, ragged):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        plan = W.with_group_stats(ragged, ["k"], m=F.max("v"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning(coalesce(k" not in plan


# ---- hot keys

SPLIT_EARLY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture
def split_early(spark):
    before = {k: spark.conf.get(k) for k in SPLIT_EARLY}
    for k, v in SPLIT_EARLY.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def is_split(df) -> bool:
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


HOT_FORMS = {
    "join_facts": lambda rows: O.join_facts(rows, rows.groupBy("k").agg(F.count("*").alias("n")), ["k"]),
    "attach": lambda rows: O.attach(rows, rows.groupBy("k").agg(F.count("*").alias("n")), ["k"]),
    "with_ranks": lambda rows: W.with_ranks(rows, ["k"], "v", rank="r", percent_rank="p", limit=5_000),
    "with_ntile": lambda rows: W.with_ntile(rows, ["k"], ["id"], 4, "t", limit=5_000),
    "with_running_mean": lambda rows: W.with_running_mean(rows, ["k"], "v", "m", limit=5_000),
    "with_group_stats": lambda rows: W.with_group_stats(rows, ["k"], n=F.count("*")),
}


@pytest.mark.parametrize("form", HOT_FORMS)
def test_a_hot_key_is_split_at_run_time(spark, split_early, form):
    id_ = F.col("id")
    rows = O.settled(spark.range(60_000).select("id", F.when(id_ % 2 == 0, F.lit(7)).otherwise(id_ % 1000).alias("k"), F.when(id_ % 2 == 0, F.lit(0)).otherwise(id_ % 50).alias("v")))
    assert is_split(HOT_FORMS[form](rows))


def test_a_plain_join_with_an_aggregate_is_not_split(spark, split_early):
    """Why join_facts writes the facts first."""
    id_ = F.col("id")
    rows = O.settled(spark.range(60_000).select("id", F.when(id_ % 2 == 0, F.lit(7)).otherwise(id_ % 1000).alias("k")))
    facts = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert not is_split(rows.join(facts, "k"))
    assert sorted(map(tuple, rows.join(facts, "k").collect())) == sorted(map(tuple, O.join_facts(rows, facts, ["k"]).collect()))
