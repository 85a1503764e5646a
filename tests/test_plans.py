"""Composite jobs on small frames, forms that must agree, and the plans Spark makes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.plans import airtime as A
from tidemark.plans import drives as D
from tidemark.plans import shows as S
from tidemark.plans import weather as Wx
from tidemark.plans import words as W
from tidemark.plans.views import plan_text
from tidemark.registry import joins, projections, windows
from tidemark.sources.tables import drive_days, shows, weather

# ---- airtime ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def log(spark):
    rows = [("a", "COM ", 10), ("a", "XXX ", 30), ("b", "PRC ", 8), ("b", None, 2), ("c", "COM", 0), ("d", "XXX", 5)]
    return spark.createDataFrame(rows, "channel string, code string, seconds bigint")


def test_commercial_ratio(log):
    got = {r.channel: tuple(r)[1:] for r in A.commercial_ratio(log, ["channel"], "code", "seconds").collect()}
    assert got == {"a": (10, 40, 0.25), "b": (8, 10, 0.8), "c": (0, 0, None), "d": (0, 5, 0.0)}


def test_partly_counted_class_comes_first(log):
    got = {r.channel: r for r in A.commercial_ratio(log, ["channel"], "code", "seconds", partial=A.PARTIAL_CODE).collect()}
    assert got["b"].counted_seconds == 6.0
    assert got["a"].counted_seconds == 10.0


def test_ratio_histogram(log):
    ratios = A.commercial_ratio(log, ["channel"], "code", "seconds")
    assert {tuple(r) for r in A.ratio_histogram(ratios).collect()} == {(0.3, 1), (0.8, 1), (0.0, 2)}


def test_full_log_keeps_rows_without_lookup(spark):
    log = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "service_id int, class_id int")
    primary = spark.createDataFrame([(1, 7, "ch")], "service_id int, category_id int, channel string")
    categories = spark.createDataFrame([(8, "x")], "category_id int, category string")
    classes = spark.createDataFrame([(1, "COM")], "class_id int, class_code string")
    got = A.full_log(log, primary, categories, classes).select("class_id", "class_code", "category").collect()
    assert sorted(got, key=lambda r: r.class_id) == [(1, "COM", None), (2, None, None)]


# ---- drives -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def days(spark):
    gib = 1024**3
    rows = [("m", "s1", gib, "2020-01-01", 0), ("m", "s1", gib, "2020-01-03", 1), ("m", "s2", 2 * gib, "2020-01-01", 0)]
    rows += [("m", "s2", 2 * gib, "2020-01-02", 0), ("n", "s3", 4 * gib, "2020-02-01", 0), ("n", "s3", 4 * gib, "2020-02-01", 0)]
    return spark.createDataFrame(rows, "model string, serial_number string, capacity_bytes bigint, date string, failure int").withColumn(
        "date", F.to_date("date")
    )


def test_modal_capacity_takes_the_smaller_on_a_tie(days):
    got = {r.model: (r.capacity_bytes, r.occurrences) for r in D.modal_capacity(days).collect()}
    assert got == {"m": (1024**3, 2), "n": (4 * 1024**3, 2)}
    assert D.with_modal_capacity(days).count() == days.count()


def test_drive_answers(days, as_rows):
    assert as_rows(D.failure_rate(days)) == [("m", 4, 1, 0.25)]
    assert as_rows(D.reliability(days)) == [("m", 1.0, 0.5), ("m", 2.0, 0.0), ("n", 4.0, 0.0)]
    assert as_rows(D.capacity_drift(days)) == [("m", 1.0, 2.0)]
    assert as_rows(D.mean_age(days)) == [("m", 1.0, 2.0), ("m", 2.0, 1.0), ("n", 4.0, 0.0)]
    best = D.most_reliable(D.reliability(days), capacity_gib=2.0, precision=1.0, top_n=2)
    assert [tuple(r) for r in best.collect()] == [("n", 4.0, 0.0), ("m", 2.0, 0.0)]


def test_one_pass_equals_two_aggregates_joined(tables, as_rows):
    days = drive_days(tables.events)
    keys = ["model", "capacity_bytes"]
    one_pass = days.groupBy(*keys).agg(F.count("*").alias("drive_days"), F.count_if(F.col("failure") == 1).alias("failures"))
    assert as_rows(one_pass) == as_rows(joins.join_left_multikey(tables))


# ---- forms that agree ---------------------------------------------------------------------


def test_semi_join_equals_window_form(tables, as_rows):
    readings = weather(tables.events)
    by_window = Wx.rows_at_extreme(readings, ["year"], "temp").select(*Wx.READING)
    assert as_rows(Wx.coldest_by_semi_join(readings)) == as_rows(by_window)


def test_anti_join_equals_left_join_form(tables, as_rows):
    assert as_rows(joins.join_left_anti(tables)) == as_rows(joins.join_anti_as_left(tables))


def test_word_lengths_both_ways(tables, as_rows):
    fused, by_word = W.long_word_lengths(tables.documents, "text"), W.long_word_lengths_by_word(tables.documents, "text")
    assert as_rows(fused) == as_rows(by_word)


def test_show_spans_of_empty_and_single(spark, tables):
    spans = {r.id: r.duration_seconds for r in S.show_spans(shows(tables.documents)).collect()}
    sizes = {r.id: r.n for r in shows(tables.documents).selectExpr("id", "size(document.lines) AS n").collect()}
    assert spans == {k: (n - 1) * 7 * 86400 for k, n in sizes.items()}


def test_sliding_mean_equals_window(tables, as_rows):
    got = windows.win_range_month_index(tables)
    indexed = tables.orders.withColumn("i", F.year("o_orderdate") * 12 + F.month("o_orderdate"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_orderstatus").orderBy("i").rangeBetween(-1, 1)
    assert as_rows(got) == as_rows(indexed.select("o_orderkey", F.avg("o_custkey").over(w)))


# ---- plans --------------------------------------------------------------------------------


def exchanges(df) -> int:
    return plan_text(df).count("Arguments: hashpartitioning")


def test_fused_word_lengths_shuffle_once(tables):
    assert exchanges(W.long_word_lengths(tables.documents, "text")) == 1
    assert exchanges(W.long_word_lengths_by_word(tables.documents, "text")) == 2


def test_scan_reads_two_columns_and_pushes_the_filter(tables):
    plan = plan_text(tables.orders.where("o_totalprice > 1000").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_airtime_has_no_python_and_prunes(tables):
    from tidemark.registry.jobs import job_commercial_ratio

    plan = plan_text(job_commercial_ratio(tables))
    assert "Python" not in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in plan


def test_top_k_does_not_sort_everything(tables):
    top = W.most_frequent(W.word_counts(tables.documents, "text"), "word", 10)
    plan = plan_text(top)
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_unordered_windows_use_no_window_operator(tables):
    plan = plan_text(Wx.rows_at_extreme(weather(tables.events), ["year"], "temp"))
    assert "Window" not in plan


def test_filter_on_a_dropped_column(tables):
    assert "PushedFilters: [IsNotNull(s_acctbal)" in plan_text(projections.filter_on_dropped(tables))


def test_hot_service_is_split_at_run_time(spark):
    """Most log rows belong to one service: the shuffled join is cut into several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(0, 200_000, 1, 8)
        service = F.when(F.col("id") % 3 != 0, 1).otherwise(F.col("id") % 300)
        log = rows.select(service.alias("service_id"), (F.col("id") % 50).alias("class_id"), F.col("id").alias("seconds"))
        primary = spark.range(300).select(F.col("id").alias("service_id"), (F.col("id") % 7).alias("category_id"))
        categories = spark.range(7).select(F.col("id").alias("category_id"))
        classes = spark.range(50).select(F.col("id").alias("class_id"), F.lit("COM").alias("class_code"))
        totals = A.commercial_ratio(A.full_log(log, primary, categories, classes), ["category_id"], "class_code", "seconds")
        assert sum(r.all_seconds for r in totals.collect()) == sum(range(200_000))
        assert "skew=true" in totals._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
