"""Columns, files, views, profiles and splits."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import columns as C
from tidemark.operators import profile as P
from tidemark.operators.reuse import reused
from tidemark.operators.rowsets import split_rows
from tidemark.operators.views import named_views
from tidemark.plans.views import sql_or_none, temp_view_names
from tidemark.registry.scans import SHOW
from tidemark.sources import files
from tidemark.sources.tables import SCHEMAS, shows
from tidemark.storage import new_folder, settled, shared_folder


# ---- columns ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "name, expected",
    [("rare herb", "rare_herb"), ("quick-22 meals", "quick_22_meals"), ("a/b & c", "a_b_and_c"), ("plain", "plain"), ("é!?", "é")],
)
def test_tidy_name(name, expected):
    assert C.tidy_name(name) == expected


def test_tidy_names_must_stay_apart(spark):
    with pytest.raises(ValueError):
        C.with_tidy_names(spark.createDataFrame([(1, 2)], ["a b", "a-b"]))


def test_column_chunks_match_array_split(spark):
    for n in (1, 2, 3, 4, 7, 11, 12, 30):
        names = [f"c{i}" for i in range(n)]
        df = spark.range(1).select(*[F.lit(0).alias(c) for c in names])
        expected = [list(x) for x in np.array_split(np.array(names), max(1, n // 3))]
        assert C.column_chunks(df) == expected


def test_cast_by_prefix(spark):
    df = spark.createDataFrame([("12", "x", "1"), (None, "7", "2")], ["smart_1", "smart_2", "other"])
    got = C.cast_by_prefix(df, "smart", "bigint")
    assert got.dtypes == [("smart_1", "bigint"), ("smart_2", "bigint"), ("other", "string")]
    assert [tuple(r) for r in got.collect()] == [(12, None, "1"), (None, 7, "2")]


def test_common_columns(spark):
    a, b = spark.createDataFrame([(1, 2, 3)], ["x", "y", "z"]), spark.createDataFrame([(9, 8)], ["z", "x"])
    assert C.common_columns([a, b]) == ["x", "z"]
    assert sorted(tuple(r) for r in C.union_common([a, b]).collect()) == [(1, 3), (8, 9)]
    with pytest.raises(ValueError):
        C.common_columns([a, b], required=["y"])


def test_flat_fields():
    paths = [p for p, _, _ in C.flat_fields(SHOW)]
    assert paths[:4] == ["id", "genres", "document", "document.lines"]
    assert "document.lines.on_day" in paths


# ---- files and storage --------------------------------------------------------------------


def test_declared_schemas_fit_the_files(spark, tables):
    for name in SCHEMAS:
        found = spark.read.parquet(f"{tables.folder}/{name}.parquet")
        assert getattr(tables, name).dtypes == found.dtypes


def test_sink_refuses_an_existing_path(spark):
    df, path = spark.range(3), new_folder(spark, "sink")
    files.write_csv(df, path)
    with pytest.raises(AnalysisException):
        files.write_csv(df, path)
    files.write_csv(spark.range(5), path, overwrite=True, one_file=True)
    assert files.read_csv(spark, path).count() == 5


def test_strict_json_fails_on_a_wrong_type(spark, tables):
    path = new_folder(spark, "strict")
    shows(tables.documents).write.json(path)
    wrong = T.StructType.fromDDL("document struct<lines: array<struct<id: bigint, runtime: array<string>>>>")
    assert files.read_json(spark, path, schema=SHOW, strict=True).count() == tables.documents.count()
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST"):
        files.read_json(spark, path, schema=wrong, strict=True).select("document").collect()


def test_schema_survives_json():
    assert T.StructType.fromJson(json.loads(SHOW.json())) == SHOW


def test_literal_rows_are_checked(spark):
    schema = T.StructType.fromDDL("shelf string, weights array<double>")
    assert files.literal_rows(spark, [{"shelf": "top", "weights": [0.5, 2.0, 8.0]}], schema).head().weights[2] == 8.0
    with pytest.raises(Exception, match="FIELD_DATA_TYPE_UNACCEPTABLE|cannot be cast|not accept"):
        files.literal_rows(spark, [{"shelf": "top", "weights": "heavy"}], schema).collect()


def test_json_strings_infer_over_all_rows(spark):
    rows = [('{"name": "a", "keywords": ["x", "y"]}',), ('{"name": "b", "n": 3}',)]
    df = files.parse_json_column(spark.createDataFrame(rows, "j string"), "j")
    assert sorted(df.select("parsed.name", "parsed.n").collect()) == [("a", None), ("b", 3)]


def test_settled_reads_the_same_rows(spark):
    once = settled(spark.range(100).withColumn("r", F.rand()))
    assert once.exceptAll(once).isEmpty()
    assert once.join(once.withColumnRenamed("r", "again"), "id").where("r = again").count() == 100


class FakeSession:
    """A session without a checkpoint folder, on a master of choice."""

    def __init__(self, master, conf=None, set_before=None):
        self.conf = conf or {}
        self.sparkContext = self
        self.master = master
        self.folder = set_before

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder():
    assert shared_folder(FakeSession("yarn", {"spark.checkpoint.dir": "hdfs:///c"})) == "hdfs:///c"
    assert shared_folder(FakeSession("yarn", set_before="hdfs:///d")) == "hdfs:///d"
    with pytest.raises(ValueError):
        shared_folder(FakeSession("spark://host:7077"))
    local = FakeSession("local[2]")
    assert shared_folder(local) == local.folder


# ---- views --------------------------------------------------------------------------------


def test_named_views_are_dropped(spark):
    with named_views(rows=spark.range(3)) as v:
        frame = spark.sql(f"SELECT sum(id) AS s FROM {v.rows}")
        assert v.rows in temp_view_names(spark)
    assert v.rows not in temp_view_names(spark)
    assert frame.head().s == 3
    assert sql_or_none(spark, f"SELECT * FROM {v.rows}") is None


# ---- profiles -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(float(i % 7), 1.0 if i % 3 else 0.0, 1.0 if i < 4 else 0.0, None if i % 5 == 0 else float(i), 2.0) for i in range(60)]
    return spark.createDataFrame(rows, "seven double, flag double, rare double, gaps double, same double")


def test_binary_columns(sample):
    got = {r["column"]: r.is_binary for r in P.binary_columns(sample, sample.columns).collect()}
    distinct = sample.agg(*[F.count_distinct(c).alias(c) for c in sample.columns]).head().asDict()
    assert got == {c: n == 2 for c, n in distinct.items()}


def test_rare_columns(sample):
    assert {r["column"] for r in P.rare_columns(sample, ["flag", "rare"]).collect()} == {"rare"}


def test_summary_matches_built_in(sample):
    mine = {r["column"]: r for r in P.summary(sample, ["seven", "gaps"]).collect()}
    for name in ("seven", "gaps"):
        expected = sample.agg(
            F.count(name), F.avg(name), F.stddev(name), F.min(name), F.percentile(name, 0.25), F.median(name), F.percentile(name, 0.75), F.max(name)
        ).head()
        got = mine[name]
        assert [got["count"], got["mean"], got["stddev"], got["min"], got["q25"], got["q50"], got["q75"], got["max"]] == pytest.approx(list(expected))


def test_approximate_percentiles_are_close(sample):
    got = P.approximate_percentiles(sample, ["seven"], {"p50": 0.5, "p90": 0.9}).head()
    assert (got.p50, got.p90) == (3.0, 6.0)


def test_value_sets(sample):
    got = {r["column"]: r["values"] for r in P.value_sets(sample, ["flag", "same", "seven"]).collect()}
    assert got == {"flag": [0.0, 1.0], "same": [2.0], "seven": [float(i) for i in range(7)]}


def test_text_columns(spark):
    df = spark.createDataFrame([("b", 2), ("a", 10), (None, 2), ("b", None)], "s string, n int")
    got = {r["column"]: tuple(r)[1:] for r in P.describe_text(df, ["s", "n"]).collect()}
    assert got == {"s": (3, "a", "b"), "n": (3, "2", "10")}
    assert {r["column"]: r["values"] for r in P.value_sets(df, ["s", "n"], "string").collect()} == {"s": ["a", "b"], "n": ["10", "2"]}


# ---- rows ---------------------------------------------------------------------------------


def test_split_is_stable_and_complete(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    first = [sorted(r.k for r in part.collect()) for part in split_rows(df.repartition(3), ["k"], 0.7, 13)]
    second = [sorted(r.k for r in part.collect()) for part in split_rows(df.repartition(11), ["k"], 0.7, 13)]
    assert first == second
    assert sorted(first[0] + first[1]) == list(range(5000))
    assert 0.66 < len(first[0]) / 5000 < 0.74
    assert first[0] != sorted(r.k for r in split_rows(df, ["k"], 0.7, 14)[0].collect())


def test_reused_releases(spark):
    df = spark.range(10)
    with reused(df) as kept:
        assert kept.count() == 10 and kept.is_cached
    assert not df.is_cached
