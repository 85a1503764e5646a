"""The pipeline against a chain of plain versions, and its stages on odd tables."""

from __future__ import annotations

import random

import brute
import pytest

import corpus_pipeline
from tidemark.llm.language_id import languages
from tidemark.llm.packing import packed

from test_dedup import edited, sentence


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    passages = [sentence(rng, 60) for _ in range(2)]
    items = [(k, sentence(rng, 25)) for k in range(4)]
    texts = []
    for _ in range(25):
        base = sentence(rng, 120)
        texts += [base, base, edited(rng, base, 2)]
    texts += [f"{sentence(rng, 50)} {rng.choice(passages)} {sentence(rng, 40)}" for _ in range(30)]
    texts += [f"{sentence(rng, 40)} {text} {sentence(rng, 40)}" for _, text in items]
    texts += [passages[0], None, "", "123 456", "é" * 300 + passages[1]]
    where = tmp_path_factory.mktemp("tables")
    rows = [(k, t, rng.choice(["en", "de"]), "src", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), {k: t for k, t, *_ in rows}, items


def test_pipeline(spark, folder):
    where, texts, items = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    known = {r.doc_id for r in languages(docs).collect() if r.lang_pred != "und" and r.share >= corpus_pipeline.LEAST_SHARE}
    assert known == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")} & known
    left = {i: t for i, t in texts.items() if i in known}
    groups = brute.near_groups(left)
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    cut = brute.without_repeats(list(left.values()))
    left = {i: c[3].decode("utf-8", "ignore") for i, c in zip(left, cut)}
    left = {i: t for i, t in left.items() if brute.words(t)}
    dirty = brute.contamination(list(left.values()), items)
    assert any(d[4] for d in dirty) and any(c[1] for c in cut)
    left = {i: t for (i, t), d in zip(left.items(), dirty) if not d[4]}
    want = packed(spark.createDataFrame(list(left.items()), "doc_id long, text string")).select("doc_id", "piece", "start", "length", "ids_crc32")
    got = corpus_pipeline.run(spark, where)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())
    places = [(r.sequence_id, r.offset) for r in got.collect()]
    assert len(set(places)) == len(places)


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    where, _, _ = folder
    docs = spark.read.parquet(f"{where}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, where)
        assert out.collect() == []
        if stage is not corpus_pipeline.into_sequences:
            assert out.columns == corpus_pipeline.COLUMNS


def test_stages_take_nulls_and_repeated_rows(spark, folder):
    where, _, _ = folder
    rows = [(None, "abc def ghi jkl mno pqr", None, None, None), (3, "abc def ghi jkl mno pqr", "en", None, 1), (3, "abc def ghi jkl mno pqr", "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, where).collect(), docs.schema)
    assert sorted((r.doc_id is None, r.text) for r in docs.collect()) == [(False, "abc def ghi jkl mno pqr"), (True, "abc def ghi jkl mno pqr")]


@pytest.mark.parametrize("turned", [False, True])
def test_two_texts_under_one_id(spark, turned):
    """The copy goes and the clean text stays, in whatever order they come."""
    rng = random.Random(31)
    a, b = sentence(rng, 40), sentence(rng, 40)
    rows = [(3, a, "en", "s", 1), (7, a, "en", "s", 1), (7, b, "en", "s", 1), (7, b, "de", "s", 1), (None, a, None, None, None)]
    docs = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.without_near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id or -1, r.text, r.lang or "") for r in got) == sorted([(3, a, "en"), (7, b, "de"), (-1, a, "")])
