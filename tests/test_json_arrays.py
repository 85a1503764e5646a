"""Parallel reading of JSON documents over many lines, against the built-in reader."""

from __future__ import annotations

import json
import random

import pytest

from tidemark.sources.files import read_json
from tidemark.sources.json_arrays import _marks, json_elements, read_json_arrays

SCHEMA = "id long, name string, tags array<string>, inner struct<x: double, list: array<struct<a: long>>>"


def element(i, draw):
    odd = ['quote " here', "back\\slash\\", '\\"', "brackets ]}[{", "ä € 𝄞", "", "line\nbreak", "comma, colon: ", '"\\\\"']
    return {"id": i, "name": draw.choice(odd), "tags": [draw.choice(odd) for _ in range(draw.randrange(4))], "inner": {"x": i / 2, "list": [{"a": j} for j in range(draw.randrange(3))]}}


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("most_broadcast", [100_000, 0])
def test_same_rows_as_the_built_in_reader(spark, small_splits, tmp_path, as_rows, most_broadcast):
    draw = random.Random(2)
    items = [element(i, draw) for i in range(300)]
    big = element(999, draw) | {"tags": ["z" * 50] * 100}  # longer than several splits
    (tmp_path / "pretty.json").write_text(json.dumps([*items[:200], big, *items[200:250]], indent=2, ensure_ascii=False))
    (tmp_path / "lines.json").write_text("[" + ",\n".join(json.dumps(x) for x in items[250:]) + "]")
    (tmp_path / "object.json").write_text("\n\n" + json.dumps(items[0] | {"id": -1}, indent=4))
    (tmp_path / "empty.json").write_text(" \n[\n]\n")
    (tmp_path / "blank.json").write_text("\n  \n")
    ours = read_json_arrays(spark, str(tmp_path), SCHEMA, most_broadcast)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    theirs = read_json(spark, str(tmp_path), SCHEMA, whole_files=True).where("id is not null")
    assert ours.count() == 302 and ours.schema == theirs.schema
    assert sorted(json.dumps(r.asDict(True)) for r in ours.collect()) == sorted(json.dumps(r.asDict(True)) for r in theirs.collect())


def test_documents_that_are_no_objects_are_refused(spark, tmp_path):
    for i, text in enumerate(["[1, 2]", '["a"]', "[{}]]", "[{}", '{"a": 1}}', "7"]):
        folder = tmp_path / str(i)
        folder.mkdir()
        (folder / "x.json").write_text(text)
        with pytest.raises(Exception, match="brackets do not match|not an object"):
            json_elements(spark, str(folder)).collect()


def test_brackets_and_strings():
    import numpy as np

    text = b'{"a\\"]": "\\\\", "b": [1]}'
    step, inside = _marks(np.frombuffer(text, np.uint8))
    assert [text[i : i + 1] for i in np.flatnonzero(step)] == [b"{", b"[", b"]", b"}"]
    assert bytes(np.frombuffer(text, np.uint8)[~inside]) == b'{: , : [1]}'
