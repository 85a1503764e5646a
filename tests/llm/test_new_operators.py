"""Hard negatives, the prefix trie and source mixing against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as H
from tidemark.llm import prefix_trie as P
from tidemark.llm import source_mixing as M

VECTORS = "vec_id long, embedding array<double>, label int, block long, score long, lane int"


# ---- hard negatives


def plain_negatives(rows, asks, positives=5, negatives=3, low=50, high=95):
    rows = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(256 * x) for x in r[1]] for r in rows]
    out = []
    for i, a in enumerate(rows):
        if not asks(a[0]):
            continue
        scored = [(-min(max(sum(x * y for x, y in zip(ints[i], ints[j])), -(2**63)), 2**63 - 1), r[0], r[2] == a[2]) for j, r in enumerate(rows) if j != i and len(r[1]) == len(a[1])]
        for s, pid, _ in sorted(x for x in scored if x[2])[:positives]:
            fits = sorted((t, n) for t, n, same in scored if not same and low * -s <= 100 * -t <= high * -s)
            out += [(a[0], pid, k, n, -s, -t) for k, (t, n) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **sizes):
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS).repartition(3)
    return sorted(map(tuple, H.hard_negatives(frame, "vec_id % 10 = 0", **sizes).collect()))


def vectors(rng, n, dims=6, labels=3):
    return [(i, [round(rng.uniform(0, 0.5), 2) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7, "block_anchors": 2}])
def test_hard_negatives(spark, sizes):
    rng = random.Random(1)
    rows = vectors(rng, 120)
    rows += [(i + 200, v, lab) for i, v, lab in rows[:20]]  # equal vectors: ties fall to the smaller id
    rows += [rows[10], rows[10], (20, [0.3] * 6, 1), (30, [0.1] * 6, None), (None, [0.2] * 6, 0), (40, None, 0), (50, [0.1, None, 0.1, 0.1, 0.1, 0.1], 0)]
    rows += [(60, [float("nan")] + [0.1] * 5, 1), (70, [float("inf")] * 6, 1), (80, [0.5, 0.5], 0), (81, [0.5, 0.4], 0), (82, [0.4, 0.3], 1), (90, [], 0), (91, [], 0), (92, [], 1)]
    assert mined(spark, rows, **sizes) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_large_and_negative_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * scale for _ in range(3)], i % 2) for i, scale in enumerate([0.5] * 30 + [1e4] * 20 + [1e9] * 20 + [1e25] * 6)]
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == []
    with pytest.raises(ValueError):
        H.hard_negatives(spark.createDataFrame([], VECTORS), "true", low=90, high=50)


def test_hard_negatives_broadcast_no_blocks(spark, monkeypatch):
    """However small the files of the blocks look, the driver gets no copies of them."""
    plans, settled = [], H.settled

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(H, "settled", lambda df: (plans.append(plan(df)), settled(df))[1])
    rng = random.Random(3)
    rows = vectors(rng, 60)
    found = H.hard_negatives(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS), "vec_id % 10 = 0", block_rows=7)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)
    plans.append(plan(found))
    assert sum("Join" in p or "CartesianProduct" in p for p in plans) == 2
    assert not any("Broadcast" in p or "Generate" in p for p in plans)


@pytest.mark.parametrize(
    "settings, sizes",
    [({"LANES": 1}, {}), ({"LANES": 2, "HELD": 1, "DENSE": 1, "LABELS": 1}, {"block_rows": 90, "block_anchors": 20}), ({"LANES": 1, "HELD": 3, "DENSE": 10**9, "CELLS": 300}, {"block_anchors": 20})],
)
def test_hard_negatives_of_many_blocks_in_a_task(spark, monkeypatch, settings, sizes):
    for name, value in settings.items():
        monkeypatch.setattr(H, name, value)
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-0.2, 0.5) for _ in range(6)], rng.randrange(3)) for i in range(900)]
    rows += [(i + 1000, v, lab) for i, v, lab in rows[:300]]  # ties across blocks
    assert mined(spark, rows, **sizes) == plain_negatives(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("top", [1, 200, 4000, 10**6, 10**12])
def test_packed_scores(top):
    rng = np.random.default_rng(top)
    a, r = rng.integers(-top, top + 1, (5, 64)), rng.integers(-top, top + 1, (11, 64))
    want = a.astype(object) @ r.astype(object).T
    assert (H.packed_scores(a.astype(float), r.astype(float)) == np.clip(want, -(2**63), 2**63 - 1)).all()


# ---- prefix trie

TURNS = "conv_id long, turn long, role string, text string, path string, node string, id long"


def step_key(role, text):
    d = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
    return d


def plain_trie(turns):
    own = {}
    for c, t, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, step_key(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, xs in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        rebuilt[c] = tuple(own.get(base, [])[:h] + xs[h:])
    nodes = {}
    for c, p in rebuilt.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    space = " \t\n\x0b\x0c\r"
    words = lambda t: len("".join(" " if ch in space else ch for ch in t).split(" ")) - "".join(" " if ch in space else ch for ch in t).split(" ").count("")
    kids = {n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes) for n in nodes}
    out = []
    for n, cs in nodes.items():
        under = [m for m in nodes if m[: len(n)] == n]
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(n))
        saved = sum((len(nodes[m]) - 1) * words(m[-1][1]) for m in under if m)
        out.append((min(cs), len(n), min(nodes[n[:-1]]) if n else None, len(cs), kids[n], sum(not kids[m] for m in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def built(spark, turns, **sizes):
    frame = spark.createDataFrame([(*t, "x", "y", 7) for t in turns], TURNS).repartition(3)
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    paths = P.with_shared_heads(P.conversation_paths(frame), F.col("conv_id") - F.col("conv_id") % 20, head)
    return sorted(map(tuple, P.prefix_trie(paths, **sizes).collect()), key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("sizes", [{}, {"block_paths": 3}, {"block_bytes": 60}])
def test_prefix_trie(spark, sizes):
    rng = random.Random(3)
    turns = []
    for c in [*range(-25, 90), *range(1000, 1030)]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            turns.append((c, t, rng.choice(["user", "bot"]), f"say {rng.randrange(3)} \n again" if t else "hello  there"))
    turns += [(5, None, "user", "before all"), (6, 2, None, None), (6, 2, None, None), (7, 1, "a", "b"), (7, 1, "b", "a"), (None, 1, "user", "lost")]
    turns += [(500, t, "user", "long " * (t % 4)) for t in range(400)] + [(501, t, "user", "long " * (t % 4)) for t in range(390)]
    turns += [(521, 0, "user", "only one, gone if the shared head is missing")]
    assert built(spark, turns, **sizes) == plain_trie(turns)


def test_prefix_trie_of_few(spark):
    assert built(spark, []) == []
    copies = [(c, 0, "user", "same words here") for c in range(60)]
    assert built(spark, copies, block_paths=1) == plain_trie(copies)
    lone = [(3, 0, "user", "x")]
    assert built(spark, lone) == plain_trie(lone)


def test_sparse_table():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 64, 100):
        v = rng.integers(0, 5, n)
        table = P.SparseTable(v)
        starts, depth = rng.integers(0, n + 1, 50), rng.integers(0, 6, 50)
        right = [next((j for j in range(s, n) if v[j] < d), n) for s, d in zip(starts, depth)]
        left = [next((j + 1 for j in range(s - 1, -1, -1) if v[j] < d), 0) for s, d in zip(starts, depth)]
        assert table.right(starts, depth).tolist() == right and table.left(starts, depth).tolist() == left


# ---- source mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, whole = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in target]
        left = whole - sum(target.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) >= most * sizes[s]]
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        target |= {s: most * sizes[s] for s in over}


def mix_docs(spark, rng):
    rows = []
    for s, n in [("a", 900), ("b", 300), ("é", 200), (None, 250), ("c", 400), ("empty", 3)]:
        for _ in range(n):
            words = 0 if s == "empty" else min(3000, int(rng.paretovariate(1.1) * 8))
            rows.append((len(rows), "w " * words, s, 1, 2.0, "x"))
    rows += [rows[5]] * 300 + [(None, None, "a", 1, 2.0, "x"), (9999, "w " * 6000, "c", 1, 2.0, "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size long, target double, rank string").repartition(4)


@pytest.mark.parametrize("limit", [None, 50])
def test_source_mixing(spark, limit):
    rows, docs = mix_docs(spark, random.Random(6))
    if limit:
        spark.conf.set("spark.tidemark.window.maxGroupRows", str(limit))  # the split forms of groups
    try:
        got = M.mixed(docs).collect()
        again = M.mixed(docs.repartition(2)).collect()
    finally:
        spark.conf.unset("spark.tidemark.window.maxGroupRows")
    order = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(got, key=order) == sorted(again, key=order)
    sizes, source = {}, {}
    for i, text, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((text or "").split())
        source[i] = s
    want, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in sizes), (taken, want)


def test_source_mixing_by_merit(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(1, 40), "st"[i % 2], [None, -1.0, 0.2, 1.0, 3.0, 50.0][i % 6]) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, good double")
    got = {r.doc_id: r for r in M.mixed(docs, merit=F.col("good")).collect()}
    share = {}
    for i, text, s, m in rows:
        share.setdefault((s, m), []).append(got[i].taken / got[i].size)
    for s in "st":
        mean = {m: np.mean(v) for (x, m), v in share.items() if x == s}
        assert all(v == 0 for m, v in mean.items() if m is None or m < 0)
        assert sorted(v for m, v in mean.items() if m and m > 0) == [mean[m] for m in sorted(m for m in mean if m and m > 0)]


def test_source_mixing_draws_by_odds(spark):
    """Each document of a source is taken as often as its chance says, over many hashes."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("four words in it").alias("text"), F.lit("s").alias("source"))
    got = M.mixed(docs.withColumn("m", F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(2.0)), share=0.3, merit=F.col("m")).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg(F.col("taken") / F.col("size")).alias("mean"))
    mean = {r.odd: r.mean for r in got.collect()}
    assert abs(mean[0] - 0.2) < 0.03 and abs(mean[1] - 0.4) < 0.03


def test_source_mixing_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mixed(none).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted(map(tuple, M.mixed(blank).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    with pytest.raises(ValueError):
        M.mixed(none, share=3.0)
