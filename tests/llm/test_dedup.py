"""Near duplicates, components and repeated strings against brute force."""

from __future__ import annotations

import hashlib
import random

import brute
import pytest

from tidemark.llm import minhash_dedup, suffix_dedup
from tidemark.llm.components import components
from tidemark.llm.suffix_dedup import Run, merged, repeated_ranges, shared


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = sentence(rng, 1)
    return " ".join(w)


@pytest.fixture(scope="module")
def mixed_texts():
    rng = random.Random(4)
    texts = []
    for _ in range(8):
        base = sentence(rng, rng.choice([6, 30, 90, 200]))
        texts += [base, base.upper(), base + " ", edited(rng, base, 1), edited(rng, base, 2), edited(rng, base, 4)]
    passage = sentence(rng, 70)
    texts += [f"{sentence(rng, 12)} {passage} {sentence(rng, k)}" for k in range(1, 30)]
    return texts + [None, "", " \n\t", "a b c", "A b c", "one two three four", "x" * 9000, "é è " * 40, sentence(rng, 4000)]


def check_near(make_docs, texts, ids=None):
    docs = make_docs(texts, ids)
    rows = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    want = brute.near_groups(dict(zip(range(len(texts)) if ids is None else ids, texts)))
    assert {i: (r.n_shingles, r.component_id) for i, r in rows.items()} == want
    assert all(r.kept == (i == want[i][1]) for i, r in rows.items())


def test_near_duplicates(make_docs, mixed_texts):
    check_near(make_docs, mixed_texts)


def test_near_duplicates_of_a_large_group(make_docs):
    rng = random.Random(8)
    base = sentence(rng, 100)
    check_near(make_docs, [edited(rng, base, rng.randint(0, 5)) for _ in range(150)])


def test_near_duplicates_on_documents(spark, small):
    texts = {r.doc_id: r.text for r in small.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(small).collect()}
    assert got == brute.near_groups(texts)


def test_near_duplicates_of_nothing_and_of_null_ids(make_docs):
    assert minhash_dedup.near_duplicates(make_docs(["a"]).where("false")).collect() == []
    rows = minhash_dedup.near_duplicates(make_docs(["a b c d e f"] * 4, [None, 3, 3, 2])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in rows) == [(False, 2, 2, True), (False, 3, 2, False), (False, 3, 2, False), (True, 0, None, True)]


def test_sketch_agrees_with_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 7, 300):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (minhash_dedup.sketch(a) == minhash_dedup.sketch(a.copy())).all()
        assert np.isin(minhash_dedup.sketch(a), a).all()
    both, one, two = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (600, 100, 100))
    a, b = (np.unique(np.concatenate((both, x))) for x in (one, two))
    assert abs((minhash_dedup.sketch(a) == minhash_dedup.sketch(b)).mean() - 0.75) < 0.12


def test_second_look_leaves_out_no_similar_text():
    """Sets longer than the list of least hashes, similarity around the limit: similar ones always stay."""
    import numpy as np

    rng = np.random.default_rng(5)
    cut = lambda found: (found[: minhash_dedup.LEAST] >> np.uint64(32)).astype(np.uint32).tobytes()
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    left_out = 0
    for n in (3, 40, 900, 4096, 4097, 9000, 30_000):
        base = np.unique(draw(n))
        sets = [base]
        for share in (1.0, 0.99, 0.9, 0.87, 0.86, 0.855, 0.85, 0.84, 0.8, 0.7, 0.5, 0.0):
            kept = base[rng.permutation(n)[: round(n * share)]]
            sets += [np.unique(np.concatenate((kept, draw(n - len(kept))))), np.sort(kept)] if len(kept) else [np.unique(draw(n))]
        parts, reps = np.arange(len(sets)), np.arange(len(sets)) + 100
        others = minhash_dedup.Others(parts, reps, np.array([len(x) for x in sets]), [cut(x) for x in sets])
        for i, x in enumerate(sets):
            got = set(others.possible(i, len(x), cut(x)).tolist())
            want = {100 + j for j, y in enumerate(sets) if j != i and 100 * (both := len(np.intersect1d(x, y))) >= 75 * (len(x) + len(y) - both)}
            assert want <= got and 100 + i not in got
            left_out += len(sets) - 1 - len(got)
            if n == 900:
                assert len(got - want) <= 2
    assert left_out > 500


def test_near_duplicates_of_long_template_texts(make_docs):
    """Texts of 6,000 words from one template, at similarities just below and just above the limit."""
    rng = random.Random(31)
    base = sentence(rng, 6000).split(" ")
    texts = [" ".join(base)]
    for k in range(5):
        for changed in (165, 170, 178, 186):  # each changed word replaces five shingles
            words = list(base)
            for at in rng.sample(range(0, 6000, 5), changed):
                words[at] = f"w{k}x{at}"
            texts.append(" ".join(words))
    check_near(make_docs, texts)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(None, 3), (5, None), (7, 7)]
    parent = {x: x for pair in links for x in pair if x is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for a, b in links if a is not None and b is not None and a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def written_tables(monkeypatch, *modules) -> list:
    """Gets an entry for every table that the modules write from now on."""
    written = []
    for module in modules:
        monkeypatch.setattr(module, "settled", lambda df, real=module.settled: written.append(df.columns) or real(df))
    return written


def test_stars_are_known_without_another_round(spark, monkeypatch):
    from tidemark.llm import components as module

    for links in ([(k, 0) for k in range(1, 40)] * 2 + [(60, 50)], [(k, 90) for k in range(5, 40)]):
        written = written_tables(monkeypatch, module)
        got = sorted(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
        least = {x: 50 if x in (50, 60) else min(map(min, links)) for pair in links for x in pair}
        assert got == sorted(least.items())
        assert len(written) <= (3 if (60, 50) in links else 5)
        monkeypatch.undo()


def test_links_of_the_second_look_join_settled_components(make_docs, monkeypatch):
    """Chains of edits: neighbours are similar, others not. A third of the links are left to the second look."""
    from tidemark.llm import components as module

    rng = random.Random(41)
    texts = []
    for _ in range(6):
        words = sentence(rng, 100).split(" ")
        for k in range(0, 60, 12):
            texts.append(" ".join(words))
            words[k] = f"w{k}"
            words[k + 6] = f"v{k}"
    looks, real = [], minhash_dedup.linked
    late = "(a + b) % 3 = 0"
    monkeypatch.setattr(minhash_dedup, "linked", lambda pairs, held: looks.append(real(pairs, held)) or (looks[0].where(f"not {late}") if len(looks) == 1 else looks[1]))
    monkeypatch.setattr(minhash_dedup, "_second_look", lambda members, forest, tested, prints: tested.where(late))
    written = written_tables(monkeypatch, minhash_dedup, module)
    check_near(make_docs, texts)
    assert looks[1].count() > 5
    assert ["id", "component"] not in written and len(written) <= 24


def check_repeats(make_docs, texts, **more):
    docs = make_docs(texts)
    rows = sorted(suffix_dedup.without_repeats(docs, **more).collect(), key=lambda r: r.doc_id)
    want = brute.without_repeats(texts, more.get("length", 200))
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows] == want
    assert all(r.kept_sha256 == hashlib.sha256(w[3]).hexdigest() for r, w in zip(rows, want))


@pytest.fixture(scope="module")
def repeating():
    rng = random.Random(11)
    passages = [sentence(rng, n) for n in (35, 45, 60, 200)]
    texts = []
    for k in range(60):
        p = rng.choice(passages)
        cut = rng.randint(0, 30)
        texts.append(sentence(rng, rng.randint(0, 30)) + p[cut : len(p) - rng.randint(0, 40)] + sentence(rng, rng.randint(0, 30)))
    return texts + [None, "", "a" * 199, "b" * 200, "c" * 201, "d" * 900, "é" * 150, "xy" * 300, passages[3], passages[3], sentence(rng, 3000)]


@pytest.mark.parametrize("limit", [100_000, 3])
def test_repeats(make_docs, repeating, limit):
    check_repeats(make_docs, repeating, most_in_task=limit)


def test_repeats_of_other_length(make_docs, repeating):
    check_repeats(make_docs, repeating, length=90)


def test_repeats_in_pieces(make_docs, monkeypatch):
    rng = random.Random(3)
    part = sentence(rng, 90)
    data = "".join(sentence(rng, 40) + part for _ in range(6)).encode()
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    found = []
    whole = suffix_dedup.K.Slice(0, 1, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    for _, base, piece, offsets in suffix_dedup._pieces(whole, 200):
        place, first, last, _ = suffix_dedup.named_places(piece, offsets)
        found += [(p + base, s + base) for p, a, b in zip(place, first, last) for s in range(a, b + 1)]
    place, first, last, _ = suffix_dedup.named_places(whole.data, whole.offsets)
    assert sorted(found) == sorted((p, s) for p, a, b in zip(place, first, last) for s in range(a, b + 1))


def test_repeats_on_documents(spark, small):
    texts = {r.doc_id: r.text for r in small.collect()}
    want = dict(zip(texts, brute.without_repeats(list(texts.values()))))
    for r in suffix_dedup.without_repeats(small).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_repeats_of_nothing_and_of_null_ids(make_docs):
    assert suffix_dedup.without_repeats(make_docs(["a"]).where("false")).collect() == []
    rows = suffix_dedup.without_repeats(make_docs(["ab" * 150] * 2 + ["q"], [None, None, 5])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 300, 300]


def test_runs_and_loser_tree():
    rng = random.Random(6)
    for n in (1, 2, 3, 5, 8):
        runs = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 40))}) for _ in range(n)]
        blobs = [Run.pack([(s, b"l" * i, [i]) for i, s in enumerate(run)]) for run in runs]
        assert [[x[0] for x in Run.read(b)] for b in blobs] == runs
        out = list(merged([Run.read(b) for b in blobs]))
        assert [x[0] for x in out] == sorted(s for run in runs for s in run)
        assert all(y[1] == shared(x[0], y[0]) for x, y in zip(out, out[1:]))


def test_ranges_of_a_group_against_all_pairs():
    rng = random.Random(9)
    for _ in range(60):
        length = 12
        items = sorted((b"xx" + bytes(rng.choice(b"ab") for _ in range(rng.randint(4, 10))), bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(2, 14)))
        group, last = [], b""
        for k, (s, left) in enumerate(items):
            group.append((s, shared(last, s), left, [k]))
            last = s
        got = {k: set() for k in range(len(items))}
        for k, low, high in repeated_ranges(group, length):
            got[k] |= set(range(low, high + 1))
        for i, (s, left) in enumerate(items):
            want = set()
            for j, (t, other) in enumerate(items):
                if i != j:
                    want |= set(range(length - shared(s, t), shared(left[::-1], other[::-1]) + 1))
            assert got[i] == want


# ---- hot keys are split at run time

SPLIT_EARLY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
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


def splits_of(monkeypatch, module, work) -> dict[str, bool]:
    """For each join_facts of the module: its keys, and whether it was split."""
    seen, real = {}, module.join_facts

    def spied(df, facts, keys, how="inner"):
        joined = real(df, facts, keys, how)
        seen[",".join(keys)] = seen.get(",".join(keys), False) or is_split(joined)
        return joined

    monkeypatch.setattr(module, "join_facts", spied)
    work()
    return seen


def test_a_hub_of_many_links_is_split(spark, split_early):
    links = spark.range(1, 6000).selectExpr("id as hi", "0L as lo").unionAll(spark.range(7000, 7300).selectExpr("id + 1 as hi", "id as lo"))
    from tidemark.llm.components import _stars
    from tidemark.llm.frames import settled

    links = settled(links)
    mirrored = settled(links.selectExpr("10000L - lo as hi", "10000L - hi as lo"))
    assert is_split(_stars(links, True)) and is_split(_stars(mirrored, False))
    assert {r.component for r in components(links.selectExpr("hi as a", "lo as b")).where("id < 6000").collect()} == {0}


def test_hot_classes_and_passages_are_split(spark, make_docs, split_early, monkeypatch):
    rng = random.Random(21)
    copies = ["one two three four five six seven"] * 4000 + [sentence(rng, 8) for _ in range(200)]
    seen = splits_of(monkeypatch, minhash_dedup, lambda: minhash_dedup.near_duplicates(make_docs(copies)).collect())
    assert seen["k1,k2,n_shingles"]
    passage = sentence(rng, 60)
    shared_by_all = [f"{sentence(rng, 2)} {passage} {sentence(rng, 2)}" for _ in range(600)] + [sentence(rng, 90) for _ in range(40)] * 2
    seen = splits_of(monkeypatch, suffix_dedup, lambda: suffix_dedup.without_repeats(make_docs(shared_by_all)).collect())
    assert seen["core"]


def test_rows_of_one_id_are_judged_by_their_own_text(make_docs):
    rng = random.Random(22)
    a, b = sentence(rng, 30), sentence(rng, 30)
    for texts in ([a, a, b], [b, a, a]):
        ids = [3 if (t == a and i < 2) else 7 for i, t in enumerate(texts)] if texts[0] == a else [7, 7, 3]
        rows = minhash_dedup.near_duplicates(make_docs(texts, ids).withColumnRenamed("lang", "mine").withColumn("mine", texts_hash()), carry=("mine",)).collect()
        kept = {(r.doc_id, r.mine) for r in rows if r.kept}
        assert len(kept) == 2 and {i for i, _ in kept} == {3, 7}


def texts_hash():
    from pyspark.sql import functions as F

    return F.xxhash64("text")
