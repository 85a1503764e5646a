"""Language, decontamination, quality, counts, packing, scoring and page text against plain versions."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from tidemark.llm import decontamination, html_extraction, kernels, language_id, lm_scoring, packing, quality_classifier, quality_rules, token_counts
from tidemark.llm.word_tokens import encoder, vocabulary_path

ODD = [None, "", " \n\t ", "a", "A b", "é", "12 34", "!!!", "x" * 5000, "word " * 3000, "Ünïcode “quotes” … und mehr\r\n\r\nend.", "same line here.\nsame line here.\n\nother | a | b | c"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


# -- kernels


def test_words_and_hashes():
    import pyarrow as pa

    texts = [*ODD, "ab", "b", "b ab"]
    seen = {}
    for part in kernels.slices(pa.array(texts), 40):
        w = kernels.word_spans(part.data, part.offsets, kernels.NOT_SPACE)
        h = kernels.span_hashes(kernels.prefix_sums(part.data), w.starts, w.ends)
        for i, text in enumerate(texts[part.lo : part.hi]):
            own = [part.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)][w.first[i] : w.first[i + 1]]
            assert own == brute.words(text)
            for word, x in zip(own, h[w.first[i] : w.first[i + 1]].tolist()):
                assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


def test_word_table():
    rng = np.random.default_rng(1)
    table, known = kernels.WordTable(4), np.zeros(0, np.uint64)
    for _ in range(5):
        new = np.setdiff1d(rng.integers(0, 2**64, 500, dtype=np.uint64), known)
        assert (table.find(new) == -1).all()
        table.add(new)
        known = np.concatenate((known, new))
        assert (table.find(known) == np.arange(len(known))).all()


# -- 1


def test_languages(spark, small):
    rows = {r.doc_id: r for r in language_id.languages(small).collect()}
    truth = {r.doc_id: r.lang for r in small.collect()}
    held = [i for i in rows if rows[i].held_out]
    assert set(held) == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(rows[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)


def test_languages_of_odd_rows(make_docs):
    texts = [*ODD, "the cat sat on the mat", "der Hund und die Katze"] * 2
    langs = [None] * len(ODD) + ["en", "de"] + [None] * len(ODD) + ["en", "de"]
    ids = [None, *range(1, len(texts))]
    rows = language_id.languages(make_docs(texts, ids, langs=langs)).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in rows)
    none = {i for i, t in zip(ids, texts) if not any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == none
    unlabelled = language_id.languages(make_docs(["abc def"], langs=[None])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]
    assert language_id.languages(make_docs(["a"]).where("false")).collect() == []


def test_filter_has_all_languages_of_a_gram():
    rng = np.random.default_rng(2)
    sets = {f"l{k:02}": rng.integers(0, 2**64, 400, dtype=np.uint64) for k in range(19)}
    filters = language_id.Filters(sets)
    for k, lang in enumerate(filters.langs):
        bits = [filters.slots[k // 8][p] >> np.uint8(k % 8) & 1 for p in filters._probes(sets[lang])]
        assert all(b.all() for b in bits)
    assert (filters.false_share < 0.02).all()


# -- 7


@pytest.mark.parametrize("block", [50_000, 7])
def test_contamination(spark, make_docs, block):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, say(30)), (2, say(13)), (30, "Seven words, only seven: of it!"), (4, "two words"), (5, ""), (6, None), (None, say(20)), (8, "one"), (12, say(30))]
    items.append((9, items[0][1].upper()))
    texts = [*ODD]
    for _ in range(40):
        item = rng.choice(items)[1] or ""
        w = item.split(" ")
        a = rng.randint(0, 5)
        texts.append(f"{say(rng.randint(0, 60))} {', '.join(w[a : len(w) - rng.randint(0, 5)])}. {say(rng.randint(0, 60))}")
    texts += ["seven-words ONLY seven of it", "two", "words two words two", items[1][1]]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    rows = sorted(decontamination.contamination(make_docs(texts), bench, block).collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows] == brute.contamination(texts, items)


def test_contamination_of_nothing(spark, make_docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    rows = decontamination.contamination(make_docs(["a b", None], [None, 1]), empty).collect()
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in rows) == [(0, 0, False), (2, 0, False)]
    assert decontamination.contamination(make_docs(["a"]).where("false"), empty).collect() == []


# -- 4 and 5


def base_counts(text):
    text = text or ""
    w = brute.words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if brute.words(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def line_fails(line):
    w = brute.words(line)
    chars, separators = sum(map(len, w)), sum(line.count(c) for c in "|>»·•")
    ends = w[-1].endswith(tuple(".!?:;\"')]}") + ("»", "”", "’", "…", "。", "！", "？"))
    return (
        (separators >= 3 and len(w) <= 5 * separators)
        or (not ends and len(w) < 8)
        or 10 * sum(line.count(c) for c in "#*$%&|<>") > chars
        or 3 * sum(x.endswith("!") for x in w) > len(w)
        or any(p in line.translate(brute.LOW) for p in quality_rules.PHRASES)
    )


def check_rules(docs):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in quality_rules.cleaned(docs.select("doc_id", "text")).collect():
        n, chars, symbols, same, repeated, failed = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, same, repeated, failed)
        lines = (texts[r.doc_id] or "").split("\n")
        out = [x for x in lines if brute.words(x) and line_fails(x)]
        lost = sum(len(c) for x in out for c in brute.words(x))
        assert (r.n_lines_removed, r.chars_removed) == (len(out), lost)
        assert r.kept == (not failed and lost <= 0.5 * chars)
        assert r.text == "\n".join(x for x in lines if not (brute.words(x) and line_fails(x)))


def test_rules(make_docs):
    more = ["Accept Cookies now please, dear reader of this page.", "home | news | sport\nA real sentence with many words stands here.", "WOW! BUY! NOW! it is cheap!", "one two three » four » five » six"]
    more.append("\n".join(["The first line is a sentence."] * 2 + ["menu"] * 3 + ["Another sentence ends with a quote.”"]))
    more.append("Accept\nCookies are fine when they stand on two lines, dear reader.")
    check_rules(make_docs([*ODD, *more]))


def test_rules_on_documents(small):
    check_rules(small)


def test_rules_of_nothing(make_docs):
    assert quality_rules.cleaned(make_docs(["a"]).where("false")).collect() == []
    assert len(quality_rules.cleaned(make_docs(["a"] * 3, [None, 1, 1])).collect()) == 3


def test_quality_scores(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in quality_classifier.quality_scores(docs, labels).collect()}
    judged = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert len(rows) == docs.count() and sum(r.predicted == q for r, q in judged) >= 0.95 * len(judged)


def test_quality_scores_of_odd_rows(spark, make_docs):
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1), (99, 0)], "doc_id long, quality int")
    for marks in (labels, labels.where("false")):
        rows = quality_classifier.quality_scores(make_docs(ODD, [None, *range(1, len(ODD))]), marks).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert quality_classifier.quality_scores(make_docs(["a"]).where("false"), labels).collect() == []


def test_additive_model_learns_a_product():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    model = quality_classifier.Model(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95 and (1, 0) in model.pairs


# -- 2 and 8


def first_fit(lengths, size):
    """Bins that first-fit decreasing takes."""
    bins = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, used in enumerate(bins) if used + n <= size), None)
        if k is None:
            bins.append(n)
        else:
            bins[k] += n
    return len(bins)


def test_packing(make_docs, tokenizer):
    rng = random.Random(7)
    texts = [*ODD, *(" ".join(rng.choice(["the", "of", "thonation", "x1"]) for _ in range(rng.randint(0, 90))) for _ in range(120))]
    ids = [None, *range(1, len(texts))]
    rows = packing.packed(make_docs(texts, ids), size=128).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in zip(ids, texts):
        own = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want = [(k, a, len(own[a : a + 128]), zlib.crc32(own[a : a + 128].tobytes())) for k, a in enumerate(range(0, len(own), 128))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i]) == want
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 128 and len(fill) <= first_fit([r.length for r in rows], 128)


def test_packing_of_nothing_and_repeated_rows(make_docs):
    assert packing.packed(make_docs(["a"]).where("false")).collect() == []
    rows = packing.packed(make_docs(["same text"] * 50, [7] * 50), size=9).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 50


def test_plan_uses_every_length_once():
    rng = random.Random(1)
    for _ in range(20):
        counts = Counter(rng.randint(1, 100) for _ in range(rng.randint(1, 400)))
        planned = packing.plan(dict(counts), 100)
        used = Counter()
        for times, parts in planned:
            assert times > 0 and sum(parts) <= 100
            for x in parts:
                used[x] += times
        assert used == counts
        assert sum(n for n, _ in planned) <= first_fit(counts.elements(), 100)
    assert packing.plan({60: 5, 40: 5}, 100) == [(5, (60, 40))]
    assert packing.plan({60: 4, 25: 4, 15: 4}, 100) == [(4, (60, 25, 15))]
    assert packing.plan({50: 3}, 100) == [(1, (50, 50)), (1, (50,))]


def test_every_exact_triple_is_found():
    stock = packing.Stock({**{n: 1 for n in range(1911, 2000)}, 700: 1, 698: 2}, 4096)
    assert sorted(stock.triple(2096)) == [698, 698, 700]
    assert packing.Stock({10: 1, 6: 1, 4: 1, 5: 1}, 32).triple(15) == (6, 5, 4) and packing.Stock({5: 2, 1: 9}, 32).triple(15) is None
    stock = packing.Stock({5: 3}, 32)
    assert stock.triple(15) == (5, 5, 5) and stock.count[5] == 3 and stock.one == 1 << 5
    assert packing.Stock({n: 1 for n in [2000, 700, *range(1911, 2000)]} | {698: 2}, 4096).triple(2096)


def test_encoder_gives_the_ids_of_the_whole_text(tokenizer, small):
    import pyarrow as pa

    texts = [*ODD, *(r.text for r in small.limit(60).collect()), "<|endoftext|>x <|startoftext|>", "don't é ﬁ İ ΣΑΣ Σ"]
    coder = encoder(vocabulary_path())
    for part in kernels.slices(pa.array(texts)):
        words, numbers = coder.words(part.data, part.offsets)
        flat, edges = coder.spread(numbers), np.concatenate(([0], np.cumsum(coder.counts(numbers))))[words.first]
        for i, text in enumerate(texts[part.lo : part.hi]):
            assert flat[edges[i] : edges[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_edits_follow_the_text(tokenizer):
    rng, coder = random.Random(4), encoder(vocabulary_path())
    for _ in range(60):
        text = " ".join(rng.choice(["the", "thonation", "x", "don't", "a,b"]) for _ in range(rng.randint(0, 25)))
        tree = token_counts.TokenTree(text, coder)
        for _ in range(8):
            a = rng.randint(-2, len(tree.text) + 2)
            b = a + rng.randint(-1, 9)
            new = rng.choice(["", " ", "q", " new words ", "glue", "a b c d e f g"])
            low = min(max(0, a), len(tree.text))
            want = tree.text[:low] + new + tree.text[min(max(low, b), len(tree.text)) :]
            tree.replace(a, b, new)
            assert tree.text == want and tree.total == len(tokenizer.encode(want, add_special_tokens=False).ids)
            pieces = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", want)]
            assert spans_of(tree) == pieces
            k = rng.randint(0, len(pieces))
            assert tree.tokens_before(k) == len(tokenizer.encode(want[: pieces[k - 1][1]] if k else "", add_special_tokens=False).ids)


def spans_of(tree):
    base, out = 0, []
    for leaf in tree.leaves:
        out += [(a + base, b + base) for a, b in zip(*leaf.spans)]
        base += len(leaf.text)
    return out


def test_edits_over_many_leaves(tokenizer, monkeypatch):
    """Small leaves that are emptied, joined and split; edits that meet their borders and the text's ends."""
    monkeypatch.setattr(token_counts, "LEAF", 2)
    rng, coder = random.Random(14), encoder(vocabulary_path())
    for _ in range(40):
        text = "".join(rng.choice(["the", "éa", "x", " ", "  ", "\n", "don't", " a b "]) for _ in range(rng.randint(0, 60)))
        tree = token_counts.TokenTree(text, coder)
        for _ in range(25):
            a = rng.choice([0, len(text), rng.randint(0, len(text)), sum(len(x.text) for x in tree.leaves[: rng.randint(0, len(tree.leaves))])])
            b = min(len(text), a + rng.choice([0, 0, 1, 2, 5, 30]))
            new = rng.choice(["", "", " ", "q", " ü ", "one two three four five six"])
            text = text[:a] + new + text[b:]
            tree.replace(a, b, new)
            pieces = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
            assert tree.text == text and spans_of(tree) == pieces
            assert tree.total == len(tokenizer.encode(text, add_special_tokens=False).ids)
            k = rng.randint(0, len(pieces))
            assert tree.tokens_before(k) == len(tokenizer.encode(text[: pieces[k - 1][1]] if k else "", add_special_tokens=False).ids)


def test_ten_thousand_edits_of_a_long_text(tokenizer):
    rng, coder = random.Random(15), encoder(vocabulary_path())
    text = " ".join(rng.choice(["the", "thonation", "x", "don't", "a,b"]) for _ in range(240_000))
    tree, begin = token_counts.TokenTree(text, coder), time.perf_counter()
    size = len(text)
    for _ in range(10_000):
        a = rng.randint(0, size)
        b = min(size, a + rng.randint(0, 9))
        new = rng.choice(["", "q", " new words "])
        tree.replace(a, b, new)
        size += len(new) - (b - a)
    assert time.perf_counter() - begin < 10 and tree.encoded < 60_000
    assert len(tree.text) == size and tree.total == len(tokenizer.encode(tree.text, add_special_tokens=False).ids)


def test_masking_edits(spark, make_docs, tokenizer):
    texts = [*ODD, "mail a.b@c.org and 10.0.0.1, twice: a.b@c.org!", "id 1234567890 1234567890 " + "ab" * 20, "no-one@nowhere x"]
    docs = make_docs(texts)
    rows = {r.doc_id: r for r in token_counts.masked_counts(docs).collect()}
    for i, text in enumerate(texts):
        new, n = re.subn(token_counts.PRIVATE, "[masked]", text or "")
        size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert (rows[i].n_tokens, rows[i].n_edits, rows[i].n_tokens_edited) == (size(text or ""), n, size(new))
    edits = spark.createDataFrame([(4, 1, 0, 1, "zz"), (4, 0, 0, 0, "new "), (77, 0, 0, 1, None), (3, 0, 0, 5, None)], "doc_id long, seq int, start int, stop int, new string")
    rows = {r.doc_id: r for r in token_counts.edited_counts(token_counts.with_edits(docs, edits)).collect()}
    assert len(rows) == len(texts) and rows[4].n_edits == 2 and rows[3].n_tokens_edited == 0


# -- 3


def test_lm_scores(make_docs):
    rng = random.Random(2)
    texts = [*ODD, *(" ".join(rng.choice(["the", "of", "Thonation", "rare%d" % rng.randint(0, 60)]) for _ in range(rng.randint(0, 60))) for _ in range(80))]
    ids = [*range(len(texts) - 1), 20]  # one id twice
    texts[-1] = texts[20]
    rows = lm_scoring.scored_texts(make_docs(texts, ids), steps=60).collect()
    own = [[*brute.words((t or "").translate(brute.LOW)), "\0end"] for t in texts]
    trained = [w for i, w in zip(ids, own) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(x for w in trained for x in w)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in zip(ids, own))
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)


def test_lm_scores_of_nothing_and_without_training(make_docs):
    assert lm_scoring.scored_texts(make_docs(["a"]).where("false")).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = lm_scoring.scored_texts(make_docs(["a b"], [held])).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in rows] == [(0, 0, 0.0)]


def test_lm_scores_count_every_pair(make_docs, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "of", "sea", "rare%d" % rng.randint(0, 60)]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = make_docs([*texts, texts[7]], [*range(60), 7])
    found = []
    for share in (4_000_000, 300, 1):  # pairs below this part of all are joined, not held
        monkeypatch.setattr(lm_scoring, "PAIR_SHARE", share)
        found.append(sorted((r.doc_id, r.score) for r in lm_scoring.scored_texts(docs, steps=20).collect()))
    for other in found[1:]:
        assert np.allclose([s for _, s in found[0]], [s for _, s in other], atol=1e-3)


def test_attention_learns_from_every_window_of_long_texts(spark):
    rng = random.Random(5)
    docs = [np.array(rng.choices([5, 6, 7, 40_000, 40_001], k=n), np.uint16) for n in (0, 16, 25_000, 300)]
    blobs = [lm_scoring._squeezed(d) for d in docs]
    ids, positions, doc = lm_scoring.training_windows(blobs)
    assert positions.sum() == sum(len(d) + 1 for d in docs) and np.bincount(doc)[2] == -(-25_001 // 16)
    _, _, model = small_model()
    before = {n: getattr(model.attention, n).copy() for n in model.attention.NAMES}
    kept = spark.createDataFrame([(k, b) for k, b in enumerate(blobs)], "key long, ids binary").repartition(3)
    net = model.attention
    grads = net.gradients(ids[:, :-1], model.group[ids[:, 1:]], np.arange(16) < positions[:, None])[1]
    sums = kept.select("ids").mapInArrow(lm_scoring._gradient_sums(spark.sparkContext.broadcast(net), spark.sparkContext.broadcast(model.group)), "chunk long, counts binary")
    rows = sums.repartition("chunk").mapInArrow(lm_scoring._added_up(float), "chunk long, counts binary").collect()
    values = np.concatenate([np.frombuffer(bytes(r["counts"]), float) for r in sorted(rows, key=lambda r: r.chunk)])
    flat = net.flat(grads)
    assert values[len(flat)] == positions.sum() and np.allclose(values[: len(flat)] / positions.sum(), flat, atol=1e-5)
    losses = lm_scoring.learn_from_all(net, model.group, kept)
    assert losses and (net.embed[40_000] != before["embed"][40_000]).any() and (net.embed[40_000] != net.embed[40_001]).any()
    assert (net.embed[30_000] == before["embed"][30_000]).all()


def test_words_with_marks_are_encoded_by_parts(monkeypatch):
    import pyarrow as pa

    from tidemark.llm import word_tokens

    coder, met = word_tokens.WordEncoder(word_tokens.vocabulary_path()), []
    encoded = coder._encoded
    monkeypatch.setattr(coder, "_encoded", lambda pieces: met.extend(pieces) or encoded(pieces))
    rng = random.Random(6)
    odd = ["sea", "Sea", "'s", "'", "l", "é", "É", "\u0301", "İ", "ſ", "Σ", "<|endoftext|>", "<|", "|>", "!", "...", "=\u0338", "7", "中", "»", "\x1c", "#" * 12]
    texts = ["sea sea, sea,", *(" ".join("".join(rng.choices(odd, k=rng.randint(1, 6))) for _ in range(4)) for _ in range(3000))]
    for text in texts:
        part = next(kernels.slices(pa.array([text])))
        found = coder.spread(coder.words(part.data, part.offsets)[1])
        assert found.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert b"sea" in met and b"sea," not in met and len(set(met)) == len(met)


def test_latin_words_go_to_the_merges_many_at_a_time(monkeypatch):
    import pyarrow as pa

    from tidemark.llm import word_tokens

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, []

        def encode_batch_fast(self, texts, **options):
            self.texts += texts
            return self.tokenizer.encode_batch_fast(texts, **options)

    whole = word_tokens.WordEncoder(word_tokens.vocabulary_path()).tokenizer
    latin = [chr(c) for c in range(0x80, 0x250) if chr(c).isalpha()]
    rng = random.Random(7)
    words = ["".join(rng.choices([*latin, *"aeiouAEIOU"], k=rng.randint(1, 9))) + rng.choice(["", ",", "!?"]) for _ in range(1500)]
    other = ["x1", "a\u0301b", "İs", "l'é", "3", "<|endoftext|>", "中é"]
    part = next(kernels.slices(pa.array([" ".join([*words, *other])])))
    want = whole.encode(" ".join([*words, *other]), add_special_tokens=False).ids
    for suffix_known in (True, False):
        coder = word_tokens.WordEncoder(word_tokens.vocabulary_path())
        coder.merges, coder.tokenizer = Counted(coder.merges), Counted(coder.tokenizer)
        coder.last &= suffix_known  # without ids that end a piece, all pieces take the whole way
        assert coder.spread(coder.words(part.data, part.offsets)[1]).tolist() == want
        assert len(coder.merges.texts) <= 2 and "İs" in coder.tokenizer.texts
        if suffix_known:
            assert {t for t in coder.tokenizer.texts if "İ" not in t} <= {*other, ",", "!?"}


def test_places_of_common_words_when_the_word_table_starts_anew(monkeypatch):
    from tidemark.llm import word_tokens

    words = [f"w{i % 37}x" for i in range(300)]
    monkeypatch.setattr(word_tokens, "MOST_WORDS", 20)
    coder, looked_up = word_tokens.WordEncoder(word_tokens.vocabulary_path()), []
    import pyarrow as pa

    parts = [next(kernels.slices(pa.array([" ".join(words[i : i + 30])]))) for i in range(0, 300, 30)]
    found = [lm_scoring._word_hashes(part) for part in parts]
    common = np.unique(np.concatenate([h for _, _, h in found]))[::2]
    places = lm_scoring._Places(common)
    find = places.table.find
    monkeypatch.setattr(places.table, "find", lambda keys: looked_up.extend(keys.tolist()) or find(keys))
    for again in (False, True):
        for data, spans, hashes in found:
            want = [int(np.flatnonzero(common == h)[0]) if h in common else -1 for h in hashes]
            numbers = coder.numbers(data, spans, hashes)
            assert places.find(coder, numbers, hashes).tolist() == want
            looked_up.clear()
            assert places.find(coder, numbers, hashes).tolist() == want and not looked_up


def test_attention_takes_a_step_for_every_block_without_a_start(spark):
    ids = np.array([5, 6, 7, 900, 6, 30_000] * 700, np.uint16)  # the class behind 6 depends on the id before it
    rows = [(k, lm_scoring._squeezed(ids[k % 6 :])) for k in range(64)]
    _, _, model = small_model()
    losses = lm_scoring.learn_from_all(model.attention, np.arange(lm_scoring.VOCABULARY) % lm_scoring.CLASSES, spark.createDataFrame(rows, "key long, ids binary").repartition(1))
    assert losses[-1] < 0.4 * losses[0]


def test_scores_come_from_the_attention_whatever_the_parameters(make_docs):
    docs = make_docs([" ".join(["the", "sea", "of", "rare%d" % (i % 9)] * (i % 30)) for i in range(80)])
    with pytest.raises(TypeError):
        lm_scoring.scored_texts(docs, attention=False)
    rows = lm_scoring.scored_texts(docs, drawn_windows=0).collect()
    assert len(rows) == 80 and all(r.score < 0 and math.isfinite(r.score) for r in rows)


def small_model():
    rng = np.random.default_rng(0)
    docs = [np.array(rng.choice([5, 6, 7, 900], size=n), np.uint16) for n in (0, 1, 15, 16, 17, 40, 200)]
    blobs = [lm_scoring._squeezed(d) for d in docs]
    ids, first = lm_scoring._sequences(blobs)
    ok = np.ones(len(ids) - 1, bool)
    ok[first[1:-1] - 1] = False
    pairs, n = np.unique((ids[:-1][ok] << 16) | ids[1:][ok], return_counts=True)
    return docs, blobs, lm_scoring.Scorer(np.bincount(pairs & 0xFFFF, n, lm_scoring.VOCABULARY), pairs, n.astype(float))


def test_each_position_is_scored_once():
    first = np.concatenate(([0], np.cumsum([2, 3, 17, 18, 30, 100])))
    begin, doc, scored = lm_scoring.windows_of(first)
    at = np.sort((begin[:, None] + np.arange(lm_scoring.WINDOW))[scored])
    ends = set((first[1:] - 1).tolist())
    assert at.tolist() == [i for i in range(first[-1]) if i not in ends]


def test_scores_are_probabilities_and_do_not_depend_on_company():
    docs, blobs, model = small_model()
    together = model.score(blobs)
    assert np.allclose(together, [model.score([b])[0] for b in blobs])
    # All continuations of one id: probabilities of one more id add up to one.
    every = np.arange(lm_scoring.VOCABULARY)
    before = np.full(len(every), 6)
    inside = np.bincount(model.group, np.exp(model.inside(before, every)), lm_scoring.CLASSES)
    assert np.allclose(inside[np.unique(model.group)], 1, atol=1e-4)


def test_attention_is_causal_and_gradients_are_right():
    _, _, model = small_model()
    net = model.attention
    rng = np.random.default_rng(1)
    ids = rng.choice([5, 6, 7, 900], size=(4, lm_scoring.WINDOW))
    changed = ids.copy()
    changed[:, 9:] = 5
    assert np.allclose(net.forward(ids)[:, :9], net.forward(changed)[:, :9], atol=1e-5)
    goal, weight = rng.integers(0, lm_scoring.CLASSES, ids.shape), rng.random(ids.shape)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    _, grads = net.gradients(ids, goal, weight)
    for name in net.NAMES:
        array = getattr(net, name)
        spot = np.unravel_index(np.abs(grads[name]).argmax(), array.shape)
        losses = []
        for step in (1e-4, -2e-4):
            array[spot] += step
            losses.append(net.gradients(ids, goal, weight)[0])
        array[spot] += 1e-4
        assert math.isclose((losses[0] - losses[1]) / 2e-4, grads[name][spot], rel_tol=2e-2, abs_tol=1e-5)


# -- 9


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
    <header>Top</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad big">Buy</div>
    <article><h1>A &amp; B&nbsp;C</h1><p><b>First  <i>line</i><br>goes on.<p>Second, with <a href="x>y">a link</a>.</p>
    <aside>Side</aside><ul><li>One<li>Two</ul><form>Mail</form><div id="comments"><p>Nice!</p></div></article>
    <div class="cookie-notice">Cookies</div><footer>End</footer></body></html>"""
    assert html_extraction.main_text(page) == "A & B C\n\nFirst line goes on.\n\nSecond, with a link.\n\nOne\n\nTwo"


def test_words_of_names_take_only_containers_beside_the_text():
    body = "".join(f'<p class="notice">Sentence <span class="share">number {k}</span> has a good number of words in it.</p>' for k in range(6))
    page = f"""<body><div class="content with-sidebar"><article><h2 id="related-work">Related work</h2>{body}
    <div data-id="ad">Kept by its data.</div></article><div class="sidebar"><p>Side</p></div></div></body>"""
    text = html_extraction.main_text(page)
    assert text.startswith("Related work\n\nSentence number 0 has") and "number 5" in text and text.endswith("Kept by its data.") and "Side" not in text


def test_density_chooses_and_tags_only_widen():
    body = "".join(f"<p>Sentence number {k} has a good number of words in it.</p>" for k in range(9))
    teasers = "".join(f'<p><a href="/{k}">Teaser {k}</a> by us</p>' for k in range(4))
    beside = f"<body><main><article><h1>Head</h1>{body}</article><div class='teasers'>{teasers}</div></main></body>"
    assert html_extraction.main_text(beside).startswith("Head\n\nSentence number 0") and "Teaser" not in html_extraction.main_text(beside)
    mixed = f"<body><main><div>{body}</div><div>{teasers}</div></main></body>"
    assert html_extraction.main_text(mixed).startswith("Sentence number 0") and "Teaser" not in html_extraction.main_text(mixed)
    widened = f"<body><div><a href='/'>Home</a></div><article><h1>Head</h1><div>{body}</div></article></body>"
    assert html_extraction.main_text(widened).startswith("Head\n\nSentence number 0")
    outside = f"<body><div>{body}</div><article><p>Short note.</p></article></body>"
    assert "Sentence number 8" in html_extraction.main_text(outside)


def test_main_text_without_article():
    body = "".join(f"<p>Sentence number {k} has a good number of words in it.</p>" for k in range(6))
    links = "".join(f'<li><a href="/{k}">link {k}</a></li>' for k in range(20))
    page = f"<body><div><ul>{links}</ul></div><div><h2>Head</h2>{body}</div></body>"
    assert html_extraction.main_text(page).startswith("Head\n\nSentence number 0") and "link" not in html_extraction.main_text(page)


@pytest.mark.parametrize("page", [None, "", "plain text", "<", "<p", "</p></div>", "<p>a<p>b", "<script>x", "<!--", "<div>" * 3000 + "deep", "&#0;&bogus;&lt;"])
def test_main_text_of_odd_pages(page):
    assert isinstance(html_extraction.main_text(page), str)
    assert html_extraction.main_text("<div>" * 3000 + "deep") == "deep" and html_extraction.main_text("<p>a<p>b") == "a\n\nb"


def test_named_containers_inside_the_text_need_more_than_a_word():
    body = "".join(f"<p>Sentence number {k} has a good number of words in it.</p>" for k in range(6))
    inner = "<section class='search'><p>How a search works is told at some length in this part of the article.</p></section>"
    links = "<div class='related'><a href='/1'>One more</a> <a href='/2'>And another</a></div>"
    page = f"""<body><article><div class="entry-header"><h1>Head</h1><span>by us, five minutes</span></div>{body}{inner}
    <div class="ad">Buy</div><div class="share"><span>Tell</span> <span>all</span></div>{links}</article></body>"""
    blocks = html_extraction.main_text(page).split("\n\n")
    assert blocks[0] == "Head" and "five minutes" in blocks[1] and blocks[-1].startswith("How a search works") and len(blocks) == 9


@pytest.mark.parametrize(
    "bit", ["<a ", '<a "', "<a '\"", '<a ">"', "<a \">'>", "<div>", "</x", "</div>", "<b>", "<p", "<", "<!--", "<! ", "<script", "<script></script", "<td><div><b>", "<li><b>", '<div class="ad">', "<p><i></p>"]
)
def test_malformed_pages_take_linear_time(bit):
    import time

    began = time.process_time()
    assert isinstance(html_extraction.main_text(bit * (300_000 // len(bit))), str)
    for opened, later in [("<div>", "</x>"), ("<b>", "<p></p>"), ("<b>", "<td></td>")]:
        html_extraction.main_text("<td><div>" + opened * 10_000 + bit * 100 + later * 10_000)
    assert time.process_time() - began < 10


def test_main_texts_of_rows_that_share_ids(spark):
    rows = [(1, "u", "<p>One two three.</p>", "x"), (1, "u", "<p>Other text.</p>", "y"), (None, None, "<p>No id.</p>", None), (2, "u", None, "z"), (3, None, "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extraction.main_texts(pages).collect())
    assert got == [(0, "No id.", 6), (1, "One two three.", 14), (1, "Other text.", 11), (2, "", 0), (3, "", 0)]
    assert html_extraction.main_texts(pages).columns == ["page_id", "url", "text", "n_chars"]


def test_main_texts_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html

    for r in html_extraction.main_texts(pages).join(pages, ["page_id", "url"]).collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    assert html_extraction.main_texts(pages.where("false")).collect() == []
