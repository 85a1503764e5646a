"""Benchmark passages in documents, by a prefix-filtered join of word windows.

Windows are 13 consecutive words of a benchmark item (an item of fewer words is one window). The
elements of a window are its three-word shingles (a shorter window: itself). A document that holds a
window holds all its elements, so the filter's prefix is one element long: the rarest, by counts over
all documents. Documents are joined on that element only. A match names one place in the document; the
place must leave room before it (position) and behind it (length), and the window's words must then
stand there, compared byte by byte.

Scale. The benchmark is the stated query set. Its distinct windows are dealt into blocks of at most
``block`` windows; a block's table has a few MB, whatever the benchmark's size, and documents pass all
blocks in one job without a shuffle. Only a block's windows and element counts reach the driver.

Defined cases. Null, empty or wordless texts have no words and no hits; items without words have no
windows. Items with equal windows are all named; a null item_id marks words but is not named. Rows
are judged one by one, so repeated or null doc_ids do not matter. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.frames import carried, in_batches, settled

WINDOW, ELEMENT, BLOCK = 13, 3, 50_000


def _lowered_words(part: K.Slice):
    data = K.LOWER[part.data]
    words = K.word_spans(data, part.offsets, K.LETTERS_DIGITS)
    return data, words, K.span_hashes(K.prefix_sums(data), words.starts, words.ends)


def _windows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, texts = [], []
    names = batch["item_id"].to_pylist()
    for part in K.slices(batch["text"]):
        data, words, _ = _lowered_words(part)
        for row, (a, b) in enumerate(zip(words.first[:-1], words.first[1:]), part.lo):
            own = [data[s:e].tobytes() for s, e in zip(words.starts[a:b], words.ends[a:b])]
            for i in range(max(1, len(own) - WINDOW + 1) if own else 0):
                ids.append(names[row])
                texts.append(b" ".join(own[i : i + WINDOW]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], ["item_id", "words"])


class Block:
    """The windows of a block: their words, and their elements by hash."""

    def __init__(self, windows: list[bytes], items: list[list]):
        self.windows, self.items = windows, items
        spaced = np.frombuffer(b" ".join(windows), np.uint8)
        spans = K.word_spans(spaced, np.array([0, len(spaced)]), K.NOT_SPACE)
        hashes = K.span_hashes(K.prefix_sums(spaced), spans.starts, spans.ends)
        self.sizes = np.array([w.count(b" ") + 1 for w in windows])
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.hashes = hashes
        elements, owner, place = [], [], []
        for i, (a, m) in enumerate(zip(self.first, self.sizes)):
            k = min(ELEMENT, m)
            found = K.shingle_hashes(hashes[a : a + m], k) ^ np.uint64(k)
            elements.append(found)
            owner.append(np.full(len(found), i))
            place.append(np.arange(len(found)))
        self.elements, self.owner, self.place = map(np.concatenate, (elements, owner, place))
        self.orders = sorted({min(ELEMENT, int(m)) for m in self.sizes})
        self.table = K.WordTable()
        self.distinct = np.unique(self.elements)
        self.table.add(self.distinct)
        self.number = self.table.find(self.elements)

    def choose(self, counts: np.ndarray) -> None:
        """Keep the rarest element of each window (ties: the first)."""
        order = np.lexsort((self.place, counts[self.number], self.owner))
        rarest = order[np.concatenate(([True], np.diff(self.owner[order]) > 0))]
        tokens, back = np.unique(self.elements[rarest], return_inverse=True)
        by_token = np.argsort(back, kind="stable")
        self.table = K.WordTable()
        self.table.add(tokens)
        self.token_window = self.owner[rarest][by_token]
        self.token_place = self.place[rarest][by_token]
        self.token_first = np.concatenate(([0], np.cumsum(np.bincount(back, minlength=len(tokens)))))
        del self.elements, self.owner, self.place, self.number, self.distinct

    def meetings(self, hashes: np.ndarray):
        """(position, element number) of each element of this block in a row of words."""
        for k in self.orders:
            numbers = self.table.find(K.shingle_hashes(hashes, k) ^ np.uint64(k))
            at = np.flatnonzero(numbers >= 0)
            yield at, numbers[at]

    def found(self, data, words: K.Words, hashes) -> Iterator[tuple[int, int, int]]:
        """(text, first word, window) of each true occurrence."""
        for at, token in self.meetings(hashes):
            n = self.token_first[token + 1] - self.token_first[token]
            which = np.repeat(self.token_first[token], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            window = self.token_window[which]
            start = np.repeat(at, n) - self.token_place[which]
            text = np.searchsorted(words.first, np.repeat(at, n), side="right") - 1
            room = (start >= words.first[text]) & (start + self.sizes[window] <= words.first[text + 1])
            window, start, text = window[room], start[room], text[room]
            for j in range(WINDOW):
                longer = np.flatnonzero(self.sizes[window] > j)
                if len(longer):
                    same = np.ones(len(window), bool)
                    same[longer] = hashes[start[longer] + j] == self.hashes[self.first[window[longer]] + j]
                    window, start, text = window[same], start[same], text[same]
            for t, s, w in zip(text.tolist(), start.tolist(), window.tolist()):
                e = s + int(self.sizes[w])
                if self.windows[w] == b" ".join(data[a:b].tobytes() for a, b in zip(words.starts[s:e], words.ends[s:e])):
                    yield t, s, w


def _counts(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        total = np.zeros(len(own.distinct), np.int64)
        for batch in batches:
            for part in K.slices(batch["text"]):
                for _, numbers in own.meetings(_lowered_words(part)[2]):
                    total += np.bincount(numbers, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["element", "n"])

    return run


def _judged(blocks, carry=()):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_hit, items = [], [], [set() for _ in range(batch.num_rows)]
        for part in K.slices(batch["text"]):
            data, words, hashes = _lowered_words(part)
            edges = np.zeros(len(hashes) + 1, np.int64)
            for block in blocks:
                own = block.value
                for text, start, window in own.found(data, words, hashes):
                    edges[start] += 1
                    edges[start + own.sizes[window]] -= 1
                    items[part.lo + text].update(own.items[window])
            hit = np.concatenate(([0], np.cumsum(np.cumsum(edges[:-1]) > 0)))
            n_words.append(np.diff(words.first))
            n_hit.append(np.diff(hit[words.first]))
        n_words, n_hit = np.concatenate(n_words), np.concatenate(n_hit)
        named = [sorted(map(str, x)) for x in items]
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in named], pa.int64()),
             pa.array(digests, pa.string()), pa.array((n_hit > 0) & (20 * n_hit >= n_words)), pa.array(named, pa.list_(pa.string())), *(batch[c] for c in carry)],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", *carry],
        )

    return work


def contamination(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) for each row of ``docs``.

    The columns named in ``carry`` (not doc_id) come along unchanged.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c for c in carry if c != "text"))
    asked = in_batches(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), _windows_of, "item_id long, words binary")
    windows = settled(asked.groupBy("words").agg(F.collect_set("item_id").alias("items")))
    n_blocks = -(-windows.count() // block)
    blocks = []
    for b in range(n_blocks):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == b).collect()
        if not rows:
            continue
        own = Block([bytes(r.words) for r in rows], [r["items"] for r in rows])
        sent = spark.sparkContext.broadcast(own)
        counts = np.zeros(len(own.distinct), np.int64)
        for r in texts.select("text").mapInArrow(_counts(sent), "element long, n long").groupBy("element").agg(F.sum("n").alias("n")).collect():
            counts[r.element] = r.n
        own.choose(counts)
        sent.unpersist()
        blocks.append(spark.sparkContext.broadcast(own))
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    return in_batches(texts, _judged(blocks, carry), carried(docs, carry, schema))
