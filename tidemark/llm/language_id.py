"""Language of a text from n-gram filters that answer for all languages at once.

A Bloom filter's slots hold one bit per language instead of one bit (bit-sliced: eight languages to a
byte), so the slots of an n-gram, combined by AND, give the set of all languages that contain it. Per
text and language the bits are counted. A filter with the share f of its bits set lets an unknown
n-gram through with probability f**k; the counted share s is corrected to (s - f**k) / (1 - f**k).
The language with the largest corrected share is predicted; its part of all shares is the score.

Learning. N-grams of 3 and 4 letters (lower case, one boundary sign between words) of at most
``most_docs`` documents per language, drawn by a hash of the identifier, a documented bound for fitting
only. A language's set has the n-grams that make up at least one in ``rarest`` of its n-grams, so it
has at most ``rarest`` entries per order, whatever the corpus.

Defined cases. ``und`` with score 0: null or empty texts, texts without a letter, and all texts if
there is nothing to learn from. Rows are judged one by one; null ids belong to no fold (not held out).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.frames import carried, id_lot, in_batches

ORDERS, PROBES, RAREST, MOST_DOCS = (3, 4), 3, 20_000, 3_000
FOLDS, HELD_OUT = 4, 2
_STEPS = np.random.default_rng(1).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)


@functools.cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_rows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points with 0 for all that is no letter, a 0 behind each text; and where texts begin."""
    lowered = [(t or "").lower() + "\n" for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate(([0], np.cumsum([len(t) for t in lowered])))
    return np.where(_is_letter()[points], points, 0), first


def grams(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the n-grams that have letters everywhere but perhaps at their ends.

    No n-gram spans two texts: the sign between them can only be its first or its last.
    """
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = points[1 : 1 + size] > 0
    h = np.full(size, n, np.uint64)
    for j in range(n):
        h += points[j : j + size].astype(np.uint64) * _STEPS[j]
        if 1 < j < n - 1:
            ok &= points[j : j + size] > 0
    at = np.flatnonzero(ok)
    return at, K.mixed(h[at])


def _batch_pieces(batch: pa.RecordBatch):
    for part in K.slices(batch["text"]):
        yield part.lo, part.hi, batch["text"].slice(part.lo, part.hi - part.lo).to_pylist()


def _gram_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    langs, out = np.array(batch["lang"].to_pylist(), object), []
    for lang in sorted(set(langs)):
        rows = np.flatnonzero(langs == lang)
        found = [grams(letter_rows(batch["text"].take(pa.array(rows)).to_pylist())[0], n)[1] for n in ORDERS]
        for n, h in zip(ORDERS, found):
            values, counts = np.unique(h, return_counts=True)
            out.append((lang, n, values, counts))
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in out for _ in x[2]], pa.string()), pa.array(np.repeat([x[1] for x in out], [len(x[2]) for x in out]), pa.int32()),
         pa.array(K.signed(np.concatenate([x[2] for x in out]))), pa.array(np.concatenate([x[3] for x in out]))],
        ["lang", "n", "gram", "count"],
    )


class Filters:
    """The bit-sliced filter: ``slots[g]`` holds the bits of languages 8g to 8g+7."""

    def __init__(self, sets: dict[str, np.ndarray]):
        self.langs = sorted(sets)
        most = max((len(s) for s in sets.values()), default=1)
        self.bits = min(20, max(10, int(np.ceil(np.log2(6 * max(1, most))))))
        self.slots = np.zeros((-(-len(self.langs) // 8), 1 << self.bits), np.uint8)
        for i, lang in enumerate(self.langs):
            for at in self._probes(sets[lang]):
                self.slots[i // 8][at] |= np.uint8(1 << (i % 8))
        fill = [((self.slots[i // 8] >> np.uint8(i % 8)) & 1).mean() for i in range(len(self.langs))]
        self.false_share = np.array(fill) ** PROBES

    def _probes(self, h: np.ndarray):
        mask = np.uint64((1 << self.bits) - 1)
        return [((h >> np.uint64(20 * j)) & mask).astype(np.int64) for j in range(PROBES)]

    def shares(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Corrected share of n-grams, by text and language."""
        texts = len(first) - 1
        total = np.zeros(texts)
        counts = np.zeros((texts, 8 * len(self.slots)))
        table = (np.arange(256)[:, None] >> np.arange(8)) & 1
        for n in ORDERS:
            at, h = grams(points, n)
            # The sign behind a text may be the first of the next text's n-gram: that one is the next text's.
            text = np.searchsorted(first, at + 1, side="right") - 1
            total += np.bincount(text, minlength=texts)
            probes = self._probes(h)
            for g, slots in enumerate(self.slots):
                mask = slots[probes[0]]
                for at_j in probes[1:]:
                    mask &= slots[at_j]
                seen = np.bincount(text * 256 + mask, minlength=256 * texts).reshape(texts, 256)
                counts[:, 8 * g : 8 * g + 8] += seen @ table
        share = counts[:, : len(self.langs)] / np.maximum(total, 1)[:, None]
        return np.clip((share - self.false_share) / (1 - np.minimum(self.false_share, 0.999)), 0, 1)


def learn(labelled: DataFrame, most_docs: int = MOST_DOCS, rarest: int = RAREST) -> Filters:
    """Filters from rows (doc_id, text, lang)."""
    usable = labelled.where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return Filters({})
    spread = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, round(min(1.0, most_docs / n) * 1_000_000))])
    drawn = usable.where(spread < share[F.col("lang")]).select("text", "lang")
    counts = in_batches(drawn, _gram_counts, "lang string, n int, gram long, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("c"))
    totals = counts.groupBy("lang", "n").agg(F.sum("c").alias("total"))
    rows = counts.join(totals, ["lang", "n"]).where(F.col("c") * rarest >= F.col("total")).select("lang", "gram").collect()
    sets: dict[str, list] = {lang: [] for lang in sizes}
    for r in rows:
        sets[r.lang].append(r.gram)
    return Filters({lang: np.array(found, np.int64).view(np.uint64) for lang, found in sets.items()})


def _predicted(filters, carry=()):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, names, scores, tops = filters.value, [], [], []
        for _, _, texts in _batch_pieces(batch):
            points, first = letter_rows(texts)
            letters = np.add.reduceat(points > 0, first[:-1], dtype=np.int64) > 0
            if own.langs:
                shares = own.shares(points, first)
                best = shares.argmax(axis=1)
                top = shares.max(axis=1)
                part = top / np.maximum(shares.sum(axis=1), 1e-12)
            for i, has in enumerate(letters):
                known = bool(has and own.langs)
                names.append(own.langs[best[i]] if known else "und")
                scores.append(float(min(1.0, part[i])) if known else 0.0)
                tops.append(float(top[i]) if known else 0.0)
        arrays = [batch["doc_id"], batch["held_out"], pa.array(names), pa.array(scores), pa.array(tops), *(batch[c] for c in carry)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score", "share", *carry])

    return work


def languages(docs: DataFrame, most_docs: int = MOST_DOCS, rarest: int = RAREST, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, share) for each row of ``docs`` (doc_id, text, lang).

    ``share`` is the corrected share of the predicted language. Learns from rows not held out. The
    columns named in ``carry`` (not doc_id) come along unchanged.
    """
    lot = id_lot("doc_id", FOLDS)
    held = F.coalesce(lot == HELD_OUT, F.lit(False)).alias("held_out")
    filters = learn(docs.select("doc_id", "text", "lang", held).where("not held_out"), most_docs, rarest)
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text", *(c for c in carry if c != "text"))
    return in_batches(rows, _predicted(sent, carry), carried(docs, carry, "doc_id long, held_out boolean, lang_pred string, score double, share double"))
