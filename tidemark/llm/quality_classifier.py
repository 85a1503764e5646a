"""Quality score by a generalised additive model with pairwise interactions.

Features of a text are numbers about its words, lines and characters. Each feature is cut into bins at
quantiles of the training rows. Boosting goes round the features in a fixed cycle: each time a shallow
regression tree on one feature's bins (at most four leaves) moves that feature's lookup table a little
towards the gradient. Then the pairs of features whose residual gains most from a tree over both are
found, and the cycle goes round these pairs with tables over two coarse bins. A score is a sum of table
entries, looked up for whole batches at once, and a logistic function.

Learning sees at most ``most_rows`` labelled rows, drawn by a hash of the identifier (a documented bound
for fitting); features and scores are computed for every row and whole text.

Defined cases. Null and empty texts have the features of an empty text and a score like any other.
Labels without a document, null labels and null ids teach nothing; a document with several labels counts
once for each. If only one class, or no label at all, is there, every score is the share of label 1
(0.5 without labels). Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm import quality_rules as R
from tidemark.llm.frames import id_lot, in_batches, settled

FOLDS, HELD_OUT, CUT = 4, 2, 0.7
MOST_ROWS, BINS, PAIR_BINS, CYCLES, PAIR_CYCLES, PAIRS, RATE = 20_000, 48, 8, 120, 60, 8, 0.1
FEATURES = [
    "log_words", "chars_a_word", "upper", "digits", "symbols", "stops", "commas", "other_marks", "not_ascii", "same_lines", "repeated_words",
    "distinct_words", "words_a_line", "short_words", "long_words", "commonest_word", "loud_words", "failed_lines", "failed_chars", "marked_words",
]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _ALPHA, _DIGIT = _class(bytes(range(65, 91))), _class(bytes([*range(65, 91), *range(97, 123)])), _class(bytes(range(48, 58)))
_STOP, _COMMA, _WIDE = _class(b".!?"), _class(b",;:"), np.arange(256) >= 128
_MARK = _class(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".!?,;:#*$%&|<>'\"-"))


def features(part: K.Slice) -> np.ndarray:
    """One row of features for each text of a slice."""
    n, data = len(part), part.data
    words = K.word_spans(data, part.offsets, K.NOT_SPACE)
    text = words.text_of()
    hashes = K.span_hashes(K.prefix_sums(K.LOWER[data]), words.starts, words.ends)
    lines = R.Lines(part, words)
    n_words = np.diff(words.first)
    some = np.maximum(1, n_words)

    def share(mask, of=None):
        return R.sums_at(mask, part.offsets) / np.maximum(1, np.diff(part.offsets) if of is None else of)

    size = words.ends - words.starts
    keys = R.in_text(hashes, text)
    distinct, first, times = np.unique(keys, return_index=True, return_counts=True)
    commonest = np.zeros(n)
    np.maximum.at(commonest, text[first], times)
    full = np.flatnonzero(lines.full)
    line_keys = R.in_text(K.span_hashes(K.prefix_sums(data), lines.begin[full], lines.end[full]), lines.text[full])
    line_first = np.unique(line_keys, return_index=True)[1]
    n_lines = np.bincount(lines.text[full], minlength=n)
    chars = np.maximum(1, np.bincount(lines.text, lines.chars, n))
    last = data[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)

    def per_word(mask):
        return np.bincount(text, mask, n) / some

    columns = [
        np.log1p(n_words), np.bincount(text, size, n) / some, share(_UPPER[data], R.sums_at(_ALPHA[data], part.offsets)), share(_DIGIT[data]), share(R.SYMBOLS[data]),
        share(_STOP[data]), share(_COMMA[data]), share(_MARK[data]), share(_WIDE[data]),
        (n_lines - np.bincount(lines.text[full][line_first], minlength=n)) / np.maximum(1, n_lines), per_word(R.repeat_words(hashes, words, text)),
        np.bincount(text[first], minlength=n) / some, n_words / np.maximum(1, n_lines), per_word(size <= 3), per_word(size >= 13), commonest / some,
        per_word(last == ord("!")), np.bincount(lines.text, lines.fails, n) / np.maximum(1, n_lines), np.bincount(lines.text, lines.chars * lines.fails, n) / chars,
        per_word(R.SYMBOLS[last]),
    ]
    return np.column_stack(columns)


def _feature_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    table = np.concatenate([features(part) for part in K.slices(batch["text"])])
    return pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *map(pa.array, table.T)], ["doc_id", "held_out", *FEATURES])


# -- the model ------------------------------------------------------------------------------------


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins (0: no cut)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    total_g, total_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
    gain = np.where((left_h > 1) & (total_h - left_h > 1), gain, 0)
    at = int(gain.argmax()) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) and gain[at] > 1e-9 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value of each bin for a tree of depth two."""
    out = np.zeros(len(g))
    _, middle = _best_cut(g, h)
    for a, b in ((0, middle), (middle, len(g))):
        if a == b:
            continue
        _, cut = _best_cut(g[a:b], h[a:b])
        for c, d in ((a, a + cut), (a + cut, b)):
            if c < d:
                out[c:d] = g[c:d].sum() / (h[c:d].sum() + 1)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree that cuts one axis, then each half along the other."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(gg)):
            out, gain = np.zeros_like(gg), 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                a, b = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
                _, place = _best_cut(a, b)
                for cols in (slice(0, place), slice(place, None)):
                    x, y = a[cols].sum(), b[cols].sum()
                    gain += x * x / (y + 1)
                    out[rows, cols] = x / (y + 1)
            if gain > best[0]:
                best = (gain, out.T if turned else out)
    return best


class Model:
    """Cut points, one table per feature, and tables over pairs of coarse bins."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        k = rows.shape[1] if len(rows) else len(FEATURES)
        self.base, self.cuts, self.coarse, self.tables, self.pairs = 0.0, [np.zeros(0)] * k, [np.zeros(0)] * k, [np.zeros(1)] * k, {}
        if not len(rows):
            return
        mean = labels.mean()
        if mean in (0.0, 1.0):
            self.base = 30.0 if mean else -30.0
            return
        self.base = float(np.log(mean / (1 - mean)))
        self.cuts = [np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1])) for x in rows.T]
        self.coarse = [np.unique(np.quantile(x, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for x in rows.T]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        fine, coarse = self._bins(rows, self.cuts), self._bins(rows, self.coarse)
        score = np.full(len(rows), self.base)

        def slopes():
            p = 1 / (1 + np.exp(-score))
            return labels - p, p * (1 - p)

        for _ in range(CYCLES):
            for j, table in enumerate(self.tables):
                g, h = slopes()
                step = RATE * shallow_tree(np.bincount(fine[j], g, len(table)), np.bincount(fine[j], h, len(table)))
                table += step
                score += step[fine[j]]
        g, h = slopes()
        gains = []
        for i in range(k):
            for j in range(i):
                gains.append((pair_tree(*self._grids(coarse, i, j, g, h))[0], i, j))
        for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
            self.pairs[i, j] = np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))
        for _ in range(PAIR_CYCLES):
            for (i, j), table in self.pairs.items():
                g, h = slopes()
                step = RATE * pair_tree(*self._grids(coarse, i, j, g, h))[1]
                table += step
                score += step[coarse[i], coarse[j]]

    @staticmethod
    def _bins(rows, cuts):
        return [np.searchsorted(c, x, side="right") for c, x in zip(cuts, rows.T)]

    def _grids(self, coarse, i, j, g, h):
        shape = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
        cell = coarse[i] * shape[1] + coarse[j]
        return tuple(np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (g, h))

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        for table, bins in zip(self.tables, self._bins(rows, self.cuts)):
            total += table[bins]
        coarse = self._bins(rows, self.coarse)
        for (i, j), table in self.pairs.items():
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _scored(model):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.value.score(np.column_stack([batch[f].to_numpy() for f in FEATURES]))
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return work


def quality_scores(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; ``labels`` has (doc_id, quality)."""
    held = F.coalesce(id_lot("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    schema = "doc_id long, held_out boolean, " + ", ".join(f"{f} double" for f in FEATURES)
    table = settled(in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text"), _feature_rows, schema))
    marked = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    usable = table.where("not held_out").join(marked, "doc_id")
    n = marked.count()
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    drawn = usable.where(spread < round(min(1.0, most_rows / max(1, n)) * 1_000_000)).orderBy("doc_id").select(*FEATURES, "quality").toPandas()
    model = Model(drawn[FEATURES].to_numpy(float), drawn["quality"].to_numpy(float))
    return in_batches(table, _scored(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double, predicted int")
