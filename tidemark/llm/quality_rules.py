"""Line-first cleaning, and the repetition counts of whole texts.

Each line is judged by itself:

* navigation: at least three separators (``|``, ``>``, ``»``, ``·``, ``•``), one to four words or fewer;
* boilerplate: a fixed phrase of site furniture in it;
* punctuation: a line of fewer than eight words that does not end a sentence, a line whose symbols make
  up over a tenth of its characters, or one in which over a third of the words end with an exclamation.

Lines that fail are removed. A document is rejected if its base rules fail or if the removed lines held
more than ``most_lost`` of its word characters.

All of it is byte arithmetic over many texts at once; no row meets another, so there is no shuffle.

Defined cases. Null and empty texts have no words and fail the base rules. Blank lines are neither
judged nor counted as repeated. Repeated or null ids do not matter; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.frames import in_batches

# Phrases of site furniture, in lower case.
PHRASES = [
    "accept cookies", "all rights reserved", "click here to", "cookie policy", "enable javascript", "javascript is disabled", "log in to your account",
    "lorem ipsum", "privacy policy", "sign up for our", "skip to content", "subscribe to our", "terms of service", "terms of use", "use of cookies",
]
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_CHAR_START = (np.arange(256) & 0xC0) != 0x80
_FULL_STOPS = np.zeros(256, bool)
_FULL_STOPS[list(b".!?:;\"')]}")] = True
# Last bytes of the quotes and stops outside ASCII that may end a sentence, with the two before them.
_WIDE_STOPS = [s.encode() for s in ("»", "”", "’", "…", "。", "！", "？")]
_SEPARATORS = [s.encode() for s in ("|", ">", "»", "·", "•")]
WINDOW, FEW_WORDS, MOST_LOST = 5, 8, 0.5


def _marks(data: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """True at the last byte of each occurrence."""
    out = np.zeros(len(data), bool)
    for mark in marks:
        hit = data[len(mark) - 1 :] == mark[-1]
        for j, byte in enumerate(mark[:-1]):
            hit &= data[j : len(data) - len(mark) + 1 + j] == byte
        out[len(mark) - 1 :] |= hit
    return out


def sums_at(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums between neighbouring edges."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return np.diff(total[edges])


def line_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of every line; a text has one line more than line feeds."""
    feeds = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate((offsets[:-1], feeds + 1)))
    end = np.sort(np.concatenate((feeds, offsets[1:])))
    lines = np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1]) + 1
    return begin, end, np.repeat(np.arange(len(offsets) - 1), lines)


def repeats_of(keys: np.ndarray) -> np.ndarray:
    """For each key: how often it occurs."""
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[back]


def in_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of the same text."""
    return K.mixed(hashes ^ K.mixed(text.astype(np.uint64) + np.uint64(1)))


def repeat_words(hashes: np.ndarray, words: K.Words, text: np.ndarray) -> np.ndarray:
    """Words inside windows that occur twice or more in their text, as a mask."""
    n = len(hashes) - WINDOW + 1
    covered = np.zeros(len(hashes) + 1, np.int64)
    if n > 0:
        ok = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
        twice = ok[repeats_of(in_text(K.shingle_hashes(hashes, WINDOW)[ok], text[ok])) > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    return np.cumsum(covered[:-1]) > 0


class Lines:
    """The lines of a slice and which of them fail."""

    def __init__(self, part: K.Slice, words: K.Words):
        data = part.data
        self.begin, self.end, self.text = line_edges(data, part.offsets)
        last = np.searchsorted(words.ends, self.end, side="right")
        first = np.searchsorted(words.starts, self.begin)
        self.n_words = last - first
        self.full = self.n_words > 0
        inside = K.NOT_SPACE[data]
        chars = np.concatenate(([0], np.cumsum(inside & _CHAR_START[data])))
        self.chars = chars[self.end] - chars[self.begin]

        def count(mask):
            total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
            return total[self.end] - total[self.begin]

        stops = _FULL_STOPS[data] | _marks(data, _WIDE_STOPS)
        tail = np.zeros(len(self.begin), bool)
        tail[self.full] = stops[words.ends[last[self.full] - 1] - 1]
        loud = np.zeros(len(data), bool)
        loud[words.ends - 1] = data[words.ends - 1] == ord("!")
        separators, symbols = count(_marks(data, _SEPARATORS)), count(SYMBOLS[data])
        navigation = (separators >= 3) & (self.n_words <= 5 * separators)
        punctuation = (~tail & (self.n_words < FEW_WORDS)) | (10 * symbols > self.chars) | (3 * count(loud) > self.n_words)
        boilerplate = np.zeros(len(self.begin), bool)
        lower = K.LOWER[data].tobytes()
        for phrase in map(str.encode, PHRASES):
            at = lower.find(phrase)
            while at >= 0:
                line = np.searchsorted(self.begin, at, side="right") - 1
                boilerplate[line] |= at + len(phrase) <= self.end[line]
                at = lower.find(phrase, at + 1)
        self.fails = self.full & (navigation | punctuation | boilerplate)


def _judged(most_lost: float, with_text: bool):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns, texts = [], []
        for part in K.slices(batch["text"]):
            n, data = len(part), part.data
            words = K.word_spans(data, part.offsets, K.NOT_SPACE)
            sums = K.prefix_sums(data)
            text = words.text_of()
            repeated = repeat_words(K.span_hashes(sums, words.starts, words.ends), words, text)
            lines = Lines(part, words)
            full = np.flatnonzero(lines.full)
            keys = in_text(K.span_hashes(sums, lines.begin[full], lines.end[full]), lines.text[full])
            first = np.zeros(len(full), bool)
            first[np.unique(keys, return_index=True)[1]] = True
            n_words = np.diff(words.first)
            n_repeat = sums_at(repeated, words.first)
            chars = np.bincount(lines.text, lines.chars, n).astype(np.int64)
            lost = np.bincount(lines.text, lines.chars * lines.fails, n).astype(np.int64)
            failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
            columns.append((n_words, chars, sums_at(SYMBOLS[data], part.offsets), np.bincount(lines.text[full][~first], minlength=n), n_repeat,
                            failed, ~failed & (lost <= most_lost * chars), np.bincount(lines.text, lines.full, n).astype(np.int64),
                            np.bincount(lines.text, lines.fails, n).astype(np.int64), lost))
            if with_text:
                rest = [[] for _ in range(n)]
                for t, a, b in zip(*(x[~lines.fails].tolist() for x in (lines.text, lines.begin, lines.end))):
                    rest[t].append(data[a:b].tobytes())
                texts += [b"\n".join(r).decode() for r in rest]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "chars_removed"]
        arrays = [pa.array(x if x.dtype == bool else x.astype(np.int64)) for x in map(np.concatenate, zip(*columns))]
        if with_text:
            names, arrays = [*names, "text"], [*arrays, pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], ["doc_id", *names])

    return work


def cleaned(docs: DataFrame, most_lost: float = MOST_LOST, with_text: bool = True) -> DataFrame:
    """Counts, verdicts and (with_text) the remaining lines of each row of ``docs`` (doc_id, text)."""
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean,"
        " n_lines long, n_lines_removed long, chars_removed long" + (", text string" if with_text else "")
    )
    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _judged(most_lost, with_text), schema)
