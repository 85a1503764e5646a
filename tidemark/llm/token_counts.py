"""Token counts that follow edits without encoding a text anew.

A document keeps a segment tree over its pre-tokens, the white-space pieces that the tokenizer never
joins. A leaf is a stretch of at most 128 of them with its characters; inner nodes hold the characters,
tokens and pieces of their subtrees. An edit replaces a range of characters: sums lead down to its leaf,
only the pieces it touches, with the piece at either boundary, are encoded again, and the sums on the
path to the root change by the difference. No text and no position outside the leaf is touched. A leaf
that outgrows its size is split and the tree above the leaves summed again, once in 64 new pieces.

``edited_counts`` applies an edit table to documents, both dealt by document. The edits of a document
are applied in order, each to the text the ones before it left. ``masked_counts`` finds its edits itself.

Scale. Documents and edits meet in one join on the document; trees live in a task only while their
document is worked on. Encoding shares a table of pieces per Python worker.

Defined cases. Null text is empty; no edits leave the count as it is; ranges are clipped to the text;
null replacement deletes. Rows with the same doc_id get the same edits each. Edits of unknown documents
are ignored. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.frames import in_batches
from tidemark.llm.word_tokens import WordEncoder, encoder, vocabulary_path

_PIECE = re.compile(r"[^\x20\x09-\x0D]+")
LEAF = 64


def _encoded(text: str, coder: WordEncoder) -> tuple[list[int], list[int], list[int]]:
    """Begin, end and token count of each pre-token."""
    spans = [m.span() for m in _PIECE.finditer(text)]
    data = np.frombuffer(text.encode(), np.uint8)
    _, numbers = coder.words(data, np.array([0, len(data)]))
    return [a for a, _ in spans], [b for _, b in spans], coder.counts(numbers).tolist()


class Leaf:
    """A stretch of text; all that stand before another one end in white space or are empty."""

    __slots__ = ("text", "counts", "_spans")

    def __init__(self, text: str, counts: list[int], spans: tuple[list[int], list[int]] | None = None):
        self.text, self.counts, self._spans = text, counts, spans

    @property
    def spans(self) -> tuple[list[int], list[int]]:
        """Begins and ends of the pre-tokens, looked up when first asked for."""
        if self._spans is None:
            found = [m.span() for m in _PIECE.finditer(self.text)]
            self._spans = [a for a, _ in found], [b for _, b in found]
        return self._spans

    def sums(self) -> tuple[int, int, int]:
        return len(self.text), sum(self.counts), len(self.counts)

    def followed_by(self, other: "Leaf") -> "Leaf":
        n, (begins, ends), (more_begins, more_ends) = len(self.text), self.spans, other.spans
        spans = begins + [b + n for b in more_begins], ends + [b + n for b in more_ends]
        return Leaf(self.text + other.text, self.counts + other.counts, spans)

    def replaced(self, start: int, stop: int, new: str, coder: WordEncoder) -> tuple["Leaf", int]:
        """The leaf after text[start:stop] became ``new``, and how many pieces were encoded for it."""
        begins, ends = self.spans
        shift = len(new) - (stop - start)
        # Pieces that end before the edit, or begin behind it, and do not touch it stay.
        low = bisect_right(ends, start - 1)
        high = max(low, bisect_right(begins, stop))
        left = min(begins[low], start) if low < high else start
        right = max(ends[high - 1], stop) if low < high else stop
        text = self.text[:start] + new + self.text[stop:]
        own_begins, own_ends, counts = _encoded(text[left : right + shift], coder)
        begins = begins[:low] + [b + left for b in own_begins] + [b + shift for b in begins[high:]]
        ends = ends[:low] + [b + left for b in own_ends] + [b + shift for b in ends[high:]]
        return Leaf(text, self.counts[:low] + counts + self.counts[high:], (begins, ends)), len(counts)

    def split(self, pieces: int) -> list["Leaf"]:
        begins, ends = self.spans
        cuts = [0, *begins[pieces::pieces], len(self.text)]
        return [
            Leaf(self.text[a:b], self.counts[k : k + pieces], ([x - a for x in begins[k : k + pieces]], [x - a for x in ends[k : k + pieces]]))
            for a, b, k in zip(cuts, cuts[1:], range(0, len(begins), pieces))
        ]


class TokenTree:
    """Leaves of pre-tokens, and the characters, tokens and pieces of each subtree (root at 1)."""

    def __init__(self, text: str, coder: WordEncoder):
        data = np.frombuffer(text.encode(), np.uint8)
        words, numbers = coder.words(data, np.array([0, len(data)]))
        self._start(data, words.starts, coder.counts(numbers), coder)

    @classmethod
    def of_pieces(cls, data: np.ndarray, starts: np.ndarray, counts: np.ndarray, coder: WordEncoder) -> "TokenTree":
        """A tree of UTF-8 bytes whose pieces' places and counts are known already."""
        tree = cls.__new__(cls)
        tree._start(data, starts, counts, coder)
        return tree

    def _start(self, data: np.ndarray, starts: np.ndarray, counts: np.ndarray, coder: WordEncoder) -> None:
        self.coder, self.encoded = coder, 0
        cuts = [0, *starts[LEAF::LEAF].tolist(), len(data)]
        raw, counts = data.tobytes(), counts.tolist()
        self.leaves = [Leaf(raw[a:b].decode(), counts[k * LEAF : (k + 1) * LEAF]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        self._sum_leaves()

    def _sum_leaves(self) -> None:
        """All sums above the leaves."""
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        level = np.zeros((self.size, 3), np.int64)
        level[: len(self.leaves)] = [leaf.sums() for leaf in self.leaves]
        levels = [level]
        while len(level) > 1:
            level = level[0::2] + level[1::2]
            levels.append(level)
        sums = np.concatenate([np.zeros((1, 3), np.int64), *reversed(levels)])
        self.chars, self.tokens, self.pieces = (sums[:, k].tolist() for k in range(3))

    def _set_leaf(self, at: int, leaf: Leaf) -> None:
        """Put a leaf in and change the sums on its path to the root."""
        node = self.size + at
        chars, tokens, pieces = (new - old for new, old in zip(leaf.sums(), (self.chars[node], self.tokens[node], self.pieces[node])))
        self.leaves[at] = leaf
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            self.pieces[node] += pieces
            node //= 2

    def _descend(self, sums: list[int], at: int) -> tuple[int, int]:
        """The leaf that holds unit ``at`` of the sums, and the units before that leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at >= before + sums[node]:
                before += sums[node]
                node += 1
        return node - self.size, before

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(leaf.text for leaf in self.leaves)

    def tokens_before(self, at: int) -> int:
        """Tokens of the first ``at`` pre-tokens."""
        if at >= self.pieces[1]:
            return self.total
        leaf, before = self._descend(self.pieces, at)
        total, node = sum(self.leaves[leaf].counts[: at - before]), self.size + leaf
        while node > 1:
            if node & 1:
                total += self.tokens[node - 1]
            node //= 2
        return total

    def _leaf_of(self, at: int) -> tuple[int, int]:
        """The leaf of character ``at`` (at the end of the text: of the last character), and its first character."""
        return self._descend(self.chars, max(0, min(at, self.chars[1] - 1))) if self.chars[1] else (0, 0)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Replace text[start:stop]; encode again only the touched pre-tokens and their boundary."""
        start = min(max(0, start), self.chars[1])
        stop = min(max(start, stop), self.chars[1])
        first, base = self._leaf_of(start)
        last = first if stop == start else self._leaf_of(stop - 1)[0]
        leaf = self.leaves[first]
        if last > first:  # what lies between the two is gone as a whole
            tail = self.leaves[last]
            gone = self.chars[1] - len(tail.text) - base - len(leaf.text) - self._chars_behind(last)
            leaf, stop = leaf.followed_by(tail), stop - gone
        begin, end = start - base, stop - base
        while end == len(leaf.text) and last + 1 < len(self.leaves):  # its last white space may go: the next piece is a neighbour
            last += 1
            leaf = leaf.followed_by(self.leaves[last])
        leaf, encoded = leaf.replaced(begin, end, new, self.coder)
        self.encoded += encoded
        for k in range(first + 1, last + 1):
            self._set_leaf(k, Leaf("", [], ([], [])))
        if len(leaf.counts) > 2 * LEAF:
            self.leaves[first : first + 1] = leaf.split(LEAF)
            self._sum_leaves()
        else:
            self._set_leaf(first, leaf)

    def _chars_behind(self, at: int) -> int:
        """Characters of the leaves behind a leaf."""
        total, node = 0, self.size + at
        while node > 1:
            if not node & 1:
                total += self.chars[node + 1]
            node //= 2
        return total


# What masking looks for: mail addresses, IPv4 addresses, long digit runs, keys.
MAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}\.[A-Za-z0-9.-]{2,63}"
OTHERS = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|[0-9]{9,}|[0-9a-f]{32,}"
PRIVATE = f"{MAIL}|{OTHERS}"
_PRIVATE, _NO_MAIL = re.compile(PRIVATE), re.compile(OTHERS)
MASK = "[masked]"


def masking_edits(text: str, mask: str = MASK) -> list[tuple[int, int, str]]:
    """Edits (start, stop, new) that mask private data, each in the text that the ones before it left."""
    edits, shift = [], 0
    for hit in (_PRIVATE if "@" in text else _NO_MAIL).finditer(text):
        a, b = hit.span()
        edits.append((a + shift, b + shift, mask))
        shift += len(mask) - (b - a)
    return edits


def _followed(path: str, edits_of):
    """``edits_of`` gives the edits of a row, in order, from its array of edits and its bytes."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, out = encoder(path), []
        given = batch["edits"].to_pylist() if "edits" in batch.schema.names else None
        for part in K.slices(batch["text"]):
            words, numbers = coder.words(part.data, part.offsets)
            counts = coder.counts(numbers)
            for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                before = int(counts[a:b].sum())
                begin, end = part.offsets[i], part.offsets[i + 1]
                own = edits_of(given[part.lo + i] if given else None, part.data[begin:end])
                if not own:
                    out.append((int(b - a), before, 0, before, 0))
                    continue
                # The table may start anew inside an edit: known counts go in as numbers.
                tree = TokenTree.of_pieces(part.data[begin:end], words.starts[a:b] - begin, counts[a:b], coder)
                for start, stop, new in own:
                    tree.replace(start, stop, new)
                out.append((int(b - a), before, len(own), tree.total, tree.encoded))
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_pieces", "n_tokens", "n_edits", "n_tokens_edited", "n_encoded_again"])

    return work


_COUNTS = "doc_id long, n_pieces long, n_tokens long, n_edits long, n_tokens_edited long, n_encoded_again long"


def edited_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, n_tokens, n_edits, n_tokens_edited, n_encoded_again) for each row.

    ``docs`` has doc_id, text and edits: array<struct<seq, start, stop, new>> in characters, null for none.
    """

    def given(edits, _):
        ordered = sorted((e["seq"], e["start"], e["stop"], e["new"] or "") for e in edits or ())
        return [edit[1:] for edit in ordered]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits")
    return in_batches(rows, _followed(path or vocabulary_path(), given), _COUNTS, keeps_words=True)


def masked_counts(docs: DataFrame, mask: str = MASK, path: str | None = None) -> DataFrame:
    """The same columns, for edits that mask private data; they are found in one pass over each text."""

    def found(_, data):
        return masking_edits(data.tobytes().decode(), mask)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_batches(rows, _followed(path or vocabulary_path(), found), _COUNTS, keeps_words=True)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents with their rows of an edit table (doc_id, seq, start, stop, new)."""
    grouped = edits.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "start", "stop", "new")).alias("edits"))
    return docs.select("doc_id", "text").join(grouped, "doc_id", "left")
