"""Subword ids through a table of words that were met before.

The tokenizer's splits never cross white space, so a text's ids are those of its white-space pieces in
a row. A piece is encoded when it is first met by a Python worker; afterwards its ids come from a
table, found by a 64-bit hash for a whole slice of texts at once. The table starts anew beyond
``MOST_WORDS`` pieces, so its memory is bounded; results do not depend on what it holds.

With the normalizer and splits of ``KNOWN_STEPS`` much of the tokenizer's work can be left out. A split always
stands between a letter and ASCII punctuation, so marks behind a word are pieces by themselves. And of Latin
letters normalizer and splits change only the case, so such pieces go straight to the merges, many at a time: the
ids that end a piece are known by the vocabulary's suffix. Any other tokenizer, and any other piece, takes the whole way.
"""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np

from tidemark.llm import kernels as K

TOKENIZER = "word_bpe_49k.json"
MOST_WORDS = 1_000_000
MARKS = np.isin(np.arange(256), np.frombuffer(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""", np.uint8))
LETTERS = np.isin(np.arange(256) | 32, np.arange(97, 123))
LONGEST_MARKS = 8
KNOWN_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}


def _byte_letters() -> np.ndarray:
    """The letter that stands for each byte in a byte-level vocabulary; a space stays one."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    letters = np.arange(256)
    letters[others] = 256 + np.arange(len(others))
    letters[32] = 32
    return letters.astype("<u4")


def _plain_bytes() -> np.ndarray:
    """For each byte and the next (byte << 8 | next): a piece with it may still be a plain one.

    Plain pieces are letters below U+0250 whose lower case is one letter: all but U+0130.
    """
    good = np.zeros((256, 256), bool)
    good[:128] = LETTERS[:128, None]
    good[0x80:0xC0] = True  # not the first byte of a character, which decides
    for c in map(chr, range(0x80, 0x250)):
        good[tuple(c.encode())] = c.isalpha() and len(c.lower()) == 1
    return good.reshape(-1)


PLAIN = _plain_bytes()
TWO_BYTES = PLAIN & (np.arange(1 << 16) >= 0xC000)  # letters of two bytes


def vocabulary_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def marks_behind(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the ASCII punctuation behind a piece's last letter below U+0250 begins; its end where there is none to cut off.

    A piece with more than ``LONGEST_MARKS`` marks, or with "<" before them (special tokens), is left whole.
    """
    cut = ends.copy()
    for _ in range(LONGEST_MARKS):
        cut -= (cut > starts) & MARKS[data[cut - 1]]
    angles = np.flatnonzero(data == ord("<"))
    letter = LETTERS[data[cut - 1]] | ((cut > starts + 1) & TWO_BYTES[(data[cut - 2].astype(np.uint16) << 8) | data[cut - 1]])
    good = (cut > starts) & letter & (np.searchsorted(angles, starts) == np.searchsorted(angles, cut))
    return np.where(good, cut, ends)


def _row(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of lists, and all of them in a row."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return sizes, np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(sizes.sum()))


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        known = all(steps[k] == v for k, v in KNOWN_STEPS.items())
        known = known and all(t["content"].startswith("<|") and t["content"].endswith("|>") for t in steps["added_tokens"])
        suffix = steps["model"].get("end_of_word_suffix")
        self.merges = Tokenizer(self.tokenizer.model) if known and suffix else None
        if self.merges:
            self.merges.pre_tokenizer = WhitespaceSplit()
            self.last = np.zeros(1 << 16, bool)  # ids that end a piece
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.letters = _byte_letters()
        self._reset()

    def _reset(self):
        self.table = K.WordTable()
        self.ids = np.zeros(1 << 16, np.uint16)
        self.ends = np.zeros(1 << 16, np.int64)  # of word i; word i begins where word i - 1 ends
        self.used = 0

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each piece, and the ids of all in a row."""
        plain = self._plain(pieces) if self.merges else np.zeros(len(pieces), bool)
        short = self._merged([pieces[i] for i in np.flatnonzero(plain)]) if plain.any() else None
        if short is None:
            plain[:] = False
        full = self.tokenizer.encode_batch_fast([pieces[i].decode() for i in np.flatnonzero(~plain)], add_special_tokens=False)
        others = _row([e.ids for e in full])
        if short is None:
            return others
        sizes = np.empty(len(pieces), np.int64)
        sizes[plain], sizes[~plain] = short[0], others[0]
        flat, mine = np.empty(int(sizes.sum()), np.int64), np.repeat(plain, sizes)
        flat[mine], flat[~mine] = short[1], others[1]
        return sizes, flat

    def _plain(self, pieces: list[bytes]) -> np.ndarray:
        """Pieces of letters below U+0250: composed already, and one piece of the splits."""
        if not pieces:
            return np.zeros(0, bool)  # reduceat wants a row
        data = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        first = np.cumsum(sizes) - sizes
        bad = ~PLAIN[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        bad[first[1:] - 1] = False  # the spaces between pieces
        return ~np.logical_or.reduceat(bad, first)

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Like ``_encoded``, for plain pieces: many in one text, cut apart behind the ids that end a piece.

        None if not every piece has one such id.
        """
        lower = (b" ".join(pieces[i : i + 1000]).decode().lower().encode() for i in range(0, len(pieces), 1000))
        texts = [self.letters[np.frombuffer(x, np.uint8)].tobytes().decode("utf-32-le") for x in lower]
        flat = _row([e.ids for e in self.merges.encode_batch_fast(texts, add_special_tokens=False)])[1]
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(pieces) or ends[-1] != len(flat):
            return None
        return np.diff(ends, prepend=0), flat

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode distinct new pieces and put them into the table."""
        whole = data.tobytes()
        self._add(hashes, *self._encoded([whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]))

    def _add(self, hashes: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        before = self.table.size
        self.table.add(hashes)
        n = self.used + len(flat)
        while n > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.table.size > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.ids[self.used : n] = flat
        self.ends[before : self.table.size] = self.used + np.cumsum(sizes)
        self.used = n

    def _meet(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Put distinct new pieces into the table; those with marks behind a letter by way of their two parts."""
        cut = marks_behind(data, starts, ends) if self.merges else ends
        two = cut < ends
        sizes = (ends - starts)[two]
        first = np.cumsum(sizes) - sizes
        near = data[np.repeat(starts[two] - first, sizes) + np.arange(int(sizes.sum()))]
        cuts, last = first + (cut - starts)[two], first + sizes
        parts = K.span_hashes(K.prefix_sums(near), np.concatenate((first, cuts)), np.concatenate((cuts, last)))
        where = np.concatenate((starts[~two], starts[two], cut[two])), np.concatenate((ends[~two], cut[two], ends[two]))
        every, at = np.unique(np.concatenate((hashes[~two], parts)), return_index=True)
        new = self.table.find(every) < 0
        self._learn(every[new], data, where[0][at[new]], where[1][at[new]])
        left = np.flatnonzero(two)[self.table.find(hashes[two]) < 0]
        if len(left):
            numbers = self.table.find(parts).reshape(2, -1).T
            self._add(hashes[left], self.counts(numbers.reshape(-1)).reshape(-1, 2).sum(axis=1), self.spread(numbers.reshape(-1)))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[K.Words, np.ndarray]:
        """The white-space pieces of a slice and their numbers in the table."""
        words = K.word_spans(data, offsets, K.NOT_SPACE)
        return words, self.numbers(data, words, K.span_hashes(K.prefix_sums(data), words.starts, words.ends))

    def numbers(self, data: np.ndarray, words: K.Words, hashes: np.ndarray) -> np.ndarray:
        """The table's numbers of pieces whose hashes are known already."""
        if self.table.size > MOST_WORDS:
            self._reset()
        numbers = self.table.find(hashes)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            distinct, first = np.unique(hashes[new], return_index=True)
            at = new[first]
            self._meet(distinct, data, words.starts[at], words.ends[at])
            numbers[new] = self.table.find(hashes[new])
        return numbers

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        return self.ends[numbers] - np.where(numbers > 0, self.ends[numbers - 1], 0)

    def spread(self, numbers: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """The ids of all the pieces in a row; ``sizes`` are their counts, where these are known already."""
        sizes = self.counts(numbers) if sizes is None else sizes
        total = int(sizes.sum())
        begin = np.repeat(self.ends[numbers] - sizes - (np.cumsum(sizes) - sizes), sizes)
        return self.ids[begin + np.arange(total)]


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One table per Python worker and vocabulary."""
    return WordEncoder(path)
