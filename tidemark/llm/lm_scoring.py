"""Log-probability of texts under a small causal self-attention model on subword ids.

Model. log P(id | context) = log P(class | last ids) + log P(id | class, last id). The first factor is a
causal self-attention layer (one head, learned positions, residual, a row for every id) trained here in
numpy with its gradients written out; it sees up to 16 ids: all of a text's first 16, and from there on
the last 5 to 16, as the place in the window has it. The second comes from counts over all training documents: pairs of neighbours,
smoothed by the counts of single ids. Classes group ids by what stands before them (k-means over the
counts). Windows of 16 positions overlap by four; each position is scored once, in the window that gives
it most context, and all windows of a batch go through masked attention together.

The base score needs the count of every word in the training documents. Words that a bounded sample
shows to be common are counted in arrays; the postings of all others (word, document, times) are dealt
by word, so counts and the documents that need them meet in one shuffle and no table of words is sent
around.

Every pair counts. At most four million pairs (those with at least that part of all) are broadcast; what
the others add to a text comes by a shuffle join of their counts with the text's own pairs. The driver
gets tables that the vocabulary bounds: ids, pairs behind the 96 commonest ids, ids by class.

The attention learns from every training window. ``drawn_windows`` windows, drawn from those of all training
documents whatever their length, only give it a start on the driver (``steps`` batches); rows of ids that were
not drawn begin at the mean row. Then every training window is used ``PASSES`` times: documents are dealt into
``SLICES`` by hash; over a slice each task moves its own weights block by block, so the number of steps grows
with the documents, and the driver takes the mean of the tasks' moves, by positions, of an id's row by how often
each task met the id.

Bounds. ``COMMON`` common words, the four million pairs and the weights (one row per id) are broadcast; the
drawn windows are gathered. Counts and gradients cover all training documents.

Defined cases. Null text is empty: one token, the end. Rows with the same doc_id and text are scored
alike and each counts in training. A null doc_id belongs to no fold and is trained on. Without training
documents counts are zero and the weights stay as drawn. Extra columns are ignored.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.frames import id_lot, in_batches, in_streams, settled
from tidemark.llm.word_tokens import WordEncoder, encoder, vocabulary_path
from tidemark.storage import new_folder

FOLDS, HELD_OUT = 7, 2
END, VOCABULARY = 49407, 49408
WINDOW, OVERLAP, WIDTH, CLASSES = 16, 4, 8, 32
COMMON, SAMPLE_DOCS, DRAWN_WINDOWS, STEPS, PAIR_SHARE = 200_000, 8_000, 200_000, 1_200, 4_000_000
PASSES, SLICES, RATE = 1, 16, 0.01
BLOCK = 256  # windows worked on at once; more do not fit into a core's cache
CHUNK, LEADING, PAIR_WEIGHT = 8192, 96, 10.0


# -- tokens of all documents ----------------------------------------------------------------------


def _word_hashes(part: K.Slice):
    data = K.LOWER[part.data]
    words = K.word_spans(data, part.offsets, K.NOT_SPACE)
    return data, words, K.span_hashes(K.prefix_sums(data), words.starts, words.ends)


def _sample_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = np.concatenate([_word_hashes(part)[2] for part in K.slices(batch["text"])])
    words, n = np.unique(found, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(K.signed(words)), pa.array(n)], ["word", "n"])


def _squeezed(array: np.ndarray) -> bytes:
    """Plain bytes: Parquet and the shuffle compress many rows at once for much less than each row by itself."""
    return array.tobytes()


def _unsqueezed(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(blob, kind)


class _Places:
    """Places of words among the common ones, looked up once for each word of the encoder's table."""

    def __init__(self, common: np.ndarray):
        self.table = K.WordTable()
        self.table.add(common)
        self.known_to, self.places = None, np.zeros(0, np.int64)

    def find(self, coder: WordEncoder, numbers: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """-1 for words that are not common; the numbers are those of the encoder."""
        if self.known_to is not coder.table:  # it starts anew now and then
            self.known_to, self.places = coder.table, np.zeros(0, np.int64)
        self.places = np.concatenate((self.places, np.full(coder.table.size - len(self.places), -2)))
        place = self.places[numbers]
        new = np.flatnonzero(place == -2)
        place[new] = self.places[numbers[new]] = self.table.find(hashes[new])
        return place


def _tokens(path: str, common):
    def run(batches):
        coder, places = encoder(path), _Places(common.value)
        for batch in batches:
            yield _tokens_of(batch, coder, places)

    return run


def _tokens_of(batch: pa.RecordBatch, coder: WordEncoder, places: _Places) -> pa.RecordBatch:
    n_words, ids, often, rare_of, rare, times = [], [], [], [], [], []
    for part in K.slices(batch["text"]):
        data, words, hashes = _word_hashes(part)
        text = words.text_of()
        numbers = coder.numbers(data, words, hashes)
        sizes = coder.counts(numbers)
        flat = coder.spread(numbers, sizes)
        edges = np.concatenate(([0], np.cumsum(sizes)))[words.first]
        n_words.append(np.diff(words.first))
        ids += [_squeezed(flat[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        place = places.find(coder, numbers, hashes)
        known = place >= 0
        pairs, n = np.unique((text[known] << 32) | place[known], return_counts=True)
        cuts = np.searchsorted(pairs, np.arange(len(part) + 1) << 32)
        both = np.stack((pairs & 0xFFFFFFFF, n), axis=1).astype(np.uint32)
        often += [_squeezed(both[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        left = np.flatnonzero(~known)
        _, first, n = np.unique(K.mixed(hashes[left] ^ K.mixed(text[left].astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
        order = np.argsort(text[left][first], kind="stable")
        rare_of.append(np.bincount(text[left][first], minlength=len(part)))
        rare.append(hashes[left][first][order])
        times.append(n[order])
    ends = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(rare_of)))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (K.signed(np.concatenate(rare)), np.concatenate(times).astype(np.int32))]
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"], batch["held_out"], batch["key"], pa.array(np.concatenate(n_words) + 1), pa.array(ids, pa.binary()), pa.array(often, pa.binary()), *lists],
        ["doc_id", "held_out", "key", "n_tokens", "ids", "often", "rare", "times"],
    )


def _postings(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes = np.diff(batch["rare"].offsets.to_numpy())
    trained = np.repeat(~batch["held_out"].to_numpy(zero_copy_only=False), sizes)
    times = batch["times"].flatten().to_numpy().astype(np.int64)
    key = np.repeat(batch["key"].to_numpy(), sizes)
    return pa.RecordBatch.from_arrays([batch["rare"].flatten(), pa.array(key), pa.array(2 * times + trained)], ["word", "key", "times"])


def _rare_shares(batches):
    """Rows (word, key, times), sorted by word: what each document's rare words add to its base score.

    A row without a key counts the training tokens and distinct training words.
    """

    def shares(word, key, times):
        n, trained = times >> 1, times & 1
        new = np.concatenate(([True], word[1:] != word[:-1]))
        head = np.flatnonzero(new)
        c = np.add.reduceat(n * trained, head)
        mine = np.repeat(c, np.diff(np.append(head, len(word))))
        keys, back = np.unique(key, return_inverse=True)
        logs, known = np.bincount(back, n * np.log10(mine + 1.0)), np.bincount(back, n * (mine > 0)).astype(np.int64)
        zeros = np.zeros(len(keys), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([*keys.tolist(), None], pa.int64()), pa.array(np.append(known, 0)), pa.array(np.append(logs, 0.0)),
             pa.array(np.append(zeros, c.sum())), pa.array(np.append(zeros, (c > 0).sum()))],
            ["key", "known", "logs", "tokens", "words"],
        )

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        rows = [np.concatenate((a, batch[c].to_numpy())) for a, c in zip(held, ("word", "key", "times"))]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        held = [x[cut:] for x in rows]
        if cut:
            yield shares(*(x[:cut] for x in rows))
    if len(held[0]):
        yield shares(*held)


def _often(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, times, row) of the common words of all documents of the batch."""
    blobs = batch["often"].to_pylist()
    place, n = _unsqueezed(b"".join(blobs), np.uint32).reshape(-1, 2).T.astype(np.int64)
    return place, n, np.repeat(np.arange(len(blobs)), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8)


def _common_counts(size: int):
    def run(batches):
        total = np.zeros(-(-max(1, size) // CHUNK) * CHUNK, np.int64)
        for batch in batches:
            place, n, _ = _often(batch)
            total += np.bincount(place, n, len(total)).astype(np.int64)
        parts = total.reshape(-1, CHUNK)
        seen = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array([_squeezed(parts[i]) for i in seen], pa.binary())], ["chunk", "counts"])

    return run


def _added_up(kind=np.int64):
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + _unsqueezed(blob, kind)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    return run


def _sequences(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of documents in a row, each between two ends; and where each document begins."""
    mark = np.array([END], np.uint16).tobytes()
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 2 + 2
    return _unsqueezed(mark + (mark + mark).join(blobs) + mark, np.uint16).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))


def _pair_counts(batches):
    """Counts of neighbouring ids, added up over all documents of the task."""
    pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        blobs = batch["ids"].to_pylist()
        for i in range(0, len(blobs), 500):
            ids, first = _sequences(blobs[i : i + 500])
            ok = np.ones(len(ids) - 1, bool)
            ok[first[1:-1] - 1] = False
            new, m = np.unique(((ids[:-1] << 16) | ids[1:])[ok].astype(np.uint32), return_counts=True)
            pairs, back = np.unique(np.concatenate((pairs, new)), return_inverse=True)
            n = np.bincount(back, np.concatenate((n, m)), len(pairs)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])


def _class_totals(group: np.ndarray):
    """Counts of (id, class of the next id), from rows (pair, n)."""

    def run(batches):
        total = np.zeros((1 << 16) * CLASSES)
        for batch in batches:
            pair = batch["pair"].to_numpy()
            np.add.at(total, (pair >> 16) * CLASSES + group[pair & 0xFFFF], batch["n"].to_numpy().astype(float))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["place", "n"])

    return run


def _rare_pairs(scorer):
    """Rows (pair, key, times): the pairs of each document that the model does not hold."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        blobs, keys, out = batch["ids"].to_pylist(), batch["key"].to_numpy(), []
        for i in range(0, len(blobs), 500):
            ids, first = _sequences(blobs[i : i + 500])
            ok = np.ones(len(ids) - 1, bool)
            ok[first[1:-1] - 1] = False
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[:-1][ok]
            pairs = (ids[:-1][ok] << 16) | ids[1:][ok]
            left = scorer.value.place(pairs) < 0
            both, n = np.unique((doc[left] << 32) | pairs[left], return_counts=True)
            out.append((both & 0xFFFFFFFF, keys[i + (both >> 32)], n))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["pair", "key", "times"])

    return work


def _gains(scorer):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pair, n = batch["pair"].to_numpy(), batch["n"].to_numpy()
        return pa.RecordBatch.from_arrays([batch["pair"], pa.array(scorer.value.gain(pair & 0xFFFF, n))], ["pair", "gain"])

    return work


# -- the model ------------------------------------------------------------------------------------


def _leading(single: np.ndarray) -> np.ndarray:
    return np.argsort(-single, kind="stable")[:LEADING]


def _classes(single: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A class for each id: k-means over the roots of the shares of the ids before it."""
    before = _leading(single)
    column = np.full(VOCABULARY, -1)
    column[before] = np.arange(len(before))
    table = np.zeros((VOCABULARY, len(before)), np.float32)
    place = column[pairs >> 16]
    np.add.at(table, ((pairs & 0xFFFF)[place >= 0], place[place >= 0]), counts[place >= 0])
    table = np.sqrt(table / np.maximum(1, table.sum(axis=1, keepdims=True)))
    weight = np.sqrt(single)
    order = np.argsort(-single, kind="stable")
    middle = table[order[:CLASSES]].copy()
    for _ in range(8):
        own = np.empty(VOCABULARY, np.int64)
        for a in range(0, VOCABULARY, 8192):
            own[a : a + 8192] = (table[a : a + 8192] @ middle.T).argmax(axis=1)
        for k in range(CLASSES):
            mine = own == k
            total = (table[mine] * weight[mine, None]).sum(axis=0)
            if total.any():
                middle[k] = total / np.linalg.norm(total)
    return own


def _exponentials(a: np.ndarray) -> np.ndarray:
    """exp in place, for rows that are divided by their sums; beyond 60 either way nothing changes any more."""
    np.clip(a, -60, 60, out=a)
    return np.exp(a, out=a)


def _row_sums(a: np.ndarray) -> np.ndarray:
    """Sums of the last axis, kept as one; a product with ones is much the fastest way for short rows."""
    return (a.reshape(-1, a.shape[-1]) @ np.ones(a.shape[-1], a.dtype)).reshape(*a.shape[:-1], 1)


def _turned(a: np.ndarray) -> np.ndarray:
    """The last two axes exchanged, by a copy: products along the last axis of both sides are slower than it."""
    return np.ascontiguousarray(a.transpose(0, 2, 1))


class Attention:
    """One causal self-attention layer that predicts the class of the next id."""

    NAMES = ("embed", "place", "wq", "wk", "wv", "wo", "out", "bias")

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)

        def draw(*shape):
            return (rng.standard_normal(shape) * 0.3).astype(np.float32)

        self.embed, self.place = draw(VOCABULARY, WIDTH), draw(WINDOW, WIDTH)
        self.wq, self.wk, self.wv, self.wo = (draw(WIDTH, WIDTH) for _ in range(4))
        self.out, self.bias = draw(WIDTH, CLASSES), np.zeros(CLASSES, np.float32)
        self.seen = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def forward(self, ids: np.ndarray, keep: bool = False, start: int = 0):
        """Logits of the class behind each position from ``start`` on; ids: (windows, WINDOW)."""
        x = self.embed.take(ids, axis=0)
        x += self.place
        projected = (x.reshape(-1, WIDTH) @ np.hstack((self.wq * np.float32(WIDTH**-0.5), self.wk, self.wv))).reshape(*ids.shape, 3 * WIDTH)
        q, k, v = projected[:, start:, :WIDTH], projected[:, :, WIDTH : 2 * WIDTH], projected[:, :, 2 * WIDTH :]
        asked = x[:, start:]
        a = _exponentials(np.matmul(q, _turned(k)))
        a *= self.seen[start:]
        a /= _row_sums(a)
        mixed = np.matmul(a, v)
        h = np.ones((*asked.shape[:2], WIDTH + 1), x.dtype)  # the last column is for the bias
        np.add(asked, (mixed.reshape(-1, WIDTH) @ self.wo).reshape(asked.shape), out=h[:, :, :WIDTH])
        logits = (h.reshape(-1, WIDTH + 1) @ np.vstack((self.out, self.bias))).reshape(*asked.shape[:2], CLASSES)
        return (logits, (x, q, k, v, a, mixed, h)) if keep else logits

    def gradients(self, ids: np.ndarray, goal: np.ndarray, weight: np.ndarray, sparse: bool = False) -> tuple[float, dict]:
        """Mean loss over weighted positions and the gradient of each array.

        With ``sparse`` that of the ids is a pair: the ids that occur, ascending, and their rows.
        """
        logits, (x, q, k, v, a, mixed, h) = self.forward(ids, keep=True)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        p = _exponentials(logits)
        share = (weight / weight.sum()).astype(np.float32)
        scale = 1 / _row_sums(p)
        at = np.arange(goal.size) * CLASSES + goal.reshape(-1)
        hit = p.reshape(-1)[at].reshape(goal.shape) * scale[:, :, 0]
        loss = float(-(np.log(hit + 1e-12) * share).sum())
        d = p
        d *= scale * share[:, :, None]
        d.reshape(-1)[at] -= share.reshape(-1)
        both = flat(h).T @ flat(d)
        out = {"out": both[:-1], "bias": both[-1]}
        dh = (flat(d) @ self.out.T).reshape(x.shape)
        out["wo"] = flat(mixed).T @ flat(dh)
        dmixed = (flat(dh) @ self.wo.T).reshape(x.shape)
        turned = np.empty((*x.shape[:2], 3 * WIDTH), x.dtype)  # gradients of q, k and v side by side
        np.matmul(a.transpose(0, 2, 1), dmixed, out=turned[:, :, 2 * WIDTH :])
        ds = np.matmul(dmixed, _turned(v))
        ds -= _row_sums(dmixed * mixed)  # the same as the sums of the gradient of a times a
        ds *= a
        # q holds the scale of the products already.
        np.matmul(ds, k * np.float32(WIDTH**-0.5), out=turned[:, :, :WIDTH])
        np.matmul(ds.transpose(0, 2, 1), q, out=turned[:, :, WIDTH : 2 * WIDTH])
        out["wq"], out["wk"], out["wv"] = np.split(flat(x).T @ flat(turned), 3, axis=1)
        dx = dh
        dx += (flat(turned) @ np.hstack((self.wq, self.wk, self.wv)).T).reshape(x.shape)
        out["place"] = dx.sum(axis=0)
        order = np.argsort(ids.astype(np.uint16), axis=None, kind="stable")
        own = ids.reshape(-1).take(order)
        heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        rows = own.take(heads), np.add.reduceat(flat(dx).take(order, axis=0), heads, axis=0)
        if sparse:
            out["embed"] = rows
        else:
            out["embed"] = np.zeros_like(self.embed)
            out["embed"][rows[0]] = rows[1]
        return loss, out

    def train(self, ids: np.ndarray, goal: np.ndarray, weight: np.ndarray, steps: int = STEPS, batch: int = 256, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam over random batches of windows; the losses on the way."""
        rng = np.random.default_rng(seed)
        adam, losses = Adam(self), []
        for step in range(steps):
            pick = rng.integers(0, len(ids), batch)
            loss, grads = self.gradients(ids[pick], goal[pick], weight[pick])
            losses.append(loss)
            adam.move(grads, rate * min(1.0, 2 * (1 - step / steps)))
        seen = np.bincount(ids[weight > 0], minlength=VOCABULARY)
        self.embed[seen == 0] = seen @ self.embed / seen.sum()
        return losses

    def copied(self) -> Attention:
        """The same weights in arrays that may be moved in place."""
        own = copy.copy(self)
        for n in self.NAMES:
            setattr(own, n, getattr(self, n).copy())
        return own

    def move(self, grads: dict, squares: dict, rate: float) -> None:
        """One step in place by sparse gradients; ``squares`` holds the sums of their squares so far (Adagrad)."""
        for n, g in grads.items():
            at, g = g if n == "embed" else (..., g)
            so_far = squares[n][at] + g * g
            squares[n][at] = so_far
            getattr(self, n)[at] -= np.float32(rate) * g / (np.sqrt(so_far) + np.float32(1e-8))

    def flat(self, arrays: dict) -> np.ndarray:
        return np.concatenate([np.asarray(arrays[n], float).reshape(-1) for n in self.NAMES])

    def unflat(self, values: np.ndarray) -> dict:
        out, at = {}, 0
        for n in self.NAMES:
            like = getattr(self, n)
            out[n], at = values[at : at + like.size].reshape(like.shape), at + like.size
        return out


class Adam:
    def __init__(self, net: Attention):
        self.net, self.step = net, 0
        self.one, self.two = ({n: np.zeros_like(getattr(net, n)) for n in net.NAMES} for _ in range(2))

    def move(self, grads: dict, pace: float) -> None:
        self.step += 1
        for n, g in grads.items():
            self.one[n] = 0.9 * self.one[n] + 0.1 * g
            self.two[n] = 0.99 * self.two[n] + 0.01 * g * g
            change = pace * (self.one[n] / (1 - 0.9**self.step)) / (np.sqrt(self.two[n] / (1 - 0.99**self.step)) + 1e-8)
            setattr(self.net, n, (getattr(self.net, n) - change).astype(np.float32))


def windows_of(first: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, document, scored): overlapping windows over sequences; each position is scored once.

    The positions of a sequence are all but its last id; ``scored`` is a mask of shape (windows, WINDOW).
    """
    positions = np.diff(first) - 1
    stride = WINDOW - overlap
    n = 1 + np.maximum(0, -(-(positions - WINDOW) // stride))
    doc = np.repeat(np.arange(len(n)), n)
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin = first[:-1][doc] + turn * stride
    at = turn[:, None] * stride + np.arange(WINDOW)
    scored = (at < positions[doc][:, None]) & ((turn[:, None] == 0) | (np.arange(WINDOW) >= overlap))
    return begin, doc, scored


def training_windows(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, positions, document) of windows that share no position: WINDOW + 1 ids, of which so many positions count."""
    ids, first = _sequences(blobs)
    begin, doc, scored = windows_of(first, 0)
    at = np.minimum(begin[:, None] + np.arange(WINDOW + 1), len(ids) - 1)
    return ids[at], scored.sum(axis=1), doc


def _drawn(share: float):
    """Each training window with this chance, by the hash of its document and number."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        blobs, keys, out, sizes = batch["ids"].to_pylist(), batch["key"].to_numpy().view(np.uint64), [], []
        for i in range(0, len(blobs), 500):
            ids, n, doc = training_windows(blobs[i : i + 500])
            turn = np.arange(len(doc)) - np.searchsorted(doc, doc)
            lot = K.mixed(keys[i + doc] ^ K.mixed(turn.astype(np.uint64) + np.uint64(1)))
            pick = np.flatnonzero((lot >> np.uint64(11)).astype(float) < share * 2**53)
            out += [x.tobytes() for x in ids[pick].astype(np.uint16)]
            sizes.append(n[pick])
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(np.concatenate(sizes))], ["window", "positions"])

    return work


def _gradient_sums(sent, group, rate: float = 0.0):
    """Gradients of all windows of the task, added up, in chunks; behind them positions, loss, occurrences of ids.

    With a ``rate`` the weights move after each block, and instead of gradients come the task's moves: those of
    an id's row times its occurrences, all others times the positions.
    """

    def run(batches):
        net, own, total, loss_sum, positions = sent.value.copied() if rate else sent.value, group.value, None, 0.0, 0
        squares, seen = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}, np.zeros(VOCABULARY)
        for batch in batches:
            blobs = batch["ids"].to_pylist()
            for i in range(0, len(blobs), 200):
                ids, n, _ = training_windows(blobs[i : i + 200])
                mask = np.arange(WINDOW) < n[:, None]
                seen += np.bincount(ids[:, :-1][mask], minlength=VOCABULARY)
                for a in range(0, len(ids), BLOCK):
                    here, m = ids[a : a + BLOCK], mask[a : a + BLOCK]
                    loss, grads = net.gradients(here[:, :-1], own[here[:, 1:]], m, sparse=True)
                    n = int(m.sum())
                    total = total or {k: np.zeros(getattr(net, k).shape) for k in net.NAMES}
                    if rate:
                        net.move(grads, squares, rate)
                    else:
                        at, rows = grads.pop("embed")
                        total["embed"][at] += rows * n
                        for k, g in grads.items():
                            total[k] += g * n
                    loss_sum, positions = loss_sum + loss * n, positions + n
        if total:
            if rate:
                total = {k: (getattr(net, k).astype(float) - getattr(sent.value, k)) * (seen[:, None] if k == "embed" else positions) for k in net.NAMES}
            whole = np.concatenate((net.flat(total), (positions, loss_sum), seen))
            parts = np.append(whole, np.zeros(-len(whole) % CHUNK)).reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([_squeezed(x) for x in parts], pa.binary())], ["chunk", "counts"])

    return run


def learn_from_all(net: Attention, group: np.ndarray, trained: DataFrame) -> list[float]:
    """The mean moves of tasks over each slice of ``trained`` (key, ids); mean losses on the way."""
    context, losses = trained.sparkSession.sparkContext, []
    groups, schema = context.broadcast(group), "chunk long, counts binary"
    # Each task sends moves of all ids: four splits share one.
    tasks = max(context.defaultParallelism, trained.rdd.getNumPartitions() // 4)
    folder = new_folder(trained.sparkSession, "slices")
    trained.select("ids", F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(SLICES)).alias("slice")).write.partitionBy("slice").parquet(folder)
    slices = trained.sparkSession.read.schema("ids binary, slice long").parquet(folder)
    for step in range(PASSES * SLICES):
        part = slices.where(F.col("slice") == step % SLICES).select("ids").coalesce(tasks)
        sent, rate = context.broadcast(net), RATE * (1 - step / (PASSES * SLICES))
        found = part.mapInArrow(_gradient_sums(sent, groups, rate), schema).repartition("chunk").mapInArrow(_added_up(float), schema).collect()
        sent.destroy()
        if found:
            values = np.concatenate([np.frombuffer(bytes(r["counts"]), float) for r in sorted(found, key=lambda r: r.chunk)])
            end = sum(getattr(net, n).size for n in net.NAMES)
            positions, loss = values[end : end + 2]
            seen = values[end + 2 : end + 2 + VOCABULARY]
            losses.append(loss / positions)
            for n, moves in net.unflat(values[:end]).items():
                weight = np.maximum(seen, 1)[:, None] if n == "embed" else positions
                setattr(net, n, (getattr(net, n) + moves / weight).astype(np.float32))
    return losses


class Scorer:
    def __init__(self, single: np.ndarray, pairs: np.ndarray, counts: np.ndarray, group: np.ndarray | None = None, totals: np.ndarray | None = None):
        """From counts of all training documents: of single ids, and of the pairs (before << 16 | id).

        With ``group`` (classes) and ``totals`` (ids by class of the next id), both from all pairs, the pairs
        given may be a part; what the others add to a score is their ``gain``.
        """
        self.group = _classes(single, pairs, counts) if group is None else group
        smooth = single + 0.5
        self.alone = np.log(smooth / np.bincount(self.group, smooth, CLASSES)[self.group])
        self.pairs, self.counts = pairs.astype(np.uint64), counts.astype(np.float64)
        if totals is None:
            totals = np.bincount((pairs >> 16) * CLASSES + self.group[pairs & 0xFFFF], counts, (1 << 16) * CLASSES)
        self.totals = totals.astype(np.float32)
        self.attention = Attention()
        self._table = None

    def __getstate__(self):
        return {**self.__dict__, "_table": None}

    def place(self, pairs: np.ndarray) -> np.ndarray:
        """Where each pair stands among those held, -1 for others."""
        if self._table is None:
            self._table = K.WordTable(20)
            self._table.add(K.mixed(self.pairs))
        return self._table.find(K.mixed(pairs.astype(np.uint64)))

    def gain(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What a pair that is not held, with its id and count, adds to log10 P wherever it stands."""
        return np.log1p(counts / (PAIR_WEIGHT * np.exp(self.alone[ids]))) / np.log(10)

    def inside(self, before: np.ndarray, ids: np.ndarray, weight: float = PAIR_WEIGHT) -> np.ndarray:
        """log P(id | its class, the id before); a pair that is not held counts as never seen."""
        place = self.place((before << 16) | ids)
        seen = np.where(place >= 0, self.counts[place] if len(self.counts) else 0.0, 0.0)
        total = self.totals[before * CLASSES + self.group[ids]]
        return np.log((seen + weight * np.exp(self.alone)[ids]) / (total + weight))

    def inputs(self, blobs: list[bytes]):
        ids, first = _sequences(blobs)
        begin, doc, scored = windows_of(first)
        at = np.minimum(begin[:, None] + np.arange(WINDOW), len(ids) - 2)
        return ids, first, doc, at, scored

    def score(self, blobs: list[bytes], block: int = BLOCK) -> np.ndarray:
        """log10 P of each document's ids and end."""
        ids, first, doc, at, scored = self.inputs(blobs)
        out, goals = np.zeros(len(blobs)), self.group[ids[1:]]
        # In all windows but a text's first, the positions of the overlap are context only.
        for start, some in ((0, np.flatnonzero(scored[:, 0])), (OVERLAP, np.flatnonzero(~scored[:, 0]))):
            for a in range(0, len(some), block):
                pick = some[a : a + block]
                here, mask = at[pick], scored[pick, start:]
                goal = goals[here[:, start:]]
                p = _exponentials(self.attention.forward(ids[here], start=start))
                hit = p.reshape(-1)[np.arange(goal.size) * CLASSES + goal.reshape(-1)].reshape(goal.shape) / _row_sums(p)[:, :, 0]
                out += np.bincount(doc[pick], (np.log(hit) * mask).sum(axis=1), len(blobs))
        ok = np.ones(len(ids) - 1, bool)
        ok[first[1:-1] - 1] = False
        of = np.repeat(np.arange(len(blobs)), np.diff(first) - 1)
        before, ids = ids[:-1][ok], ids[1:][ok]
        out += np.bincount(of, self.inside(before, ids), len(blobs))
        return out / np.log(10)


def _scored(scorer, common_logs, common_known):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, logs, known = scorer.value, common_logs.value, common_known.value
        blobs, scores = batch["ids"].to_pylist(), []
        sizes = np.cumsum([len(b) for b in blobs])
        cuts = [0, *(np.flatnonzero(np.diff(sizes // 400_000)) + 1).tolist(), len(blobs)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                scores.append(model.score(blobs[a:b]))
        place, n, of = _often(batch)
        base = np.bincount(of, logs[place] * n, len(blobs)).astype(float)  # of nothing, whole numbers come back
        seen = np.bincount(of, n * known[place], len(blobs)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["held_out"], batch["key"], batch["n_tokens"], pa.array(seen), pa.array(base), pa.array(np.concatenate(scores))],
            ["doc_id", "held_out", "key", "n_tokens", "seen", "logs_common", "score"],
        )

    return work


def _table_of(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both columns of a frame of (number, count) whose size is bounded."""
    number, n = df.toArrow().columns
    return number.to_numpy().astype(np.int64), n.to_numpy().astype(float)


def scored_texts(docs: DataFrame, path: str | None = None, drawn_windows: int = DRAWN_WINDOWS, steps: int = STEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``."""
    spark = docs.sparkSession
    held = F.coalesce(id_lot("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    text = F.coalesce("text", F.lit("")).alias("text")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).alias("key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, key, text)
    n_docs = rows.count()
    spread = F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(1_000_000))
    drawn = in_batches(rows.where(spread < round(min(1.0, SAMPLE_DOCS / max(1, n_docs)) * 1_000_000)).select("text"), _sample_words, "word long, n long")
    top = drawn.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(COMMON).select("word").toPandas()
    common = top["word"].to_numpy(np.int64).view(np.uint64)
    schema = "doc_id long, held_out boolean, key long, n_tokens long, ids binary, often binary, rare array<long>, times array<int>"
    tokens = settled(in_streams(rows, _tokens(path or vocabulary_path(), spark.sparkContext.broadcast(common)), schema, keeps_words=True))
    trained = tokens.where("not held_out")

    # Base score: common words in arrays, all others by their postings.
    chunks = trained.select("often").mapInArrow(_common_counts(len(common)), "chunk long, counts binary").repartition("chunk").mapInArrow(_added_up(), "chunk long, counts binary")
    counts = np.zeros(-(-max(1, len(common)) // CHUNK) * CHUNK, np.int64)
    for r in chunks.collect():
        counts[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(bytes(r["counts"]), np.int64)
    postings = in_batches(tokens.select("rare", "times", "key", "held_out"), _postings, "word long, key long, times long")
    shares = settled(
        postings.repartition("word").sortWithinPartitions("word").mapInArrow(_rare_shares, "key long, known long, logs double, tokens long, words long")
        .groupBy("key").agg(*(F.sum(c).alias(c) for c in ("known", "logs", "tokens", "words")))
    )
    rest = shares.where("key is null").select("tokens", "words").first() or (0, 0)
    n_train = trained.count()
    train_tokens = int(counts.sum()) + int(rest[0]) + n_train
    distinct = int((counts > 0).sum()) + int(rest[1]) + (n_train > 0)

    # The model: counts and weights from all training documents.
    pair_rows = trained.select("ids").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = settled(pair_rows)
    total, n_pairs = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    single = np.zeros(VOCABULARY)
    for r in pairs.groupBy((F.col("pair") % 65536).alias("id")).agg(F.sum("n").alias("n")).collect():
        single[r["id"]] = r.n
    leading = pairs.where(F.shiftright("pair", 16).isin(_leading(single).tolist()))
    group = _classes(single, *_table_of(leading.orderBy("pair")))
    totals = np.zeros((1 << 16) * CLASSES)
    place, n = _table_of(pairs.mapInArrow(_class_totals(group), "place long, n double").groupBy("place").agg(F.sum("n").alias("n")))
    totals[place] = n
    held_pairs, held_counts = _table_of(pairs.where(F.col("n") * PAIR_SHARE >= total).orderBy("pair"))
    model = Scorer(single, held_pairs, held_counts, group, totals)
    if total:
        share = min(1.0, drawn_windows / (total / WINDOW + n_train))
        drawn = in_batches(trained.select("key", "ids"), _drawn(share), "window binary, positions long").orderBy("window", "positions").toArrow()
        ids = np.frombuffer(b"".join(drawn["window"].to_pylist()), np.uint16).astype(np.int32).reshape(-1, WINDOW + 1)
        mask = np.arange(WINDOW) < drawn["positions"].to_numpy().astype(np.int64)[:, None]
        del drawn
        if len(ids):
            model.attention.train(ids[:, :-1], model.group[ids[:, 1:]], mask & True, steps)
        learn_from_all(model.attention, model.group, trained.select("key", "ids"))
    logs, known = np.log10(counts + 1.0), counts > 0
    sent = [spark.sparkContext.broadcast(x) for x in (model, logs, known)]
    schema = "doc_id long, held_out boolean, key long, n_tokens long, seen long, logs_common double, score double"
    scored = in_batches(tokens.select("doc_id", "held_out", "key", "n_tokens", "ids", "often"), _scored(*sent), schema)
    times = tokens.groupBy("key").agg(F.count("*").alias("rows"))
    parts = shares.where("key is not null").select("key", "known", "logs", F.lit(0.0).alias("gain"))
    if n_pairs > len(held_pairs):
        gains = in_batches(pairs.where(F.col("n") * PAIR_SHARE < total), _gains(sent[0]), "pair long, gain double")
        rare = in_batches(tokens.select("key", "ids"), _rare_pairs(sent[0]), "pair long, key long, times long")
        rare = rare.join(gains, "pair").groupBy("key").agg(F.sum(F.col("times") * F.col("gain")).alias("gain"))
        parts = parts.unionByName(rare.select("key", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("logs"), "gain"))
        parts = parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("known", "logs", "gain")))
    per_row = [(F.col("known") / F.col("rows")).cast("long").alias("known"), *((F.col(c) / F.col("rows")).alias(c) for c in ("logs", "gain"))]
    mine = parts.join(times, "key").select("key", *per_row)
    end = float(np.log10(n_train + 1.0))
    base = F.col("logs_common") + F.coalesce("logs", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(float(np.log10(train_tokens + distinct + 1)))
    known_words = F.col("seen") + F.coalesce("known", F.lit(0)) + F.lit(int(n_train > 0))
    return scored.join(mine, "key", "left").select(
        "doc_id", "held_out", "n_tokens", known_words.alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
