"""Hard negatives of anchors by Kronecker-packed products, in blocks of rows.

Method. Components become integers, floor(scale * x). Of a block of candidates, the components of several
are biased to be non-negative and laid side by side in one wide integer, a field for each candidate, wide
enough that no sum over the dimensions can reach the next field. One multiplication by an anchor's (biased)
component serves all fields; after the sum over the dimensions the fields are cut apart and the biases taken
off, which gives the exact inner products. Wide integers stay below 2**53, where doubles hold every
integer, so the products are one matrix product. Components too large for that are multiplied as Python
integers, one candidate a field.

Anchors are a stated query set: each block of anchors meets each block of rows. Two passes: the first finds
an anchor's best rows of its own label (positives), the second, for each positive, the best rows of other
labels whose score lies between ``low`` and ``high`` percent of the positive's. A task holds the best few so
far; of the next block only scores that reach the last of them are looked at. Where these are many, all scores
are sorted: within a block the place in (vec_id) order is the lower part of one sort key, so ties fall to the
smaller id.

Scale. Rows are packed into blocks where they are read, of fewer rows where vectors are long. Blocks of rows
are dealt to lanes, blocks of anchors to groups, and a task is the product of a lane and a group, which reads
the two: no copies of blocks, no broadcast whatever the sizes are thought to be, and nothing reaches the
driver but counts. A task hands on, per anchor, only the best few; ranks are windows over those few rows of a
(anchor, positive), as many as lanes.

Defined cases. A null label, id or vector, or a null or non-finite component: the row takes no part. An
anchor meets rows of its own number of components only. A copy of an anchor's row (same id) is another row,
so it may be a positive; repeated anchors give repeated results. Ties among rows of equal score and id are
equal results. Scores beyond 64 bits count as the nearest 64-bit number. Empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import copy
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.frames import in_streams, settled

ROWS, ANCHORS = 4096, 1024
CELLS = 2**20  # components in a block at most
TILE = 2**17  # scores looked at together
LANES, HELD = 16, 8  # lanes of rows, unless a large cluster has few anchors; blocks of anchors in a group at most
DENSE = 16  # one score in so many is near the best: sort them all
FIRST = 256  # rows that anchors meet first, to know what is near
LABELS = 32  # up to so many labels of anchors meet their rows one after another
_BLOCK = "block long, n int, dims int, kind string, ids binary, labels binary, cells binary"
_LONG = (-(2**63), 2**63 - 1)
_exact = np.frompyfunc(int, 1, 1)


def score_tiles(anchors: np.ndarray, rows: np.ndarray, room: int = 53) -> Iterator[tuple[int, np.ndarray]]:
    """All inner products (anchor, row) of integer-valued matrices, as int64, some anchors at a time: the first of them, scores.

    The next scores may take the place of these.
    """
    dims = anchors.shape[1]
    if not dims or not len(anchors) or not len(rows):
        yield 0, np.zeros((len(anchors), len(rows)), np.int64)
        return
    low_a, low_r = float(anchors.min()), float(rows.min())
    high = dims * (int(anchors.max()) - int(low_a)) * (int(rows.max()) - int(low_r))
    width = max(1, high.bit_length())
    if width > room or max(abs(low_a), abs(low_r), float(anchors.max()), float(rows.max())) >= 2**24:
        whole = _exact(anchors) @ _exact(rows).T
        yield 0, np.clip(whole, *_LONG).astype(np.int64)
        return
    fields = room // width
    side = -(-len(rows) // fields)  # row f * side + k is field f of the wide integer k
    a = anchors - low_a
    r = np.zeros((fields, side, dims))
    r.reshape(-1, dims)[: len(rows)] = rows - low_r
    wide = np.einsum("fkd,f->dk", r, 2.0 ** (width * np.arange(fields)))
    of_rows = r.reshape(-1, dims)[: len(rows)].sum(1).astype(np.int64) * int(low_a) + dims * int(low_a) * int(low_r)
    of_anchors = a.sum(1).astype(np.int64) * int(low_r)
    step = min(len(a), max(1, TILE // len(rows)))
    products, whole, cut = np.empty((step, side)), np.empty((step, side), np.int64), np.empty((step, fields * side), np.int64)
    for at in range(0, len(a), step):
        n = min(step, len(a) - at)
        np.matmul(a[at : at + n], wide, out=products[:n])
        np.copyto(whole[:n], products[:n], casting="unsafe")  # sums below 2**53: exact
        for f in range(fields):
            part = cut[:n, f * side : (f + 1) * side]
            np.right_shift(whole[:n], width * f, out=part)
            part &= (1 << width) - 1
        scores = cut[:n, : len(rows)]
        scores += of_rows
        scores += of_anchors[at : at + n, None]
        yield at, scores


def packed_scores(anchors: np.ndarray, rows: np.ndarray, room: int = 53) -> np.ndarray:
    """All inner products (anchor, row) of integer-valued matrices, as int64."""
    return np.concatenate([scores.copy() for _, scores in score_tiles(anchors, rows, room)])


def _packed(size: int, scale: float) -> Callable:
    """Valid rows (id, label, vector) as blocks of at most ``size`` rows and CELLS components, of one length, ids ascending."""

    def block(at: int, held: list) -> pa.RecordBatch:
        ids, labels, cells = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(ids, kind="stable")
        largest = np.abs(cells).max(initial=0)
        kind = next((k for k, top in (("i2", 2**15), ("i4", 2**31)) if largest < top), "f8")
        values = [[at], [len(ids)], [cells.shape[1]], [kind], [ids[order].tobytes()], [labels[order].tobytes()], [cells[order].astype(kind).tobytes()]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["block", "n", "dims", "kind", "ids", "labels", "cells"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        held: dict[int, list] = {}
        for batch in batches:
            vectors = batch["vector"]
            ends = vectors.offsets.to_numpy()
            flat = np.floor(vectors.values.to_numpy(zero_copy_only=False).astype(float) * scale)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            lengths = np.diff(ends)
            fine = bad[ends[1:]] == bad[ends[:-1]]
            ids, labels = batch["id"].to_numpy(), batch["label"].to_numpy()
            for dims in np.unique(lengths).tolist():
                chosen = np.flatnonzero((lengths == dims) & fine)
                cells = flat[(ends[chosen][:, None] + np.arange(dims)).astype(np.int64)]
                most = max(1, min(size, CELLS // max(1, dims)))
                for i in range(0, len(chosen), most):
                    part = chosen[i : i + most]
                    mine = held.setdefault(dims, [])
                    if mine and sum(len(x[0]) for x in mine) + len(part) > most:
                        yield block(next(numbers), held.pop(dims))
                        mine = held.setdefault(dims, [])
                    mine.append((ids[part], labels[part], cells[i : i + most]))
        for mine in held.values():
            yield block(next(numbers), mine)

    return work


class Block:
    """A block as arrays; ``known``: the positives of its anchors, if any, as (place, nth, id, score)."""

    def __init__(self, batch: pa.RecordBatch, i: int, prefix: str = ""):
        n, dims, kind = (batch[prefix + c][i].as_py() for c in ("n", "dims", "kind"))
        ids, labels, cells = (batch[prefix + c][i].as_buffer() for c in ("ids", "labels", "cells"))
        self.ids, self.labels = np.frombuffer(ids, np.int64).copy(), np.frombuffer(labels, np.int64).copy()
        self.cells = np.frombuffer(cells, kind).reshape(n, dims).astype(float)
        if not prefix and "positives" in batch.schema.names:
            self.known = [x.to_numpy().astype(np.int64) for x in batch["positives"][i].values.flatten()]

    def of(self, some: np.ndarray | slice) -> Block:
        part = copy.copy(self)
        part.ids, part.labels, part.cells = self.ids[some], self.labels[some], self.cells[some]
        return part


def _meetings(batches: Iterator[pa.RecordBatch], asked: dict[int, Block]) -> Iterator[tuple[int, Block, Block]]:
    """For each meeting of two blocks: the number of the anchors' block, this (kept in ``asked``) and the rows'."""
    at, rows = None, None
    for batch in batches:
        for i, (block, r_block) in enumerate(zip(batch["block"].to_pylist(), batch["r_block"].to_pylist())):
            if block not in asked:
                asked[block] = Block(batch, i)
            if r_block != at:
                at, rows = r_block, Block(batch, i, "r_")
            yield block, asked[block], rows


class Best:
    """The best ``count`` entries of numbered lists: highest score first, then the smaller id.

    ``floors``: for each list the score that a new entry has to reach.
    """

    def __init__(self, floors: np.ndarray, count: int):
        self.floors, self.count = floors, count
        self.lists, self.scores, self.ids = np.zeros((3, 0), np.int64)

    def add(self, entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Entries (list, score, id)."""
        if not any(len(x[0]) for x in entries):
            return
        lists, scores, ids = (np.concatenate(x) for x in zip((self.lists, self.scores, self.ids), *entries))
        order = np.lexsort((ids, ~scores, lists))
        lists = lists[order]
        firsts = np.flatnonzero(np.diff(lists, prepend=-1))
        nth = np.arange(len(lists)) - np.repeat(firsts, np.diff(firsts, append=len(lists)))
        kept = nth < self.count
        self.lists, self.scores, self.ids = lists[kept], scores[order[kept]], ids[order[kept]]
        last = nth[kept] == self.count - 1
        self.floors[self.lists[last]] = self.scores[last]


class Ranked:
    """Scores of a meeting as sort keys: score first, then the smaller id (rows stand in order of their ids)."""

    def __init__(self, scores: np.ndarray, wanted: np.ndarray):
        self.n, self.values = scores.shape[1], None
        if scores.size and max(abs(int(scores.min())), abs(int(scores.max()))) >= 2**62 // self.n:
            self.values, scores = np.unique(scores, return_inverse=True)
            scores = scores.reshape(wanted.shape)
        self.keys = np.where(wanted, scores * self.n + np.arange(self.n - 1, -1, -1), _LONG[0])

    def told(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places and scores of keys."""
        scores = keys // self.n
        return self.n - 1 - keys % self.n, scores if self.values is None else self.values[scores]

    def bounds(self, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys at and beyond which scores from least to most lie."""
        if self.values is not None:
            least, most = np.searchsorted(self.values, least, "left"), np.searchsorted(self.values, most, "right") - 1
        top = 2**62 // self.n
        return np.clip(least, -top, top) * self.n, (np.clip(most, -top, top) + 1) * self.n


def _squares(cells: np.ndarray) -> np.ndarray:
    """Each row's product with itself."""
    if np.abs(cells).max(initial=0) < 2**20 and cells.shape[1] < 2**12:
        return (cells * cells).sum(1).astype(np.int64)
    return np.array([min(sum(int(v) ** 2 for v in row), _LONG[1]) for row in cells], np.int64)


def _in_turn(rows: Block, fresh: bool) -> list[Block]:
    return [rows.of(slice(0, FIRST)), rows.of(slice(FIRST, None))] if fresh else [rows]


def _best_same(count: int) -> Callable:
    def near(asks: Block, rows: Block, floors: np.ndarray) -> Iterator[tuple]:
        labels = np.unique(asks.labels)
        lots = [np.flatnonzero(asks.labels == label) for label in labels] if len(labels) <= LABELS else [np.arange(len(asks.labels))]
        for lot in lots:
            those = rows.of(rows.labels == asks.labels[lot[0]]) if len(lots) == len(labels) else rows
            for at, scores in score_tiles(asks.cells[lot], those.cells):
                mine = lot[at : at + len(scores)]
                fits = scores >= floors[mine, None]
                if np.count_nonzero(fits) * DENSE > fits.size:
                    ranked = Ranked(scores, asks.labels[mine, None] == those.labels)
                    best = np.sort(ranked.keys, axis=1)[:, max(0, ranked.n - count) :]
                    row, col = np.nonzero(best > _LONG[0])
                    place, score = ranked.told(best[row, col])
                    yield mine[row], score, those.ids[place]
                else:
                    row, col = np.divmod(np.flatnonzero(fits), max(1, fits.shape[1]))
                    same = asks.labels[mine[row]] == those.labels[col]
                    row, col = row[same], col[same]
                    yield mine[row], scores[row, col], those.ids[col]

    def work(batches):
        asked: dict[int, Block] = {}
        found: dict[int, Best] = {}
        for block, asks, rows in _meetings(batches, asked):
            fresh = block not in found
            best = found.setdefault(block, Best(np.full(len(asks.ids), _LONG[0]), count))
            for part in _in_turn(rows, fresh):
                best.add([*near(asks, part, best.floors)])
        for block, best in found.items():
            place, asks = best.lists, asked[block]
            arrays = [np.full(len(place), block), place.astype(np.int32), asks.ids[place], _squares(asks.cells)[place], best.ids, best.scores]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], ["block", "place", "anchor_id", "own", "id", "score"])

    return work


def _share(scores: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """percent / 100 of each score, rounded up or down, without leaving 64 bits."""
    whole, rest = np.divmod(scores, 100)
    return whole * percent + (-((-rest * percent) // 100) if up else rest * percent // 100)


def _best_between(positives: int, count: int, low: int, high: int) -> Callable:
    def near(asks: Block, rows: Block, floors: np.ndarray, tops: np.ndarray) -> Iterator[tuple]:
        """A list for each positive: those of anchor i have the numbers from i * positives on."""
        least, most = floors.reshape(-1, positives).min(1), tops.reshape(-1, positives).max(1)
        for at, scores in score_tiles(asks.cells, rows.cells):
            mine = slice(at, at + len(scores))
            fits = (scores >= least[mine, None]) & (scores <= most[mine, None])
            if np.count_nonzero(fits) * DENSE > fits.size:
                ranked = Ranked(scores, asks.labels[mine, None] != rows.labels)
                keys = np.sort(ranked.keys, axis=1)
                for nth in range(positives):
                    lists = np.arange(at, at + len(scores)) * positives + nth
                    start, stop = (np.count_nonzero(keys < x[:, None], axis=1)[:, None] for x in ranked.bounds(floors[lists], tops[lists]))
                    picked = stop - 1 - np.arange(count)
                    row, k = np.nonzero(picked >= start)
                    place, score = ranked.told(keys[row, picked[row, k]])
                    yield lists[row], score, rows.ids[place]
            else:
                row, col = np.divmod(np.flatnonzero(fits), max(1, fits.shape[1]))
                other = asks.labels[at + row] != rows.labels[col]
                row, col = row[other], col[other]
                score, lists = scores[row, col], (at + row)[:, None] * positives + np.arange(positives)
                i, p = np.nonzero((score[:, None] >= floors[lists]) & (score[:, None] <= tops[lists]))
                yield lists[i, p], score[i], rows.ids[col[i]]

    def work(batches):
        asked: dict[int, Block] = {}
        found: dict[int, tuple[Best, np.ndarray, np.ndarray]] = {}
        for block, asks, rows in _meetings(batches, asked):
            if fresh := block not in found:
                place, nth, *known = asks.known
                floors, tops = (np.full(len(asks.ids) * positives, v) for v in _LONG[::-1])  # no positive: nothing between
                lists = place * positives + nth - 1
                floors[lists], tops[lists] = _share(known[1], low, True), _share(known[1], high, False)
                of_list = np.zeros((2, len(floors)), np.int64)
                of_list[:, lists] = known
                found[block] = Best(floors, count), tops, of_list
            best, tops, _ = found[block]
            for part in _in_turn(rows, fresh):
                best.add([*near(asks, part, best.floors, tops)])
        for block, (best, _, of_list) in found.items():
            place, nth = np.divmod(best.lists, positives)
            known, score = of_list[:, best.lists]
            arrays = [np.full(len(place), block), place.astype(np.int32), asked[block].ids[place], (nth + 1).astype(np.int32), known, score, best.ids, best.scores]
            names = ["block", "place", "anchor_id", "nth", "positive_id", "positive_score", "negative_id", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], names)

    return work


def hard_negatives(
    rows: DataFrame, anchor: Column | str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
    block_rows: int = ROWS, block_anchors: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, label, embedding).

    ``anchor``: the condition on the rows that are queries. ``low`` and ``high``: percent, from 0 to 100.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("low and high are percent, 0 <= low <= high <= 100")
    known = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"), F.expr(anchor).alias("asks") if isinstance(anchor, str) else anchor.alias("asks"))
    known = known.where("id is not null and label is not null and vector is not null")
    blocks = settled(in_streams(known.drop("asks"), _packed(block_rows, scale), _BLOCK))
    asking = known.where("asks").drop("asks")
    asking = settled(in_streams(asking.repartition(max(1, asking.count() // (HELD * block_anchors))), _packed(block_anchors, scale), _BLOCK))
    n, n_asking, cores = blocks.count(), asking.count(), rows.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n_asking // HELD), min(n_asking, -(-3 * cores // LANES)))
    lanes = max(1, min(n, max(LANES, -(-3 * cores // groups))))

    def met(asked: DataFrame) -> DataFrame:
        """Each block of anchors beside each block of rows. The hint keeps Spark from a broadcast: files tell too little of the sizes."""
        right = blocks.select(*[F.col(c).alias(f"r_{c}") for c in blocks.columns]).repartition(lanes)
        return right.hint("shuffle_replicate_nl").join(asked.repartition(groups), F.col("r_dims") == F.col("dims"))

    best = in_streams(met(asking), _best_same(positives + 1), "block long, place int, anchor_id long, own long, id long, score long")
    of_anchor = Window.partitionBy("block", "place")
    best = best.withColumn("nth", F.row_number().over(of_anchor.orderBy(F.desc("score"), "id"))).where(F.col("nth") <= positives + 1)
    # The anchor is one of its own best rows, unless others are better: one row of its id and score goes.
    itself = (F.col("id") == F.col("anchor_id")) & (F.col("score") == F.col("own"))
    first_self = F.min(F.when(itself, F.col("nth"))).over(of_anchor)
    best = best.withColumn("self", F.coalesce(first_self, F.lit(positives + 1))).where("nth != self")
    found = best.withColumn("nth", F.when(F.col("nth") > F.col("self"), F.col("nth") - 1).otherwise(F.col("nth")))
    of_block = settled(found.groupBy("block").agg(F.collect_list(F.struct("place", "nth", "id", "score")).alias("positives")))

    other = met(asking.join(of_block.hint("merge"), "block"))
    kinds = "block long, place int, anchor_id long, nth int, positive_id long, positive_score long, negative_id long, negative_score long"
    mined = in_streams(other, _best_between(positives, negatives, low, high), kinds)
    of_pair = Window.partitionBy("block", "place", "nth").orderBy(F.desc("negative_score"), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(of_pair)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
