"""Documents packed into sequences of a fixed number of tokens by exact complements, then best fit.

Lengths, not documents, are planned: a histogram of piece lengths has at most ``size`` entries however
many documents there are. From the longest length down, a sequence begun with it has a gap; lengths,
sums of two and sums of three lengths that are still available are looked up for an exact fill. A
combination is consumed at once as often as the counts of its parts allow. A gap without an exact fill
takes the longest length that fits (best fit) and is looked up again. Each step uses up a length or
halves its count, so the plan is a few rows per length.

The plan gives each (length, running number) its sequence and offset. Pieces are numbered within their
length by bucket: counts per bucket and length are added up, so a length that a third of all pieces
share is numbered by all tasks together.

Defined cases. Null text is empty: one piece, the end token alone. Every row is packed, whatever its
doc_id; rows with the same id are packed as they stand (their order among each other is free). Extra
columns are ignored. Sequence numbers have no meaning beyond telling sequences apart.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.frames import in_batches, in_streams, settled
from tidemark.llm.word_tokens import encoder, vocabulary_path

SIZE, END = 4096, 1
BUCKETS, BUCKET_ROWS = 512, 500_000


# -- the plan -------------------------------------------------------------------------------------


class Stock:
    """Available lengths with counts; bit sets answer which lengths and sums of two exist."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.count = size, [0] * (size + 1)
        for length, n in counts.items():
            self.count[length] = n
        self.one = sum(1 << n for n in range(1, size + 1) if self.count[n])
        self.mirror = sum(1 << (size - n) for n in range(1, size + 1) if self.count[n])

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            self.one &= ~(1 << length)
            self.mirror &= ~(1 << (self.size - length))

    def longest(self, most: int) -> int:
        """The longest available length up to ``most``, 0 if there is none."""
        return (self.one & ((2 << most) - 1)).bit_length() - 1 if most > 0 and self.one & ((2 << most) - 1) else 0

    def pair(self, gap: int) -> tuple[int, int] | None:
        """Two available lengths with this sum, the longer as long as possible."""
        # Bit n of the shifted mirror is set if gap - n is available.
        shift = self.size - gap
        both = self.one & (self.mirror >> shift) & ((1 << gap) - 1)
        while both:
            n = both.bit_length() - 1
            if 2 * n != gap or self.count[n] > 1:
                return n, gap - n
            both &= ~(1 << n)
        return None

    def triple(self, gap: int) -> tuple[int, int, int] | None:
        """Three available lengths with this sum; the first one, the longest, is tried from the longest down."""
        n = gap - 1
        while 3 * n >= gap and (n := self.longest(n)) and 3 * n >= gap:
            only = self.count[n] == 1
            self.take(n, 1)
            rest = self.pair(gap - n) if gap - n > 1 else None
            self.count[n] += 1
            if only:
                self.one |= 1 << n
                self.mirror |= 1 << (self.size - n)
            if rest:
                return (n, *rest)
            n -= 1
        return None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths of one sequence) that together use all counted lengths.

    Sums of up to three, two or one length are looked up; the plan with the fewest sequences counts.
    """
    least = -(-sum(n * c for n, c in counts.items()) // size)
    best: list = []
    for longest_fill in (3, 2, 1):
        made = _plan(counts, size, longest_fill)
        if not best or sum(n for n, _ in made) < sum(n for n, _ in best):
            best = made
        if sum(n for n, _ in best) == least:
            break
    return best


def _plan(counts: dict[int, int], size: int, longest_fill: int) -> list[tuple[int, tuple[int, ...]]]:
    stock, out = Stock(counts, size), []
    while (head := stock.longest(size)):
        parts = [head]
        while (gap := size - sum(parts)) > 0:
            left = list(parts)
            for x in parts:  # what the sequence itself uses is not there for its fill
                stock.count[x] -= 1
            hidden = [x for x in set(parts) if stock.count[x] <= 0]
            for x in hidden:
                stock.one &= ~(1 << x)
                stock.mirror &= ~(1 << (size - x))
            fill = (gap,) if stock.one >> gap & 1 else None
            if not fill and longest_fill > 1:
                fill = stock.pair(gap) or (stock.triple(gap) if longest_fill > 2 else None)
            done = bool(fill)
            if not fill:
                best = stock.longest(gap)
                fill = (best,) if best else ()
                done = not best
            for x in hidden:
                stock.one |= 1 << x
                stock.mirror |= 1 << (size - x)
            for x in left:
                stock.count[x] += 1
            parts += fill
            if done:
                break
        times = min(stock.count[x] // parts.count(x) for x in set(parts))
        for x in parts:
            stock.take(x, times)
        out.append((times, tuple(parts)))
    return out


def slots(planned: list[tuple[int, tuple[int, ...]]]) -> pd.DataFrame:
    """Rows (length, begin, sequence, offset): pieces of a length, numbered from ``begin``, take
    sequence, sequence + 1, ... at this offset until the next row of the length begins."""
    rows, used, sequence = [], {}, 0
    for times, parts in planned:
        offset = 0
        for x in parts:
            begin = used.get(x, 0)
            rows.append((x, begin, sequence, offset))
            used[x] = begin + times
            offset += x
        sequence += times
    return pd.DataFrame(rows, columns=["length", "begin", "sequence", "offset"]).sort_values(["length", "begin"], ignore_index=True)


# -- pieces ---------------------------------------------------------------------------------------


def _pieces(path: str, size: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(path)
        row, piece, start, length, crc = [], [], [], [], []
        for part in K.slices(batch["text"]):
            words, numbers = coder.words(part.data, part.offsets)
            ids = coder.spread(numbers).astype("<u4")
            ends = np.concatenate(([0], np.cumsum(coder.counts(numbers))))[words.first]
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist()), part.lo):
                own = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                for k, at in enumerate(range(0, len(own), size)):
                    cut = own[at : at + size]
                    row.append(i), piece.append(k), start.append(at), length.append(len(cut)), crc.append(zlib.crc32(cut.tobytes()))
        index = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"].take(index), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return work


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the token pieces of each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_batches(texts, _pieces(path, size), "doc_id long, piece int, start long, length long, ids_crc32 long", keeps_words=True)


def _placed(table: pd.DataFrame):
    lengths, begins = table["length"].to_numpy(), table["begin"].to_numpy()
    keys = (lengths.astype(np.int64) << 40) + begins
    sequences, offsets = table["sequence"].to_numpy(), table["offset"].to_numpy()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
        at = np.searchsorted(keys, (length << 40) + number, side="right") - 1
        return pa.RecordBatch.from_arrays(
            [*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequences[at] + number - begins[at]), pa.array(offsets[at])],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )

    return work


def _numbered(batches):
    """Rows (bucket, length, base, ...), sorted by bucket and length: base + place within both."""
    last, seen = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        bucket, length = batch["bucket"].to_numpy(), batch["length"].to_numpy()
        new = np.ones(n, bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (length[1:] != length[:-1])
        new[0] = (bucket[0], length[0]) != last
        head = np.flatnonzero(np.concatenate(([True], new[1:])))
        place = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
        if not new[0]:
            place[: head[1] if len(head) > 1 else n] += seen
        last, seen = (bucket[-1], length[-1]), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(batch["base"].to_numpy() + place)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "number"],
        )


def packed(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row."""
    if not 1 < size < 1 << 20:
        raise ValueError("size must be from 2 to a million tokens")
    written = settled(pieces(docs, path or vocabulary_path(), size))
    buckets = max(BUCKETS, written.count() // BUCKET_ROWS)
    cut = written.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    shares = settled(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # A window per length, of one row per bucket at most.
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = shares.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    dealt = cut.join(bases, ["length", "bucket"]).repartition("bucket").sortWithinPartitions("bucket", "length", "doc_id", "piece")
    place = _placed(slots(plan(counts, size)))
    return in_streams(dealt, lambda batches: map(place, _numbered(batches)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
