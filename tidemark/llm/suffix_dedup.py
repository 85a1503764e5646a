"""Removal of long repeated byte strings through a distributed, prefix-aware merge sort of suffixes.

Which suffixes. Every window of ``length`` bytes names one byte in it, the start of its least 32-byte
hash (ties: the first). Equal windows name the same place, so only suffixes that start at a named byte
need sorting, one in about 85. A named suffix is at first cut to its 32 leading bytes: one whose
leading bytes occur nowhere else repeats nothing and goes no further (only hashes are counted for
this, and equal hashes merely keep a suffix in). The others are sorted, up to the length that a window
can reach.

Sort. Each task sorts its suffixes, front-codes the run (bytes shared with the run's previous suffix
are not sent) and cuts it at splitters, which compare leading bytes only. The receiver of a range
merges all runs by a loser tree that keeps, with each candidate, the length it shares with the last
winner: unequal lengths decide a match without a look at the bytes, equal ones go on from there, so a
known prefix is never compared again.

From order to windows. Suffixes with common leading bytes are neighbours. Joining neighbours from the
longest common prefix R downwards, with the bytes before each suffix kept in order, each suffix meets
the one that shares most bytes L before it. Windows that start o bytes before a suffix repeat if
200 - R <= o <= L. Any other pair shares no more on either side than a pair that was met.

Scale. A group of suffixes with the same leading bytes is merged in one task while it has at most
``most_in_task`` members; in larger ones the windows themselves are counted by a 128-bit hash, with
partial counts in each task, which gives the same result. Copies of whole texts are one text here.

Defined cases. Null is empty; matches never cross texts; texts under ``length`` bytes lose nothing.
Rows are told apart by position, not by doc_id, so repeated rows are copies of each other, and null
ids and extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.frames import carried, in_batches, in_streams, settled
from tidemark.operators.ordered import join_facts

LENGTH, HEAD = 200, 32
RUN_ITEMS, PIECE = 60_000, 1 << 22
MOST_IN_TASK = 100_000


# -- named places ---------------------------------------------------------------------------------


def named_places(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """(place, first, last): windows starting from first to last name this place; and the prefix sums."""
    sums = K.prefix_sums(data)
    reach = length - HEAD + 1
    ok = np.ones(len(data), bool)
    for a, b in zip(offsets[:-1], offsets[1:]):
        ok[max(a, b - length + 1) : b] = False
    starts = np.flatnonzero(ok)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, sums
    n = len(data) - HEAD + 1
    low = np.uint64((1 << 24) - 1)
    at = np.arange(n)
    least = (K.span_hashes(sums, at, at + HEAD) & ~low) | at.astype(np.uint64)
    width = 1
    while 2 * width <= reach:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    place = (least[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    return place[head], starts[head], starts[np.append(head[1:], len(starts)) - 1], sums


def _pieces(part: K.Slice, length: int):
    """(row, base, data, offsets): long texts are cut so that each window lies in one piece."""
    if len(part.data) <= 2 * PIECE:
        yield part.lo, 0, part.data, part.offsets
        return
    for i, (a, b) in enumerate(zip(part.offsets[:-1], part.offsets[1:]), part.lo):
        for base in range(0, max(1, b - a - length + 1), PIECE):
            stop = min(b - a, base + PIECE + length - 1)
            yield i, base, part.data[a + base : a + stop], np.array([0, stop - base])


def _packed(place, first, last):
    return (place << 16) | ((place - first) << 8) | (place - last)


def _heads(length: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, cores, packed, heads = [], [], [], []
        for part in K.slices(batch["text"]):
            for row, base, data, offsets in _pieces(part, length):
                place, first, last, sums = named_places(data, offsets, length)
                core = K.span_hashes(sums, place, place + HEAD)
                text = np.searchsorted(offsets, place, side="right") - 1
                # Empty texts share their offset with the next one; the last of them owns the byte.
                rows.append(row + text)
                cores.append(core)
                packed.append(_packed(*(x - offsets[text] + base for x in (place, first, last))))
                shown = (core & np.uint64(63)) == 0
                heads += [data[p : p + HEAD].tobytes() if s else None for p, s in zip(place.tolist(), shown.tolist())]
        index = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(K.signed(np.concatenate(cores))), batch["k1"].take(index), batch["k2"].take(index),
             pa.array(np.concatenate(packed)), pa.array(heads, pa.binary())],
            ["core", "k1", "k2", "at", "head"],
        )

    return work


# -- runs -----------------------------------------------------------------------------------------


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


class Run:
    """A sorted run as it is sent: suffixes front-coded, then what stood before them, then owners."""

    @staticmethod
    def pack(items: list[tuple[bytes, bytes, list]]) -> bytes:
        shares, rests, lefts, owners, last = bytearray(), [], [], [], b""
        for suffix, left, who in items:
            h = shared(last, suffix)
            shares.append(h)
            rests.append(suffix[h:])
            lefts.append(left)
            owners.append(who)
            last = suffix
        lengths = bytes(map(len, rests)), bytes(map(len, lefts))
        plain = pickle.dumps((bytes(shares), *lengths, b"".join(rests), b"".join(lefts), owners), 5)
        return zstandard.ZstdCompressor(1).compress(plain)

    @staticmethod
    def read(blob: bytes) -> Iterator[tuple[bytes, int, bytes, list]]:
        """(suffix, length shared with the run's previous one, bytes before it, owners)."""
        shares, sizes, left_sizes, rests, lefts, owners = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
        last, at, left_at = b"", 0, 0
        for h, n, m, who in zip(shares, sizes, left_sizes, owners):
            last = last[:h] + rests[at : at + n]
            yield last, h, lefts[left_at : left_at + m], who
            at, left_at = at + n, left_at + m


def merged(runs: list[Iterator]) -> Iterator[tuple[bytes, int, bytes, list]]:
    """All items of sorted runs in order, each with the length it shares with the one before.

    A loser tree over the runs' heads. ``known[i]`` is what head i shares with the last winner. Of two
    heads the one that shares more comes first; the loser then shares with it what it did before.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads = [next(r, None) for r in runs] + [None] * (size - len(runs))
    known = [0] * size
    losers = [-1] * size

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser), with the loser's shared length set against the winner."""
        a, b = heads[x], heads[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if known[x] != known[y]:
            return (x, y) if known[x] > known[y] else (y, x)
        h = shared(a[0], b[0], known[x])
        first = h == len(a[0]) or (h < len(b[0]) and a[0][h] < b[0][h])
        win, lose = (x, y) if first else (y, x)
        known[lose] = h
        return win, lose

    def build(node: int) -> int:
        if node >= size:
            return node - size
        win, losers[node] = play(build(2 * node), build(2 * node + 1))
        return win

    winner = build(1) if size > 1 else 0
    while heads[winner] is not None:
        suffix, _, left, who = heads[winner]
        yield suffix, known[winner], left, who
        following = next(runs[winner], None)
        heads[winner] = following
        known[winner] = following[1] if following else 0
        node = (winner + size) // 2
        while node >= 1:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


# -- repeated windows of one group ----------------------------------------------------------------


def repeated_ranges(group: list[tuple[bytes, int, bytes, list]], length: int = LENGTH):
    """(owner, low, high) for suffixes in order: windows starting low to high bytes before repeat."""
    where, items = {}, []
    for suffix, h, left, who in group:
        key = (suffix, left)
        if key in where:
            items[where[key]][2].extend(who)
            reach = items[-1][3]
            items[-1][3] = min(reach, h)
            continue
        where[key] = len(items)
        # The last number: what the next new item may share at most with this place in the order.
        items.append([suffix, left[::-1], list(who), len(suffix), h])
    n = len(items)
    found = [[] for _ in range(n)]
    for i, (suffix, left, who, _, _) in enumerate(items):
        if len(who) > 1:
            found[i].append((length - len(suffix), len(left)))
    if n > 1:
        shares = [0] * n
        for i in range(1, n):
            shares[i] = min(items[i][4], items[i - 1][3])
        parent = list(range(n))
        orders = [([items[i][1]], [i]) for i in range(n)]

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for t in sorted(range(1, n), key=lambda t: -shares[t]):
            r = shares[t]
            x, y = root(t - 1), root(t)
            if len(orders[x][0]) < len(orders[y][0]):
                x, y = y, x
            parent[y] = x
            keys, ids = orders[x]
            for key, i in zip(*orders[y]):
                at = bisect_left(keys, key)
                for j in (at - 1, at):
                    if 0 <= j < len(keys):
                        common = shared(key, keys[j])
                        if common >= length - r:
                            found[i].append((length - r, common))
                            found[ids[j]].append((length - r, common))
                keys.insert(at, key)
                ids.insert(at, i)
            orders[y] = None
    for i, ranges in enumerate(found):
        ranges.sort()
        joined = []
        for low, high in ranges:
            if joined and low <= joined[-1][1] + 1:
                joined[-1][1] = max(joined[-1][1], high)
            else:
                joined.append([low, high])
        for low, high in joined:
            for owner in items[i][2]:
                yield owner, low, high


# -- the distributed steps ------------------------------------------------------------------------


def _keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))


def _zipped(batch: pa.RecordBatch) -> pa.RecordBatch:
    squeeze = zstandard.ZstdCompressor(3).compress
    blobs = [squeeze(t.encode()) for t in batch["text"].to_pylist()]
    columns = [batch[c] for c in batch.schema.names if c != "text"]
    names = [c for c in batch.schema.names if c != "text"]
    return pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary())], [*names, "z"])


def _contexts(data: bytes, places: list[int], length: int):
    for at in places:
        place, before, last = at >> 16, (at >> 8) & 255, at & 255
        yield at, place, data[place : place - last + length], data[place - before : place]


def _sent_runs(splitters: list[bytes], length: int):
    """Rows (k1, k2, places, z): sorted, front-coded runs, one for each range of leading bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, items, out = zstandard.ZstdDecompressor().decompress, {}, []

        def flush():
            order = sorted(items)
            parts: dict[int, list] = {}
            for key in order:
                parts.setdefault(bisect_right(splitters, key[0][:HEAD]), []).append((*key, items[key]))
            items.clear()
            for part in sorted(parts):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([Run.pack(parts[part])], pa.binary())], ["part", "run"])

        for batch in batches:
            for k1, k2, places, z in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "places", "z"))):
                for at, _, suffix, left in _contexts(unzip(z), places, length):
                    items.setdefault((suffix, left), []).append((k1, k2, at))
                if len(items) >= RUN_ITEMS:
                    yield from flush()
        yield from flush()

    return run


def _merged_spans(length: int):
    """Rows (part, run), sorted by part: (k1, k2, start, stop) of the bytes in repeated windows."""

    def of_part(blobs):
        group = []
        for item in merged([Run.read(b) for b in blobs]):
            if item[1] < HEAD and group:
                if len(group) > 1 or len(group[0][3]) > 1:
                    yield from repeated_ranges(group, length)
                group = []
            group.append(item)
        if group and (len(group) > 1 or len(group[0][3]) > 1):
            yield from repeated_ranges(group, length)

    def spans(blobs):
        rows = []
        for (k1, k2, at), low, high in of_part(blobs):
            place = at >> 16
            rows.append((k1, k2, place - high, place - low + length))
            if len(rows) >= 50_000:
                yield _span_rows(rows)
                rows = []
        yield _span_rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for part, blob in zip(batch["part"].to_pylist(), batch["run"].to_pylist()):
                if part != now and blobs:
                    yield from spans(blobs)
                    blobs = []
                now = part
                blobs.append(blob)
        if blobs:
            yield from spans(blobs)

    return run


def _span_rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["k1", "k2", "start", "stop"])


def _windows(length: int):
    """Rows (k1, k2, places, z) of very common suffixes: a 128-bit hash of each of their windows."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        unzip, out = zstandard.ZstdDecompressor().decompress, []
        for k1, k2, places, z in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "places", "z"))):
            text = unzip(z)
            for at in places:
                place, before, last = at >> 16, (at >> 8) & 255, at & 255
                for start in range(place - before, place - last + 1):
                    digest = hashlib.blake2b(text[start : start + length], digest_size=16).digest()
                    out.append((int.from_bytes(digest[:8], signed=True), int.from_bytes(digest[8:], signed=True), k1, k2, start))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["w1", "w2", "k1", "k2", "start"])

    return work


def _kept(carry: tuple[str, ...]):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        unzip, removed, runs, digests, kept = zstandard.ZstdDecompressor().decompress, [], [], [], []
        for z, spans in zip(batch["z"].to_pylist(), batch["spans"].to_pylist()):
            text, rest, at, gone, n = unzip(z), [], 0, 0, 0
            for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
                if start > at or not n:
                    rest.append(text[at:start])
                    n += 1
                    gone += stop - start
                    at = stop
                elif stop > at:
                    gone += stop - at
                    at = stop
            rest.append(text[at:])
            rest = b"".join(rest)
            removed.append(gone), runs.append(n), digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        counts = [pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())]
        arrays = [batch["doc_id"], batch["n_bytes"], *counts, *(batch[c] for c in carry)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *carry])

    return work


def repeated_spans(keyed: DataFrame, length: int = LENGTH, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """(k1, k2, start, stop): bytes of each distinct text that lie in a window found elsewhere too."""
    spark = keyed.sparkSession
    named = in_batches(keyed.select("text", "k1", "k2"), _heads(length), "core long, k1 long, k2 long, at long, head binary")
    common = named.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    found = settled(join_facts(named, common, ["core"]).select("k1", "k2", "at", "head", "n"))
    shown = [bytes(r.head) for r in found.where("head is not null").select("head").distinct().orderBy(F.xxhash64("head")).limit(20_000).collect()]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), found.count() // 60_000)
    shown.sort()
    splitters = sorted({shown[i * len(shown) // ranges] for i in range(1, ranges)}) if shown else []
    texts = in_batches(keyed.select("k1", "k2", "text"), _zipped, "k1 long, k2 long, z binary")

    def with_texts(rows):
        return rows.groupBy("k1", "k2").agg(F.collect_set("at").alias("places")).join(texts, ["k1", "k2"])

    runs = in_streams(with_texts(found.where(F.col("n") <= most_in_task)), _sent_runs(splitters, length), "part int, run binary")
    dealt = runs.repartition(len(splitters) + 1, "part").sortWithinPartitions("part")
    spans = in_streams(dealt, _merged_spans(length), "k1 long, k2 long, start long, stop long")
    hot = found.where(F.col("n") > most_in_task)
    if not hot.isEmpty():
        windows = settled(in_batches(with_texts(hot).dropDuplicates(["k1", "k2"]), _windows(length), "w1 long, w2 long, k1 long, k2 long, start long"))
        twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
        spans = spans.unionAll(windows.join(twice, ["w1", "w2"]).select("k1", "k2", "start", (F.col("start") + length).alias("stop")))
    return spans


def without_repeats(docs: DataFrame, length: int = LENGTH, most_in_task: int = MOST_IN_TASK, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of ``docs`` (doc_id, text).

    ``kept`` holds the remaining bytes; a cut may fall inside a character. The columns named in ``carry``
    (neither doc_id nor text) come along unchanged.
    """
    if not HEAD + 8 <= length <= 255:
        raise ValueError("length must be from 40 to 255 bytes")
    keyed = _keyed(docs, carry)
    spans = repeated_spans(keyed, length, most_in_task).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    copies = keyed.groupBy("k1", "k2", size).agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n_bytes") >= length))
    whole = copies.select("k1", "k2", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))).alias("spans"))
    cut = whole.unionAll(spans.join(whole, ["k1", "k2"], "left_anti"))
    rows = keyed.select("doc_id", "k1", "k2", size, "text", *carry)
    zipped = in_batches(rows, _zipped, carried(docs, carry, "doc_id long, k1 long, k2 long, n_bytes long").add("z", "binary"))
    joined = join_facts(zipped, cut, ["k1", "k2"], "left").select("doc_id", "n_bytes", "z", "spans", *carry)
    return in_batches(joined, _kept(carry), carried(docs, carry, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))


def with_kept_text(cut: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, ...) from the kept bytes; bytes that form no character any more are dropped."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([k.decode("utf-8", "ignore") for k in batch["kept"].to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([batch["doc_id"], texts, *(batch[c] for c in carry)], ["doc_id", "text", *carry])

    return in_batches(cut.select("doc_id", "kept", *carry), work, carried(cut, carry, "doc_id long, text string"))
