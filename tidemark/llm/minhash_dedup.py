"""Near duplicates by one-permutation hashing, banded buckets and star-shaped candidate links.

Method. One hash per shingle fills the bins of a sketch (the range of the hash is cut into equal
bins, each keeps its least value); an empty bin borrows from the first full bin of a fixed random
probe sequence of its own (optimal densification), so bins agree with the Jaccard similarity as their
probability. Bands of bins are bucket keys. Texts with the same shingle set are one class, and only
its smallest document takes part. Each bucket links its members to one of them: a star, so the
candidates grow as the buckets do. The hub is the member that meets most others over all its buckets,
as a rule the text that the others were made from. Candidates are measured on full sets.

No link is lost to the stars. Buckets that hold several components after the first round are looked at
again: their members outside the main component meet all members of other components, in blocks, and
pairs that cannot be similar enough go no further. For this a text brings its 4,096 least shingle hashes.
Below the least hash at which either list ends, what two texts share is known; above it they share at
most what the smaller one has left. A pair goes no further only if even that is not enough, so no text,
however long, loses a link here, and pairs of texts within the 4,096 are judged almost exactly.

Chance of missing a link of similarity 0.75: (1 - 0.75**5)**48 = 2e-6.

Scale. Bucket keys are aggregated and written before the join back, hot keys are on one side only, and such
joins are split at run time. Nothing is collected. In the second look a bucket's members stream past blocks of at most some hundred others,
so a bucket of any size is spread over tasks and never held as a whole; only possible pairs are rows.

Defined cases. Null, empty and blank texts have an empty set and link with nothing. Fewer than five
words: the whole sequence is one shingle. Rows with the same doc_id are one document: a link of any
of them counts. A null doc_id takes part in no link and keeps itself. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.components import star_forest
from tidemark.llm.frames import carried, in_batches, in_streams, only, settled
from tidemark.operators.ordered import join_facts

SHINGLE, ROWS, BANDS, PERCENT = 5, 5, 48, 75
BINS = ROWS * BANDS
LEAST = 4096
_EDGES = (np.arange(1, BINS, dtype=object) * 2**64 // BINS).astype(np.uint64)
_PROBES = np.random.default_rng(6).integers(0, BINS, (2048, BINS))
_BAND = K.mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_sets(part: K.Slice) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = K.word_spans(part.data, part.offsets, K.NOT_SPACE)
    hashes = K.span_hashes(K.prefix_sums(K.LOWER[part.data]), words.starts, words.ends)
    rolled = K.shingle_hashes(hashes, SHINGLE)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= SHINGLE:
            yield np.unique(rolled[a : b - SHINGLE + 1])
        elif b > a:
            yield K.shingle_hashes(hashes[a:b], int(b - a)) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def sketch(found: np.ndarray) -> np.ndarray:
    """One bin value per cell, empty cells filled from their probe sequence; needs a shingle."""
    at = np.concatenate(([0], np.searchsorted(found, _EDGES), [len(found)]))
    full = at[1:] > at[:-1]
    bins = found[np.minimum(at[:-1], len(found) - 1)]
    empty = np.flatnonzero(~full)
    turn = 0
    while len(empty):
        donor = _PROBES[turn % len(_PROBES), empty] if turn < len(_PROBES) else (empty + turn) % BINS
        hit = full[donor]
        bins[empty[hit]] = bins[donor[hit]]
        empty = empty[~hit]
        turn += 1
    return bins


def _band_keys(bins: np.ndarray) -> np.ndarray:
    cells = bins.reshape(BANDS, ROWS)
    keys = _BAND.copy()
    for j in range(ROWS):
        keys = K.mixed(keys * np.uint64(0x9E3779B97F4A7C15) + cells[:, j])
    return keys


_PRINTS = "doc_id long, n_shingles long, k1 long, k2 long, keys array<long>, sketch binary"


def _fingerprints(batch: pa.RecordBatch, carry: tuple[str, ...] = ()) -> pa.RecordBatch:
    n, sizes, k1, k2, keys, prints = batch.num_rows, [], [], [], [], []
    for part in K.slices(batch["text"]):
        for found in shingle_sets(part):
            sizes.append(len(found))
            if not len(found):
                k1.append(0), k2.append(0), prints.append(b"")
                continue
            k1.append(int(K.signed(K.mixed(found).sum(keepdims=True, dtype=np.uint64))[0]))
            k2.append(int(K.signed(np.bitwise_xor.reduce(found, keepdims=True))[0]))
            keys.append(_band_keys(sketch(found)))
            prints.append((found[:LEAST] >> np.uint64(32)).astype(np.uint32).tobytes())
    sizes = np.array(sizes, np.int64)
    ends = np.concatenate(([0], np.cumsum((sizes > 0) * BANDS))).astype(np.int32)
    flat = K.signed(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"].cast(pa.int64()), pa.array(sizes), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
         pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(prints, pa.binary()), *(batch[c] for c in carry)],
        ["doc_id", "n_shingles", "k1", "k2", "keys", "sketch", *carry],
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, side, text), sorted by a, b and side: the pairs that are similar enough."""
    pair, lefts, rights, out = None, [], [], []

    def judged():
        for x in lefts:
            for y in rights:
                if len(x) and len(y):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= PERCENT * (len(x) + len(y) - both):
                        out.append(pair)
                        return

    for batch in batches:
        firsts, seconds, sides = batch["a"].to_pylist(), batch["b"].to_pylist(), batch["side"].to_pylist()
        for part in K.slices(batch["text"]):
            for i, found in enumerate(shingle_sets(part), part.lo):
                if (firsts[i], seconds[i]) != pair:
                    judged()
                    pair, lefts, rights = (firsts[i], seconds[i]), [], []
                (rights if sides[i] else lefts).append(found)
        yield _pairs(out)
        out.clear()
    judged()
    yield _pairs(out)


def _pairs(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    ends = F.array(F.struct(F.col("a").alias("doc_id"), F.lit(0).alias("side")), F.struct(F.col("b").alias("doc_id"), F.lit(1).alias("side")))
    rows = pairs.select("a", "b", F.explode(ends).alias("end")).select("a", "b", "end.doc_id", "end.side")
    held = rows.hint("merge").join(texts, "doc_id").select("a", "b", "side", "text")
    return in_streams(held.repartition(F.col("a"), F.col("b")).sortWithinPartitions("a", "b", "side"), _measure, "a long, b long")


class Others:
    """Members of a block that others are compared with, by their least shingle hashes."""

    def __init__(self, part: np.ndarray, rep: np.ndarray, n: np.ndarray, sketches: list[bytes]):
        own = [np.frombuffer(x, np.uint32) for x in sketches]
        order = np.argsort(n, kind="stable")  # members of like size stand together
        self.part, self.rep, self.n = part[order], rep[order], n[order].astype(np.int64)
        own = [own[i] for i in order.tolist()]
        self.sizes = np.array([len(x) for x in own])
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.hashes = np.concatenate(own)
        self.end = np.array([_known_below(x, n) for x, n in zip(own, self.n.tolist())])
        self.mark = np.zeros(1 << 20, bool)

    def possible(self, part, n: int, sketch: bytes) -> np.ndarray:
        """The members in other parts that may be similar enough; none that is similar is left out."""
        n = int(n)
        lo = int(np.searchsorted(100 * self.n, PERCENT * n))
        hi = int(np.searchsorted(PERCENT * self.n, 100 * n, side="right"))
        if lo == hi:
            return self.rep[:0]
        mine = np.frombuffer(sketch, np.uint32)
        below = np.minimum(self.end[lo:hi], _known_below(mine, n))
        hashes = self.hashes[self.first[lo] : self.first[hi]]
        starts = self.first[lo:hi] - self.first[lo]
        inside = hashes < np.repeat(below, self.sizes[lo:hi])
        self.mark[mine >> 12] = True
        both = np.add.reduceat(self.mark[hashes >> 12] & inside, starts, dtype=np.int64)  # equal leading bits: no less than the truth
        self.mark[mine >> 12] = False
        known = np.add.reduceat(inside, starts, dtype=np.int64)
        own = np.searchsorted(mine, below)
        sizes = self.n[lo:hi]
        most = np.minimum(both, own) + np.minimum(sizes - known, n - own)
        near = (100 + PERCENT) * most >= PERCENT * (sizes + n)
        return self.rep[lo:hi][near & (self.part[lo:hi] != part)]


def _known_below(least: np.ndarray, n: int) -> int:
    """The value below which a sorted list of least hashes holds all of a set of ``n``."""
    return 2**32 if n <= len(least) else int(least[-1])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, member, part, rep, n, sketch), sorted so that a block's others come first."""
    now, held, others = None, [], None
    for batch in batches:
        rows, out = batch.num_rows, []
        keys, blocks, member, part, rep, n = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "block", "member", "part", "rep", "n"))
        sketches = batch["sketch"].to_pylist()
        change = np.flatnonzero((np.diff(keys) != 0) | (np.diff(blocks) != 0) | (np.diff(member.astype(int)) != 0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), rows]):
            if (keys[a], blocks[a]) != now:
                now, held, others = (keys[a], blocks[a]), [], None
            if not member[a]:
                held.append((part[a:b], rep[a:b], n[a:b], sketches[a:b]))
                continue
            if others is None and held:
                others = Others(*(np.concatenate(x) for x in list(zip(*held))[:3]), [s for x in held for s in x[3]])
            for i in range(a, b) if others else ():
                out += [(min(x, rep[i]), max(x, rep[i])) for x in others.possible(part[i], n[i], sketches[i])]
        yield _pairs(out)


def _roots(rows: DataFrame, node: str, forest: DataFrame) -> DataFrame:
    """``rows`` with the smallest node that ``node`` reaches in its place."""
    found = rows.join(forest, rows[node] == forest["hi"], "left")
    return found.select(*[F.coalesce("lo", node).alias(node) if c == node else c for c in rows.columns])


def _second_look(members: DataFrame, forest: DataFrame, tested: DataFrame, prints: DataFrame, block: int = 256) -> DataFrame:
    """Untested pairs between components of one bucket that sizes and sketches do not rule out."""
    placed = _roots(members.select("key", "rep", F.col("rep").alias("part")), "part", forest)
    sizes = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    mixed = mixed.where("all > most and all > 2").select("key", "main", F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("blocks"))
    slim = prints.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["rep"])
    inside = settled(join_facts(placed, mixed, ["key"]).join(slim, "rep"))
    rows = ("key", "block", "member", "part", "rep", "n", "sketch")
    others = inside.where("part != main").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("member", F.lit(False))
    all_members = inside.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("member", F.lit(True))
    dealt = others.select(*rows).unionAll(all_members.select(*rows)).repartition("key", "block").sortWithinPartitions("key", "block", "member")
    return in_streams(dealt, _meet, "a long, b long").distinct().join(tested, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    The (small) columns named in ``carry`` come along unchanged; rows of one doc_id are judged each by its own text.
    """
    texts = only(docs, "doc_id", "text")
    prints = settled(in_batches(only(docs, "doc_id", "text", *carry), functools.partial(_fingerprints, carry=carry), carried(docs, carry, _PRINTS)))
    full = prints.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    # Only one row of a class goes into the buckets: the copies of a text never meet there.
    chosen = full.groupBy("k1", "k2", "n_shingles").agg(F.min_by(F.struct("doc_id", "keys"), "doc_id").alias("row"))
    buckets = settled(chosen.select(F.col("row.doc_id").alias("rep"), F.explode("row.keys").alias("key")))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = settled(join_facts(buckets, shared, ["key"]))
    popular = met.groupBy("rep").agg(F.sum("n").alias("meets"))
    hubs = met.join(popular, "rep").groupBy("key").agg(F.max_by("rep", F.struct("meets", -F.col("rep"))).alias("hub"))
    members = met.select("key", "rep")
    held = settled(texts.hint("merge").join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id"))
    stars = join_facts(members, hubs, ["key"]).where("hub != rep").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    tested = settled(stars)
    links = settled(linked(tested, held))
    forest = star_forest(links)
    more = settled(linked(settled(_second_look(members, forest, tested, full)), held))
    named = _roots(classes.withColumnRenamed("rep", "c"), "c", forest)
    if not more.isEmpty():  # only the components that the new links join are left to settle
        named = _roots(named, "c", star_forest(_roots(_roots(more, "a", forest), "b", forest)))
    joined = join_facts(prints.select("doc_id", "n_shingles", "k1", "k2", *carry), named, ["k1", "k2", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    judged = joined.select("doc_id", "n_shingles", component.alias("component_id"), *carry)
    return judged.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
