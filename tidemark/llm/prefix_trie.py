"""The trie of conversation prefixes from sorted paths: range minima over their common prefix lengths.

Method. A conversation is a path: one fixed-width step per turn, the digest of (role, text) and the number of
words, so that byte order puts equal prefixes next to each other. Equal paths are counted once, the distinct
ones sorted. Between neighbours stands the length of their common prefix (LCP), and a sparse table holds
the minima of all stretches of 2, 4, 8 ... LCPs. A prefix of depth d that begins at path i covers the paths
around i as far as no LCP below d lies between, and each candidate prefix finds its left and right end for
itself, by binary search on the sparse table; no stack, no order among prefixes. Members are then a sum of
copies over the interval, the smallest member a range minimum over ids, and leaves and words of the subtree
differences of running sums, since the nodes first seen in an interval stand together (preorder).

Scale. Sorted paths are cut into blocks of at most some thousand. A block knows the path before and the one after it, so
it can tell which prefixes it is the first to see and which paths go on. All it says about a prefix adds up
over blocks (counts, sums, minima), so prefixes that many blocks share, the root above all, are combined by a
map-side aggregate over their digests. The joins have a written table on each side, so a hot parent is split
at run time. Ids of the members that end at a node are range-partitioned by (node, id), written as stretches
of text and hashed one stretch after another: a group of any size passes through, never held as a whole.

Defined cases. A null conv_id names no conversation; such rows take no part. Null role or text is empty.
Turns of one number follow the order of their digests; null numbers come first; repeated rows are turns. An
empty table gives no rows. Extra columns are ignored. One conversation's path (20 bytes a turn) has to fit
into a task.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.frames import in_batches, in_streams, settled

STEP, DIGEST = 20, 16
BLOCK_PATHS, BLOCK_BYTES = 4096, 4 << 20
WORD = r"[^\x20\x09-\x0D]+"
_BLOCK = "part int, seq int, before binary, after binary, first binary, last binary, ends binary, copies binary, ids binary, steps binary"


def conversation_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, steps): the turns (conv_id, turn, role, text) of each conversation in order, as an array of steps."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.unhex(F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 8, "0"))
    steps = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.concat(digest, words).alias("step")).alias("at"))
    return steps.groupBy("conv_id").agg(F.sort_array(F.collect_list("at"))["step"].alias("steps"))


def with_shared_heads(paths: DataFrame, base: Column, head: Column) -> DataFrame:
    """(conv_id, path): the first ``head`` steps of conversation ``base``, then the own ones after the first ``head``.

    ``head`` is at most 3; a base that does not exist gives no steps.
    """
    own = paths.withColumn("base", base).withColumn("head", head)
    heads = paths.select(F.col("conv_id").alias("base"), F.slice("steps", 1, 3).alias("first"))
    first = F.slice(F.coalesce("first", F.array().cast("array<binary>")), F.lit(1), F.col("head"))
    rest = F.slice("steps", F.col("head") + 1, F.size("steps"))
    return own.join(heads, "base", "left").select("conv_id", F.array_join(F.transform(F.concat(first, rest), F.hex), "").alias("path")).withColumn("path", F.unhex("path"))


def _common(a: bytes, b: bytes) -> int:
    """Steps that two paths share from the start."""
    n = min(len(a), len(b)) // STEP
    if a[: n * STEP] == b[: n * STEP]:
        return n
    x, y = (np.frombuffer(v, np.uint8, n * STEP).reshape(n, STEP) for v in (a, b))
    return int(np.argmax((x != y).any(1)))


def _blocks(most_paths: int, most_bytes: int) -> Callable:
    """Sorted rows (path, copies, id) of a partition as blocks; each knows its neighbours in the partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, numbers = TaskContext.get().partitionId(), itertools.count()
        before, paths, copies, ids, size = None, [], [], [], 0

        def block(after):
            ends = np.cumsum([len(p) for p in paths], dtype=np.int64)
            values = [part, next(numbers), before, after, paths[0], paths[-1], ends.tobytes(), np.array(copies, np.int64).tobytes(), np.array(ids, np.int64).tobytes(), b"".join(paths)]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 8]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["part", "seq", "before", "after", "first", "last", "ends", "copies", "ids", "steps"])

        for batch in batches:
            for path, n, i in zip(batch["path"].to_pylist(), batch["copies"].to_pylist(), batch["id"].to_pylist()):
                if len(paths) >= most_paths or paths and size + len(path) > most_bytes:
                    yield block(path)
                    before, paths, copies, ids, size = paths[-1], [], [], [], 0
                paths.append(path), copies.append(n), ids.append(i)
                size += len(path)
        if paths:
            yield block(None)

    return work


class SparseTable:
    """Minima of every stretch of 2**k values, for range minima in two looks."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 * (step := 1 << (len(self.rows) - 1)) <= len(values):
            self.rows.append(np.minimum(self.rows[-1][:-step], self.rows[-1][step:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The minimum of values[a:b], for a < b."""
        level = np.frexp((b - a).astype(float))[1] - 1
        out = np.empty(len(a), self.rows[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.rows[k][a[at]], self.rows[k][b[at] - (1 << k)])
        return out

    def right(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """For each start the first place at or after it whose value is below depth (or the end)."""
        at = start.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            fits = np.flatnonzero(at + (1 << k) <= len(self.rows[0]))
            fits = fits[row[at[fits]] >= depth[fits]]
            at[fits] += 1 << k
        return at

    def left(self, stop: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """For each stop the place after the last one before it whose value is below depth (or 0)."""
        at = stop.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            fits = np.flatnonzero(at - (1 << k) >= 0)
            fits = fits[self.rows[k][at[fits] - (1 << k)] >= depth[fits]]
            at[fits] -= 1 << k
        return at


_NODES = "node binary, parent binary, depth int, n long, id long, children long, leaves long, words long"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block knows of its prefixes; sums, minima and counts that add up over blocks."""
    for batch in batches:
        for x in batch.to_pylist():
            ends = np.frombuffer(x["ends"], np.int64)
            starts = np.concatenate(([0], ends[:-1]))
            paths = [x["steps"][a:b] for a, b in zip(starts, ends)]
            copies, ids = np.frombuffer(x["copies"], np.int64), np.frombuffer(x["ids"], np.int64)
            lengths = (ends - starts) // STEP
            # lcp[i]: steps shared by paths i and i + 1 of the block. New to the block are the prefixes of path i
            # deeper than lcp[i - 1], of the first path all; new at all are those deeper than what came before.
            lcp = np.array([_common(a, b) for a, b in zip(paths, paths[1:])], np.int64)
            shared = np.concatenate(([-1], lcp))
            known = shared.copy()
            known[0] = -1 if x["before"] is None else _common(x["before"], paths[0])
            follows = np.concatenate((lcp, [-1 if x["after"] is None else _common(paths[-1], x["after"])]))
            leaf = (follows < lengths).astype(np.int64)

            counts = lengths - shared
            base = np.concatenate(([0], np.cumsum(counts)))
            row = np.repeat(np.arange(len(paths)), counts)
            depth = np.arange(base[-1]) - base[row] + shared[row] + 1
            table = SparseTable(lcp)
            first, last = table.left(row, depth), table.right(row, depth)

            members = np.concatenate(([0], np.cumsum(copies)))
            n = members[last + 1] - members[first]
            least = SparseTable(ids).least(first, last + 1)
            leaves = np.concatenate(([0], np.cumsum(leaf)))
            leaves = leaves[last + 1] - leaves[first]

            cells = np.frombuffer(x["steps"], np.uint8).reshape(-1, STEP)
            own = cells[:, DIGEST:].copy().view(">u4").ravel().astype(np.int64)
            step = starts[row] // STEP + depth - 1
            words = np.where(depth > 0, own[np.maximum(step, 0)] if len(own) else 0, 0)
            fresh = depth > known[row]
            sums = np.concatenate(([0], np.cumsum(n * words - fresh * words)))
            at = np.arange(len(row))
            saved = sums[base[last + 1]] - sums[at]

            # The parent of a prefix: the one before it if that began on the same path, else the one that
            # covers the path from further left.
            up = np.where(depth - 1 > shared[row], at - 1, -1)
            far = np.flatnonzero((up < 0) & (depth > 0))
            origin = table.left(row[far], depth[far] - 1)
            up[far] = base[origin] + depth[far] - 1 - shared[origin] - 1
            children = np.bincount(up[fresh & (depth > 0)], minlength=len(row))

            keys = []
            for i, path in enumerate(paths):
                h = hashlib.md5(path[: max(shared[i], 0) * STEP])
                if shared[i] < 0:
                    keys.append(h.digest())
                for d in range(max(shared[i], 0), lengths[i]):
                    h.update(path[d * STEP : (d + 1) * STEP])
                    keys.append(h.digest())
            parents = [keys[u] if u >= 0 else None for u in up.tolist()]
            arrays = [pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), pa.array(depth.astype(np.int32))]
            arrays += [pa.array(v.astype(np.int64)) for v in (n, least, children, leaves, saved)]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "parent", "depth", "n", "id", "children", "leaves", "words"])


def _stretches(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (node, id) in order, as stretches of comma-joined ids of one node."""
    nodes, ids = batch["node"].to_pylist(), batch["id"].to_pylist()
    cuts = [i for i in range(1, len(nodes)) if nodes[i] != nodes[i - 1]]
    rows = [(nodes[a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip([0, *cuts], [*cuts, len(nodes)])]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))], ["node", "id", "listed"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, id, listed) in order: one SHA-256 for each node over its stretches."""
    now, digest = None, None
    for batch in batches:
        done = []
        for node, listed in zip(batch["node"].to_pylist(), batch["listed"].to_pylist()):
            if node != now:
                if digest:
                    done.append((now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(listed.encode())
            else:
                digest.update(b"," + listed.encode())
        yield _digests(done)
    if digest:
        yield _digests([(now, digest.hexdigest())])


def _digests(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])


def prefix_trie(conversations: DataFrame, block_paths: int = BLOCK_PATHS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per node for rows (conv_id, path), one for each conversation.

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    convs = settled(conversations)
    distinct = convs.groupBy("path").agg(F.count("*").alias("copies"), F.min("conv_id").alias("id"))
    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path")
    blocks = settled(in_streams(ordered, _blocks(block_paths, block_bytes), _BLOCK))
    # Only the first and last path of a partition have a neighbour elsewhere: as many rows as partitions.
    edges = blocks.groupBy("part").agg(F.min_by("first", "seq").alias("first"), F.max_by("last", "seq").alias("last"))
    along = Window.orderBy("part")
    edges = settled(edges.select("part", F.lag("last").over(along).alias("prior"), F.lead("first").over(along).alias("next")))
    placed = blocks.join(edges, "part").select("*", F.coalesce("before", "prior").alias("b"), F.coalesce("after", "next").alias("a"))
    placed = placed.select(F.col("b").alias("before"), F.col("a").alias("after"), "ends", "copies", "ids", "steps")
    partial = in_streams(placed, _nodes, _NODES)
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "words")]
    nodes = settled(partial.groupBy("node", "parent", "depth").agg(F.min("id").alias("id"), *sums))

    ended = convs.select(F.unhex(F.md5("path")).alias("node"), F.col("conv_id").alias("id")).repartitionByRange("node", "id").sortWithinPartitions("node", "id")
    stretches = in_batches(ended, _stretches, "node binary, id long, listed string")
    hashes = in_streams(stretches.repartition("node").sortWithinPartitions("node", "id"), _hashed, "node binary, ends_sha256 string")

    root = nodes.where("depth = 0").select("id").first()
    parents = nodes.where("children > 0").select(F.col("node").alias("parent"), F.col("id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(parents, "parent").select(*nodes.columns, "parent_conv_id")
    top = F.when(F.col("depth") == 1, F.lit(root.id if root else None).cast("long"))
    named = deep.unionAll(nodes.where("depth <= 1").select(*nodes.columns, top.alias("parent_conv_id"))).join(hashes, "node", "left")
    return named.select(
        F.col("id").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("words").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
