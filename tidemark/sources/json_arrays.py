"""Large JSON documents over many lines, read in parallel.

The built-in reader gives a file that holds one array to one task. A JSON string holds no raw line break, so every line
starts outside of strings, and the text scan, which splits files by bytes at line ends, can be used as it is:

1. each split of a file counts how far its brackets go up or down, one row per split;
2. running sums over the splits of a file give the depth at which each split starts;
3. a second scan cuts the elements out of each split. What an element has in several splits (two ends at
   most per split, or a split that lies inside an element) is put together by its number in the file;
4. ``from_json`` parses the elements where they are.

A file with no line break inside its array is one line, and so one task, as before.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.storage import settled

# Workers receive the functions of this module by value, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT = ["path", "start", "length"]
# Facts per split (some 150 bytes each) are broadcast up to this many; beyond it lines are shuffled to them.
MOST_BROADCAST = 100_000
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True


def _marks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """+1 and -1 at the brackets outside of strings, and where the bytes of strings are."""
    slashes = np.flatnonzero(text == 0x5C)
    quotes = text == 0x22
    if len(slashes):
        first = np.r_[True, np.diff(slashes) > 1]  # runs of backslashes: every other one escapes what follows
        run = slashes - np.maximum.accumulate(np.where(first, slashes, 0))
        escaped = slashes[run % 2 == 0] + 1
        quotes[escaped[escaped < len(text)]] = False
    inside = np.cumsum(quotes) % 2 == 1
    step = np.zeros(len(text), np.int64)
    step[(text == 0x5B) | (text == 0x7B)] = 1
    step[(text == 0x5D) | (text == 0x7D)] = -1
    step[inside] = 0
    return step, inside | quotes


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    """(fields of the split, text) for consecutive lines of one split; lines end in a line break again."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.to_pydict()
        splits = list(zip(*[rows[c] for c in SPLIT]))
        ends = [i for i in range(1, len(splits)) if splits[i] != splits[i - 1]] + [len(splits)]
        at = 0
        for end in ends:
            yield {n: rows[n][at] for n in rows if n != "line"}, b"\n".join(rows["line"][at:end]) + b"\n"
            at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per piece: how the depth changes, and the first byte that is not blank."""
    for split, text in _pieces(batches):
        text = np.frombuffer(text, np.uint8)
        solid = np.flatnonzero(~_BLANK[text])
        first = chr(text[solid[0]]) if len(solid) else None
        yield pa.RecordBatch.from_pylist(
            [{**split, "climb": int(_marks(text)[0].sum()), "first": first}],
            pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("climb", pa.int64()), ("first", pa.string())]),
        )


_CUT = "path string, start long, place int, whole boolean, opens boolean, text binary"
_CUT_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("place", pa.int32()), ("whole", pa.bool_()), ("opens", pa.bool_()), ("text", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of each split; those that cross its borders as parts (place 0 from before, 1 into the next)."""
    now, depth, base, kept, opened = None, 0, 0, [], False

    def left_over() -> list[dict]:
        part = b"".join(kept)
        return [{"path": now[0], "start": now[1], "place": int(opened), "whole": False, "opens": opened, "text": part}] if part else []

    for split, text in _pieces(batches):
        out = []
        name = tuple(split[c] for c in SPLIT)
        if name != now:
            if now is not None:
                out += left_over()
            if split["depth"] is None and split["start"] > 0 or split["head"] is None:
                raise RuntimeError("the splits of a file changed between two scans; run the query again")
            now, depth, base, kept, opened = name, split["depth"] or 0, int(split["head"] == "["), [], False
        data = np.frombuffer(text, np.uint8)
        step, in_string = _marks(data)
        at_depth = depth + np.cumsum(step)
        begins = np.flatnonzero((step == 1) & (at_depth == base + 1))
        ends = np.flatnonzero((step == -1) & (at_depth == base))
        between = (at_depth == base) & (step == 0) & ~_BLANK[data] & (data != 0x2C)
        between |= (at_depth == base) & in_string
        if between.any() or (at_depth < 0).any():
            raise ValueError(f"{now[0]}: not an object or an array of objects")
        if depth > base:  # within an element: its end, or all of this piece, belongs to it
            end = ends[0] + 1 if len(ends) else len(text)
            kept.append(text[:end])
            if len(ends):
                if opened:
                    out.append({"path": now[0], "start": now[1], "place": 0, "whole": True, "opens": True, "text": b"".join(kept)})
                else:
                    out += left_over()
                kept, ends = [], ends[1:]
        for b, e in zip(begins, ends):
            out.append({"path": now[0], "start": now[1], "place": 0, "whole": True, "opens": True, "text": text[b : e + 1]})
        if len(begins) > len(ends):
            kept, opened = [text[begins[-1] :]], True
        elif not kept:
            opened = False
        depth = int(at_depth[-1])
        if out:
            yield pa.RecordBatch.from_pylist(out, _CUT_ARROW)
    if now is not None and (last := left_over()):
        yield pa.RecordBatch.from_pylist(last, _CUT_ARROW)


def json_elements(spark: SparkSession, path: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(path, text) for each object of the files: the elements of a top-level array, or the object that a file is.

    Anything else at the top (numbers, strings, nested arrays' neighbours) is an error, and so is a file that closes more
    brackets than it opens or never closes its last one. Empty and blank files have no elements.
    """
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length")]
    lines = spark.read.text(path).select(*meta, F.col("value").cast("binary").alias("line"))
    parts = lines.mapInArrow(_counted, "path string, start long, length long, climb long, first string")
    # A split's first byte that is not blank is that of its earliest piece; only the file's first one matters, and at
    # depth 0 before it, every later bracket lies deeper, so blank pieces are the only ones that can precede it.
    numbered = parts.withColumn("nth", F.monotonically_increasing_id())
    splits = settled(numbered.groupBy(*SPLIT).agg(F.sum("climb").alias("climb"), F.min_by("first", F.when(F.col("first").isNotNull(), F.col("nth"))).alias("first")))
    in_file = Window.partitionBy("path").orderBy("start")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    whole = in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    facts = settled(
        splits.select(
            *SPLIT,
            F.coalesce(F.sum("climb").over(before), F.lit(0)).alias("depth"),
            F.coalesce(F.first("first", ignorenulls=True).over(whole), F.lit(" ")).alias("head"),
            F.sum("climb").over(whole).alias("rest"),
        )
    )
    unclosed = facts.where("rest <> 0").select("path").head()
    if unclosed:
        raise ValueError(f"{unclosed.path}: brackets do not match")
    facts = facts.drop("rest")
    if facts.count() <= most_broadcast:
        told = lines.join(F.broadcast(facts), SPLIT, "left")
    else:  # lines keep the order of their split by number
        told = lines.withColumn("nth", F.monotonically_increasing_id()).join(facts, SPLIT, "left")
        told = told.repartition(*SPLIT).sortWithinPartitions(*SPLIT, "nth").drop("nth")
    cut = told.select(*SPLIT, "depth", "head", "line").mapInArrow(_cut, _CUT)
    cut = settled(cut)
    # Parts of elements: two per split at most, so a window over the parts of a file stays small.
    in_order = Window.partitionBy("path").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = cut.where("not whole").withColumn("element", F.sum(F.col("opens").cast("int")).over(in_order))
    in_row = F.array_sort(F.collect_list(F.struct("start", "place", "text")))
    joined = numbered.groupBy("path", "element").agg(F.aggregate(in_row, F.lit(b""), lambda text, p: F.concat(text, p["text"])).alias("text"))
    return cut.where("whole").select("path", "text").unionByName(joined.select("path", "text")).withColumn("text", F.col("text").cast("string"))


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType | str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Rows of the given schema from files that hold an object or an array of objects over many lines (UTF-8).

    Gives the rows of the built-in reader with ``multiLine``, from as many tasks as the bytes need.
    """
    return json_elements(spark, path, most_broadcast).select(F.from_json("text", schema).alias("row")).select("row.*")
