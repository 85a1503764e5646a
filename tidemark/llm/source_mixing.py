"""Mixing sources to target weights by Pareto order sampling.

Method. Each source gets a target in words: its share of the whole by weight, stopped at ``most`` times what
it holds, the excess shared again by weight until no target is above. Within a source a document's
expected copies are proportional to its merit (all alike without a merit column), scaled so that the
words expected are the target, and ``most`` at most. The whole part of the expected copies is certain. For
the rest, of probability p, documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and the first ones are taken until the words left to the target are filled
(a sample of fixed size in words). Documents of more than a tenth of the words to fill are ranked and taken
first against their own part of the target, then those of more than a hundredth, then the others, and each
class makes up for what the one before took too much or too little. So a source ends within half a document
of its last class, as a rule a two-hundredth of what was to be filled.
u comes from a hash of doc_id and text, so reruns agree.

Scale. Only (source, size, rank) rows are sorted, never texts. Running sums of words are those of
``operators.ordered`` (range-partitioned pieces and offsets), so a source may hold any part of the rows; facts
per source are written before they are joined, so that a hot source is split at run time. Sources are
numbered by the same pieces. Shares are settled in rounds of one aggregate over the table of sources.

Defined cases. A null text has size 0. A null source is a source, the last one. Sources without words have
target 0; documents of size 0 take nothing. Merits that are null, negative or not finite count as 0, and
the words they leave go to the others of the source; a source whose merits are all 0 is treated as if it
had none. Rows with the same doc_id and text share their random number; they are chosen one by one. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import settled
from tidemark.operators.ordered import attach, ladder, number_rows

WORD = r"[^\x20\x09-\x0D]+"
CLASSES = (0.1, 0.01, 0.0)


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for rows (source, source_size), one for each source."""
    by_name = [F.col("source").isNull(), F.col("source")]  # strings compare by their UTF-8 bytes: by code point
    numbered = number_rows(sizes, [], by_name, "nth")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    table = settled(numbered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("ceiling")))
    whole = table.agg(F.sum("source_size").alias("n")).first().n or 0
    level, full = 0.0, -1
    while True:
        # Sources whose ceiling the present level reaches are full; the others share the rest by weight.
        stopped = F.col("weight") * F.lit(level) >= F.col("ceiling")
        facts = table.agg(F.count(F.when(stopped, 1)).alias("full"), F.sum(F.when(stopped, F.col("ceiling"))).alias("held"), F.sum(F.when(~stopped, F.col("weight"))).alias("weight")).first()
        if facts.full == full or not facts.weight:
            break
        full, level = facts.full, (share * whole - (facts.held or 0.0)) / facts.weight
    return table.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("ceiling")).alias("target"))


def _with_copies(rows: DataFrame, facts: DataFrame, most: float) -> DataFrame:
    """Rows with ``copies`` expected: merit times a factor of their source, ``most`` at most."""
    merits = rows.groupBy("source").agg(F.sum(F.col("merit") * F.col("size")).alias("mass"))
    even = F.when(F.col("mass") > 0, F.col("mass")).otherwise(F.col("source_size"))
    state = settled(attach(facts, merits, ["source"]).select("source", "source_size", "target", (F.col("mass") > 0).alias("by_merit"), F.try_divide("target", even).alias("factor")))
    merit = F.when(F.col("by_merit"), F.col("merit")).otherwise(1.0)
    seen = -1
    while True:
        placed = attach(rows, state, ["source"]).withColumn("copies", F.coalesce(F.least(merit * F.col("factor"), F.lit(float(most))), F.lit(0.0)))
        if not rows.where("merit != 1").head(1):
            return placed  # all alike: no document can reach the limit before its source does
        at_most = F.col("copies") >= most
        sums = placed.groupBy("source").agg(F.count(F.when(at_most, 1)).alias("capped"), F.sum(F.when(at_most, F.col("size"))).alias("held"), F.sum(F.when(~at_most, merit * F.col("size"))).alias("free"))
        sums = settled(sums)
        capped = sums.agg(F.sum("capped").alias("n")).first().n
        if capped == seen or capped is None:
            return placed
        seen = capped
        left = F.col("target") - F.coalesce(F.col("held"), F.lit(0)) * most
        state = settled(attach(state, sums, ["source"]).select("source", "source_size", "target", "by_merit", F.when(F.col("free") > 0, left / F.col("free")).otherwise(F.col("factor")).alias("factor")))


def _first_words(rows: DataFrame, room: DataFrame) -> DataFrame:
    """Of rows (source, rank, at, size) those that, in order of rank, bring a source nearest to its room in words."""
    climbed = ladder(rows, ["source"], "rank", {"words": F.sum("size")})
    steps = attach(settled(climbed), room, ["source"])
    before = F.col("words_upto") - F.col("words")
    # The step that crosses the room counts if at least half of it lies inside.
    return steps.where(F.col("room") - before >= F.col("words") / 2).select("source", "rank", "words")


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, merit: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs`` (doc_id, text, source)."""
    if not 0 <= share <= most:
        raise ValueError("the mix cannot be larger than `most` times what there is")
    good = F.lit(1.0) if merit is None else F.when((merit > 0) & (merit < float("inf")), merit.cast("double")).otherwise(0.0)
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("mix")), 12)  # 52 bits: never 0 or 1 below
    rows = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), ((bits + F.lit(0.5)) / F.lit(2.0**52)).alias("u"), good.alias("merit"))
    rows = settled(rows)
    sizes = settled(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    placed = _with_copies(rows, settled(targets(sizes, weights, share, most)), most)
    sure = F.floor(F.col("copies") + F.lit(1e-12))
    chance = F.greatest(F.col("copies") - sure, F.lit(0.0))
    ranked = settled(placed.select("doc_id", "source", "size", "source_size", "target", sure.alias("sure"), chance.alias("chance"), "u"))

    drawn = ranked.where("chance > 0 and size > 0")
    wanted = settled(drawn.groupBy("source").agg(F.sum(F.col("chance") * F.col("size")).alias("wanted")))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance")))
    # Equal random numbers (repeated rows) are told apart by their place in the written table.
    rank = F.struct(odds.alias("odds"), F.monotonically_increasing_id().alias("mark"))
    size_class = sum((F.col("size") <= F.col("wanted") * part).cast("int") for part in CLASSES)
    drawn = settled(attach(drawn.withColumn("rank", rank), wanted, ["source"]).withColumn("class", size_class))
    parts = settled(drawn.groupBy("source", "class").agg(F.sum(F.col("chance") * F.col("size")).alias("part")))
    chosen = None
    for k in range(len(CLASSES)):
        room = parts.where(F.col("class") <= k).groupBy("source").agg(F.sum("part").alias("room"))
        if chosen is not None:
            got = chosen.groupBy("source").agg(F.sum("words").alias("got"))
            room = attach(room, got, ["source"], "left").select("source", (F.col("room") - F.coalesce("got", F.lit(0))).alias("room"))
        first = settled(_first_words(drawn.where(F.col("class") == k).select("source", "rank", "size"), settled(room)))
        chosen = first if chosen is None else chosen.unionAll(first)
    marked = attach(drawn.withColumn("mark", F.col("rank.mark")), chosen.select(F.col("rank.mark").alias("mark"), F.lit(1).alias("more")), ["mark"], "left")
    counted = marked.select("doc_id", "size", "source_size", "target", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("copies"))
    others = ranked.where("not (chance > 0 and size > 0)").select("doc_id", "size", "source_size", "target", F.col("sure").alias("copies"))
    return counted.unionAll(others).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
