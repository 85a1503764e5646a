"""Connected components of a link table by alternating star contraction.

Each round is two grouped minima joined back to the links. The minima are written before the join: the
links are then shuffled for the join alone, and a node with very many links, which repeats on one side only,
is split at run time.
Rounds are cut by a written table, so a lost executor never replays earlier rounds. The minima of a round also
tell whether the links are stars already, which ends the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import settled


def _sides(links: DataFrame, large: bool) -> DataFrame:
    """(u, v): the neighbours that a step looks at, all of a node or the smaller ones."""
    down = links.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    return down.unionAll(links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))) if large else down


def _least(links: DataFrame, large: bool) -> DataFrame:
    """(u, m, knot): the smallest of a node and its neighbours; whether it has a smaller neighbour and yet another one."""
    knot = (F.min("v") < F.col("u")) & (F.min("v") < F.max("v"))
    return settled(_sides(links, large).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), knot.alias("knot")))


def _stars(links: DataFrame, large: bool, least: DataFrame | None = None) -> DataFrame:
    """Links (hi, lo), lo < hi, some of them repeated: hang every neighbour on the smallest one.

    The large step moves the larger neighbours of a node, the small step the smaller ones.
    """
    least = _least(links, large) if least is None else least
    joined = _sides(links, large).join(least, "u")
    moved = joined.where(F.col("v") > F.col("u")) if large else joined.where(F.col("v") != F.col("m"))
    out = moved.select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    if not large:
        out = out.unionAll(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return out.where("hi > lo")


def star_forest(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(hi, lo), written: every node of ``links`` (a, b) that is not the smallest it can reach, with that one.

    Links are a forest of stars as soon as no node has a smaller neighbour and yet another one. The minima
    of the next round's large step show it, so no round is spent on finding that nothing changes.
    """
    now = settled(
        links.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    )
    for done in range(most_rounds):
        least = _least(now, True)
        if not least.agg(F.bool_or("knot")).first()[0]:
            return now if done else settled(now.distinct())
        now = settled(_stars(_stars(now, True, least), False).distinct())
    raise RuntimeError("components did not settle")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``links`` (a, b): the smallest id that can be reached.

    Links with a null end and links of a node with itself add nothing. An empty table gives no rows.
    """
    now = star_forest(links, most_rounds)
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(
        now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    )
