"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.shared import cut, dealt_anew, remove


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (u long, v long); component is its least node.

    Each round is two joins on the current star centres, so a node with very many
    links is only ever the key of a left side that adaptive execution splits.
    Rows with a null end, loops and repeats are ignored; no links, no rows. A
    result after ``rounds`` rounds without a fixed point raises an error; the
    number of rounds grows with the logarithm of the longest path.
    """
    pairs = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    pairs = cut(pairs, "links")
    state = _state(pairs)
    if not state[0]:
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        before, pairs = pairs, cut(_small_star(_large_star(pairs)), "links")
        remove(before)
        now = _state(pairs)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    centres = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least node around it."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = dealt_anew(both.groupBy("u").agg(F.min("v").alias("m")), "u")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and all below it that it links to are linked to the least of them."""
    pairs = pairs.distinct()
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    others = pairs.join(dealt_anew(least, "u"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
