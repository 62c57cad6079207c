"""Connected components by alternating large and small stars; nothing but numbers moves, and nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import pin


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"] or 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to its smallest neighbour, or to itself if that is smaller."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = pin(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the smallest of them."""
    least = pin(edges.groupBy("hi").agg(F.min("lo").alias("m")))
    tied = edges.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return tied.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns); root is the smallest node that can be reached.

    A hub, as the centre of a large component becomes one, is a hot key: both sides of the joins are shuffled directly from
    pinned tables, so that adaptive execution splits it. The rounds grow with the logarithm of the longest chain.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    edges = pin(links.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        edges = pin(_small_star(pin(_large_star(edges))))
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
