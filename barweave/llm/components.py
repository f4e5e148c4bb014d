"""Connected components of a graph that is spread over the cluster.

Alternating large-star and small-star rounds (Kiveris et al., 2014): each is one grouped minimum and
a join, the number of edges never grows beyond the start, and the rounds needed grow with the
logarithm of the longest path. Only a count and a checksum per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round. edges: u > v, distinct."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    edges: two long columns; direction, repetition and loops don't matter, nulls are ignored. A node
    with many neighbours is no burden: minima are formed before the shuffle, and the joins are on keys
    that adaptive execution can split.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = stored(e, "edges")
    before = None
    for _ in range(rounds):
        e, last = stored(_star(_star(e, True), False), "edges"), e
        discard(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = tuple(now)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
