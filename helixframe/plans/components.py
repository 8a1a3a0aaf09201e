"""Connected components of a graph given by its edges, by alternating large and small stars.

Every round joins written tables only, so each side of a join comes straight from an exchange and adaptive execution
can split a node with very many edges; minima are combined before they are shuffled. No part of the graph is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.plans.storage import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for each node that is not the smallest of its component; the others are their own component.

    ``edges`` may hold loops, repeated and reversed edges and nulls (which link nothing). Ids are integers.
    """
    first, second = F.col(a).cast("long"), F.col(b).cast("long")
    clean = edges.where(first.isNotNull() & second.isNotNull() & (first != second))
    now = materialize(clean.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b")).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if state[0] == 0:
            break
        both = now.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(now.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = materialize(now.join(least, now.b == least.u).select("a", F.col("m").alias("b")).distinct(), "large")
        least_below = materialize(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "below")
        moved = large.join(least_below, large.a == least_below.u).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = materialize(moved.unionByName(least_below.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "small")
        old, before = now, state
        now, state = small, _state(small)
        for table in (old, least, large, least_below):
            discard(table)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found._helixframe_path = now._helixframe_path  # for discard()
    return found
