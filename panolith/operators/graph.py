"""Connected components and orphans of graphs whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.session import discard, written


def _canonical(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger end `u` to its smaller end `v`; loops and nulls go."""
    return (
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


#: Edges per task of a round; rounds over few edges are few tasks and files.
TASK_EDGES = 100_000


def _signature(edges: DataFrame) -> tuple:
    """Count and content hash of the edges: equal before and after means nothing moved."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 64) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest node.

    Alternating large-star and small-star rounds: every round links each node's larger, then
    smaller neighbours to the smallest one, until the edges form stars. Minima are combined
    before each shuffle, and the joins that carry them back read written tables, so adaptive
    execution splits a hub. Only counts reach the driver. Edges with a null end and loops
    are ignored; repeated edges count once; an empty input gives an empty result.
    """
    now = written(_canonical(edges.select(F.col(u).alias("u"), F.col(v).alias("v"))), "edges")
    was = None
    for _ in range(rounds):
        mark = _signature(now)
        if mark == was:
            break
        was = mark
        few = lambda df, n=max(1, -(-mark[0] // TASK_EDGES)): df.coalesce(n)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))), "large")
        large = written(
            few(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")),
            "large_star",
        )
        lower = written(few(large.groupBy("u").agg(F.min("v").alias("m"))), "small")
        hooked = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(few(_canonical(hooked.unionByName(lower.select("u", F.col("m").alias("v"))))), "edges")
        for old in (now, least, large, lower):
            discard(old)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def orphans(nodes: DataFrame, edges: DataFrame, node: str = "node", u: str = "u", v: str = "v") -> DataFrame:
    """The nodes that no edge touches; a loop is no link."""
    linked = edges.where(F.col(u) != F.col(v)).select(F.explode(F.array(u, v)).alias(node)).distinct()
    return nodes.join(linked, node, "left_anti")
