"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.storage import discard, written


def _links(u, v) -> list:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links`` (two long columns ``a, b``).

    Each round lets every node point to its smallest neighbour, follows the
    pointers a few steps and merges what points to the same node. Nodes are
    compared by a hash, which tells all 64-bit numbers apart, so chains in order
    of their ids shrink like others; the rounds grow with the logarithm of the longest path. ``component`` is
    the hash that a component's nodes agree on. Nothing is gathered by
    component: only minima and joins, which split a crowded key.

    An empty table of links gives an empty result; links of a node with itself
    give that node a component of its own.
    """
    ends = written(links.select("a", "b"))
    left = written(ends.select(*_links(F.xxhash64("a"), F.xxhash64("b"))).distinct())
    labels = written(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.xxhash64("node").alias("component")))
    discard(ends)
    for _ in range(most_rounds):
        going = left.where("u <> v")
        if going.isEmpty():
            discard(left)
            return labels
        both = going.union(going.select("v", "u"))
        nearest = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")))
        point = nearest
        for _ in range(2):
            after = point.select(F.col("u").alias("to"), F.col("to").alias("then"))
            point = point.join(after, "to").select("u", F.col("then").alias("to"))
        point = written(point)
        at_u = going.join(point, "u").select(F.col("to").alias("new_u"), F.col("v").alias("u"))
        both_ends = at_u.join(point, "u").select(*_links(F.col("new_u"), F.col("to")))
        shorter = written(both_ends.distinct())
        moved = point.select(F.col("u").alias("component"), F.col("to").alias("new"))
        merged = written(labels.join(moved, "component", "left").select("node", F.coalesce("new", "component").alias("component")))
        # All that follows is written itself.
        discard(left, nearest, point, labels)
        left, labels = shorter, merged
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
