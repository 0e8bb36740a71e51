"""Connected components by alternating large-star and small-star steps.

Every step is two map-side combined minima and two joins on the node; the edge list never
leaves the executors. A node with very many neighbours is a skewed join key, which adaptive
execution splits; its minimum is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotable.llm.storage import Scratch


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node that has an edge; component is its smallest node.

    Nodes may be of any type that has an order. Null ends and self-loops are ignored; repeated edges
    count once. No edges: no rows.
    """
    pair = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    now = scratch.save(pair.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(hung.union(least.select("u", F.col("m").alias("v"))).distinct())
        then = _mark(after)
        scratch.drop(now)
        now, mark, before = after, then, mark
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
