"""Connected components by alternating star contractions, each round cut from its lineage.

Repeated edges count once, loops and edges with a null end not at all; nodes without an edge do not appear. The
root is the least node, so ties cannot occur. No edges give an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.store import cut, lookup_join


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least neighbour of u, joined so that hubs do not meet in one task."""
    total = edges.count()
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return lookup_join(edges, least, ["u"], "n", total, F.col("v"), how="inner")


def components(edges: DataFrame, a: str, b: str, *, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the least node of its component."""
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    before = _print(now)
    for _ in range(most_rounds):
        both = cut(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = cut(_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u > v").distinct())
        known = _least(large)
        small = known.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(known.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
        after = _print(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
