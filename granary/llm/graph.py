"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each half-round is an aggregate of minima and a join on the node, both of which
tolerate a node of very high degree: minima combine before the shuffle, and they are
written before the join, so both its sides come from plain shuffles and adaptive
execution splits the node's rows. No group of neighbours is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.storage import Scratch


def _stars(edges: DataFrame, large: bool, scratch: Scratch, label: str) -> DataFrame:
    """edges: a > b, distinct."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        least = scratch.save(least, f"{label}-least")
        out = near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select("a", "b", "m")
        out = out.select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b"))
    return out.where("a > b").distinct()


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, root): root is the least node of the component; lone nodes do not appear.

    edges: columns a and b of one orderable type, in any direction, repeats and
    loops allowed, no nulls. An empty table gives an empty table.
    """
    kept = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-0")
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
    seen, turn = mark(kept), 0
    while seen[0]:
        turn += 1
        kept = scratch.save(_stars(_stars(kept, True, scratch, label), False, scratch, label), f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}")
        now = mark(kept)
        if now == seen:
            break
        seen = now
    root = kept.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return root.unionByName(kept.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
