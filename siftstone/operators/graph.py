"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.sources.scratch import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected edge list (u, v).

    Random-order contraction: in each round every node hooks to the neighbour (or itself)
    whose keyed hash is lowest, edges are renamed to the hooked nodes, loops and repeats
    go.  A constant share of the nodes goes in each round, so rounds grow with the
    logarithm of the largest component, whatever its shape.  Each round's tables are
    written in the shared folder; nothing is collected but whether edges are left.  The
    root is one node of the component, not a particular one.
    """
    edges = cut(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    names = cut(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node")), "cc-names")
    turn = 0
    while not edges.isEmpty():
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))

        def rank(c: str):
            return F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: B023

        best = both.groupBy("u").agg(F.min(rank("v")).alias("best"))
        hook = cut(best.select("u", F.least(F.col("best"), rank("u")).getField("n").alias("to")), "cc-hook")
        left = edges.join(hook, "u").select(F.col("to").alias("a"), F.col("v"))
        ends = left.join(hook.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        fresh = cut(ends.where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "cc-edges")
        moved = cut(
            names.join(hook.select(F.col("u").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "cc-names"
        )
        for old in (edges, names, hook):
            drop(old)
        edges, names, turn = fresh, moved, turn + 1
    drop(edges)
    return names
