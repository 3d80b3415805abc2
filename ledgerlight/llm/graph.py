"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.store import Scratch, gathered


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that edges reach) for each node that has an edge to another one.

    edges: a, b (long); direction, repeats, loops and nulls don't matter. Large-star and small-star steps alternate until
    every component is a star around its least node. Each step is a grouped minimum, partly made before its shuffle and kept as
    a table, and a join of the edges with that table. So Spark knows the table's size: it broadcasts it where it is small, and
    can split the edges of a node that has very many where it isn't. The edges of each round are a table in the shared folder,
    and tables before it are dropped. Few edges are dealt to few tasks, as a round has many short steps. Raises RuntimeError if rounds don't suffice, rather than returning half-joined components.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.save(now, f"{name}-0")
    n = now.count()  # no step makes more rows than two for each edge
    for i in range(1, rounds + 1):
        if _stars(now, n):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy(F.col("u").alias("w")).agg(F.least("u", F.min("v")).alias("m")), f"{name}-{i}-a", 2 * n)
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = scratch.save(large.distinct(), f"{name}-{i}-b", 2 * n)
        least = scratch.save(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), f"{name}-{i}-c", 2 * n)
        small = large.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = scratch.save(small.distinct(), f"{name}-{i}", 2 * n)
        for old in (f"{name}-{i - 1}", *(f"{name}-{i}-{x}" for x in "abc")):
            scratch.drop(old)
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def _stars(edges: DataFrame, rows: int) -> bool:
    """Whether every node is either a centre or has one centre."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    odd = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)")
    return gathered(odd, 2 * rows).isEmpty()
