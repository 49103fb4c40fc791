"""Connected components of an edge table that no single machine need hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import forget, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are hung on the smallest node that it sees."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung on the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v) that is not its component's least; root is the least.

    Large-star and small-star rounds by turns, which end after a logarithmic number of
    rounds; each round is written to the shared folder.  Loops, repeated edges
    and rows with nulls are dropped; no edges give no rows.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        stars = now.groupBy("u").count().where("count > 1").select("u")
        deep = now.alias("a").join(now.alias("b"), F.col("a.v") == F.col("b.u"), "left_semi").select("a.u")
        if stars.union(deep).isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large = _large_star(now).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        large, before = materialise(large, "large"), now
        now = materialise(_small_star(large).where("u <> v").distinct(), "edges")
        forget(large, before)
