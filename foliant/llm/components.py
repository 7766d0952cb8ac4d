"""Connected components over an edge table, by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import keep


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``); the root is the least node of the component.

    Union-find without a driver-side forest: in a round each node and its neighbours are hung below the least of
    them, first from the larger side, then from the smaller. Each round is written to the shared folder; the
    number of rounds grows with the logarithm of the longest path. It ends when a round changes no edge.
    """
    e = keep(_edges(edges.where("a is not null and b is not null and a <> b"), "a", "b"), "edges")
    mark = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        # Large star: every larger neighbour hangs below the least of the node and its neighbours.
        large = e.select(F.col("a").alias("n"), F.col("b").alias("x")).union(e.select(F.col("b").alias("n"), F.col("a").alias("x"))).where("x > n")
        large = large.join(low.withColumnRenamed("a", "n"), "n").select(F.col("x").alias("a"), F.col("m").alias("b"))
        large = keep(_edges(large, "a", "b"), "large-star")
        # Small star: a node and its smaller neighbours hang below the least of those.
        least = keep(large.groupBy("a").agg(F.min("b").alias("m")), "least-small")
        small = large.join(least, "a").select(F.col("b").alias("x"), F.col("m"), "a")
        hung = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        e = keep(_edges(hung, "a", "b"), "small-star")
        sums = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        now = (sums["n"], sums["h"])
        if now == mark or not sums["n"]:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b"))).distinct()


def _edges(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges from the larger node to the smaller one, without loops."""
    return df.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
