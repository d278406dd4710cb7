"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.storage import cut, discard


def components(edges: DataFrame, rounds: int = 40, small: int = 1_000_000) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b of type long); the root is the component's least node.

    Each round is two joins; a component of diameter d needs about log d of them. Minima are taken before rows are
    sent, and they are sent to the edges while there are at most ``small`` edges, so a node with very many edges is no
    task's burden; beyond, skewed joins are split by the adaptive planner. No edges give no rows."""
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    mark = None
    side = F.broadcast if now.count() <= small else lambda df: df
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(side(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = cut(large, "star")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(side(down), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).where("a != b")
        after = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
        told = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        discard(large)
        discard(now)
        now = after
        if mark == told:
            break
        mark = told
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
