"""Bounded breadth-first searches over edge tables (columns src, dst).

Each level is one distributed join of the frontier with the edges, less what has been seen. A level is written to the
shared folder, so the plan stays short and a lost executor costs a reread; a frontier of a checked, small size is
broadcast, a larger one shuffled. Null ends of edges are no nodes. Empty tables and depths under 1 give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.storage import cut

#: A frontier of at most so many nodes is broadcast.
SMALL = 200_000


def sent(df: DataFrame, small: int = SMALL) -> DataFrame:
    """``df``, a table from ``cut``, marked for broadcasting if it is counted to be small."""
    return F.broadcast(df) if df.count() <= small else df


def levels(edges: DataFrame, seed: str, depth: int, forward: bool = False, stored: bool = False) -> DataFrame:
    """``node, depth`` of the nodes at distance 1 to ``depth``; against the edges' direction unless ``forward``. The
    seed isn't among them. Edges that aren't a ``stored`` table are written once, not made anew for each level."""
    spark = edges.sparkSession
    a, b = ("src", "dst") if forward else ("dst", "src")
    links = edges.where("src is not null and dst is not null").select(F.col(a).alias("a"), F.col(b).alias("b"))
    links = links if stored or depth < 2 else cut(links, "edges")
    seen = spark.createDataFrame([(seed, 0)], "node string, depth int")
    frontier = seen
    for k in range(1, depth + 1):
        met = links.join(sent(frontier).select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        frontier = cut(met.join(seen.select("node"), "node", "left_anti").select("node", F.lit(k).alias("depth")), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def reaching(edges: DataFrame, seed: str, depth: int = 1, stored: bool = False) -> DataFrame:
    """``symbol``: nodes with a path of length 1 to ``depth`` to the seed; the seed itself if it is on such a cycle."""
    near = levels(edges, seed, depth, stored=stored)
    if depth < 1:
        return near.select(F.col("node").alias("symbol"))
    # the seed lies on a cycle of at most this length if it calls itself or a node that reaches it one step sooner
    before = near.where(F.col("depth") < depth).select("node").unionByName(edges.sparkSession.createDataFrame([(seed,)], "node string"))
    own = edges.where(F.col("src") == seed).join(before.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.lit(seed).alias("symbol")).distinct()
    return near.select(F.col("node").alias("symbol")).unionByName(own)


def who_calls(edges: DataFrame, symbol: str, depth: int = 1, stored: bool = False) -> DataFrame:
    return reaching(edges, symbol, depth, stored)


def blast_radius(edges: DataFrame, symbol: str, max_depth: int = 3, stored: bool = False) -> DataFrame:
    """``symbol, depth`` by least distance."""
    return levels(edges, symbol, max_depth, stored=stored).select(F.col("node").alias("symbol"), "depth")


def dependency_chain(deps: DataFrame, path: str, max_depth: int = 5, stored: bool = False) -> DataFrame:
    """``target, depth`` by least distance along the dependencies."""
    return levels(deps, path, max_depth, forward=True, stored=stored).select(F.col("node").alias("target"), "depth")
