"""Connected components of an edge table, by repeated star contraction.

Every round is a few joins and grouped minima. Edges, labels and components never reach the
driver; it sees two counts a round. Each round is written to the shared folder,
so lineage stays short and a lost executor costs one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.llm.common import discard, materialize

#: A node with more than this share of all edges is a hub.
HUB = 1 / 1024


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """(v, m): ``edges`` (u, v) beside the m of ``least`` (u, m, n) for their u, where n counts u's edges.

    Of ``total`` edges, with two ends each, at most 2,048 nodes are hubs. Their rows are broadcast, and
    their edges, which find nothing more in the join, are spread by v; of every other node at most one
    edge in 1,024 meets in a task. Its place is no constant to Spark, or it would join by u alone."""
    hub = F.col("n") > total * HUB
    hubs = F.broadcast(least.filter(hub).select("u", F.col("m").alias("hub_m")))
    found = edges.join(hubs, "u", "left").withColumn("place", F.when(F.col("hub_m").isNotNull(), F.xxhash64("v")).otherwise(0))
    rest = least.filter(~hub).select("u", F.when(F.col("n") > 0, F.lit(0).cast("long")).alias("place"), "m")
    return found.join(rest, ["u", "place"], "left").select("v", F.coalesce("hub_m", "m").alias("m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    above = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.union(above).groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(above, least, total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(edges, least, total).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple[int | None, int]:
    """(edges, nodes that keep them from being stars: those below several nodes, or both below and above)."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return tuple(nodes.agg(F.sum("below"), F.count(F.when(F.col("below") + F.col("above") > 1, 1))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): each node of an edge and the smallest node that it can reach.

    Nodes may be of any orderable type. Loops and repeated edges do no harm, edges with a null
    end are left out, and nodes without an edge to another node are not in the result. No edges
    give an empty table."""
    edges = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialize(edges, "edges")
    while True:
        total, unsettled = _state(edges)
        if not unsettled:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        new = materialize(_small_star(_large_star(edges, total), total), "edges")
        discard(edges)
        edges = new
