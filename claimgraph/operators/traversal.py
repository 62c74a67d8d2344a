"""Walks over edges (subject, object) in either direction, from a small set of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.shared import written

#: Nodes of a layer up to which it is broadcast to the edges; a larger one is joined by key.
BROADCAST_NODES = 200_000


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_NODES else df


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes other than the seeds (node) that a walk of at most `depth` edges gets to, with the least number of
    edges. Edges are written once by the caller; each step scans them, which moves nothing but the layer."""
    layer, out = seeds.select("node").distinct(), None
    seen = written(layer.withColumn("depth", F.lit(0)), "reach")
    for d in range(1, depth + 1):
        n = layer.count()
        ahead = edges.join(_small(layer, n), F.col("subject") == F.col("node")).select(F.col("object").alias("next"))
        back = edges.join(_small(layer, n), F.col("object") == F.col("node")).select(F.col("subject").alias("next"))
        known = seen.select(F.col("node").alias("next"))
        fresh = written(ahead.union(back).where("next IS NOT NULL").distinct().join(known, "next", "left_anti").select(F.col("next").alias("node"), F.lit(d).alias("depth")), "reach")
        seen = seen.unionByName(fresh)
        out = fresh if out is None else out.unionByName(fresh)
        layer = fresh.select("node")
    return out


def ranked(edges: DataFrame, seeds: DataFrame, depth: int = 2, k: int = 20, per_hop: float = 0.6) -> DataFrame:
    """(node, depth, score, total_reachable): the k best nodes of `reach`, damped by how many edges point at them; in-degrees are
    counted for reached nodes only."""
    near = written(reach(edges, seeds, depth), "near")
    total = near.count()
    into = edges.join(_small(near.select("node"), total), F.col("object") == F.col("node")).groupBy("node").agg(F.count(F.lit(1)).alias("into"))
    score = F.round(F.pow(F.lit(per_hop), F.col("depth")) / (1 + F.log(1 + F.coalesce("into", F.lit(0)).cast("double"))), 6)
    return near.join(into, "node", "left").select("node", "depth", score.alias("score"), F.lit(total).cast("long").alias("total_reachable")).orderBy(F.col("score").desc(), "node").limit(k)
