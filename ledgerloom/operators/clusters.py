"""Clusters of related facts: connected components of relation edges, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.storage import materialize


def clusters(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, cluster_id): the smallest id that each end of ``edges`` (a, b) reaches; ``nodes`` (id) adds those without edges.

    Every node's larger neighbours are linked to the smallest node of its neighbourhood, then every node's
    smaller ones, until no edge changes; the number of rounds grows with the logarithm of the longest path, so cycles and
    long chains end alike.  A node's neighbours are aggregated and joined, never collected.  Edges with a null end or
    from a node to itself link nothing.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        small = materialize(small.where("u <> v").distinct(), "edges")
        changed = small.exceptAll(now).limit(1).count() or now.exceptAll(small).limit(1).count()
        now = small
        if not changed:
            break
    linked = now.select(F.col("u").alias("id"), F.col("v").alias("cluster_id"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("cluster_id")).distinct()
    found = linked.unionByName(roots)
    if nodes is None:
        return found
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))
