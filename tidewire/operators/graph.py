"""Graphs: connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected (src, dst): the smallest node reachable. Large-star and small-star rounds in turn, each a
    map-side-combined minimum and a join on the node; a round is written to the shared folder."""
    u, v = F.col("u"), F.col("v")
    now = materialise(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where(u != v).distinct(), "edges")
    mark = None
    while (seen := tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())) != mark and seen[0]:
        mark = seen
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialise(both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        old, now = now, materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).where(u != v).distinct(), "edges")
        discard(old, large)
    return now.select(u.alias("node"), v.alias("root")).unionByName(now.select(v.alias("node"), v.alias("root")).distinct())


def group_by_shared(rows: DataFrame, member: str, shared: str, within: list[str]) -> DataFrame:
    """(member, root): members that share a value within equal within columns, transitively, have one root; each value ties its
    members to the smallest of them, so edges are as many as rows."""
    hub = rows.groupBy(*within, shared).agg(F.min(member).alias("_h"))
    edges = rows.join(hub, [*within, shared]).select(F.col(member).alias("src"), F.col("_h").alias("dst")).distinct()
    found = components(edges)
    return rows.select(member).distinct().join(found.withColumnRenamed("node", member), member, "left").select(member, F.coalesce("root", member).alias("root"))
