"""Connected components of a link table by repeated contraction; no vertex or link ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, settle


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> settled (node, component_id): component_id is the smallest node of the component.

    Links with a null end and links of a node to itself say nothing; repeated ones count once; no links, no rows.

    Each pass hooks every vertex to the neighbour (or itself) that comes first in a hashed order and contracts the
    graph by that map. In a hashed order a path has no long runs, so passes grow with the logarithm of the
    diameter. A vertex with very many links only adds rows to a partial minimum and to joins that AQE can split."""
    edges = settle(links.where("a <> b").select("a", "b").distinct(), "links")
    owner = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.min_by("b", F.xxhash64("b")).alias("b")
        hook = settle(
            both.groupBy("a").agg(first).select(
                F.col("a").alias("u"), F.when(F.xxhash64("b") < F.xxhash64("a"), F.col("b")).otherwise(F.col("a")).alias("p")
            ),
            "hooks",
        )
        ends = edges.join(hook.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(
            hook.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b"
        )
        fewer = settle(ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        if owner is None:
            moved = hook.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            moved = owner.join(hook, owner["root"] == hook["u"], "left").select("node", F.coalesce("p", "root").alias("root"))
        settled = settle(moved, "roots")
        release(edges, hook, *([owner] if owner is not None else []))
        edges, owner = fewer, settled
    if owner is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    least = settle(owner.groupBy("root").agg(F.min("node").alias("component_id")), "smallest")
    return settle(owner.join(least, "root").select("node", "component_id"), "components")
