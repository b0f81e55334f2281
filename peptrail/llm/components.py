"""Connected components by hooking and pointer jumping; links stay distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of links(a, b), component being its smallest node.

    Each round hooks nodes to their smallest neighbour, jumps pointers twice and contracts
    the links, so that the number of rounds grows with the logarithm of the longest path.
    Self-links and repeated links are harmless; no links give no rows.
    """
    links = scratch.keep(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        hook = scratch.keep(hook, "hook")
        for _ in range(2):
            top = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = hook.join(top, "up").select("node", F.col("top").alias("up"))
        hook = scratch.keep(hook, "jump")
        up_a, up_b = (hook.select(F.col("node").alias(k), F.col("up").alias(f"up_{k}")) for k in "ab")
        fewer = links.join(up_a, "a").join(up_b, "b").where("up_a <> up_b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct()
        before, links = links, scratch.keep(fewer, "links")
        scratch.drop(before)
        if labels is None:
            labels = hook.select("node", F.col("up").alias("component"))
        else:
            moved = hook.select(F.col("node").alias("component"), F.col("up").alias("moved"))
            labels = scratch.keep(labels.join(moved, "component", "left").select("node", F.coalesce("moved", "component").alias("component")), "labels")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
