"""Connected components of an edge table, on tables all the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickflow.llm.common import join_hot, materialise


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node of its component.

    Each round takes the least root among a node and its neighbours and then
    follows roots once more (pointer jumping), so rounds grow with the
    logarithm of a component's width. Minima are pre-aggregated, and look-ups of
    a hub or root with very many rows are salted, so no task holds one of them whole.
    """
    both = materialise(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct(), f"{name}-edges")
    roots = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), f"{name}-0")
    for k in range(1, 64):
        near = join_hot(both, roots.select(F.col("node").alias("v"), F.col("root").alias("r")), "v", "u")
        seen = near.groupBy("u").agg(F.min("r").alias("r"))
        hooked = roots.join(seen, roots["node"] == seen["u"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("r", "root")).alias("root"))
        hooked = materialise(hooked, f"{name}-{k}-hooked")
        # A root that has itself moved on is followed.
        hop = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = join_hot(hooked, hop, "root", "node").select("node", "old", F.least("root", "next").alias("root"))
        moved = materialise(moved, f"{name}-{k}")
        changed = moved.filter("root <> old").limit(1).count()
        roots = moved.select("node", "root")
        if not changed:
            return roots
    raise RuntimeError("components have not settled in 63 rounds")
