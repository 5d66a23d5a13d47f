"""Connected components of links between ids, by hooking and pointer jumping on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.staging import staged


def _roots(parents: DataFrame) -> DataFrame:
    """(id, root): parents followed to the end. Chains only lead to smaller ids, and halve twice in each turn."""
    while True:
        p = parents.alias("p")
        far = parents.select(F.col("id").alias("via"), F.col("root").alias("next"))
        two = p.join(far, F.col("p.root") == F.col("via"), "left").select(
            "id", F.col("p.root").alias("before"), F.coalesce("next", "p.root").alias("root"))
        two = staged(two, "parents")
        if two.where(F.col("before") != F.col("root")).isEmpty():
            return two.select("id", "root")
        parents = two.select("id", "root")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for the ids in ``links`` (a, b); component is the smallest id that can be reached.

    Each round hooks every root to its smallest neighbour and contracts the links; at least half of the roots that
    still have links disappear, so the rounds are logarithmic. Minima are combined before each shuffle, so an id with
    very many links costs one row per task. Nulls and links from an id to itself are ignored.
    """
    edges = staged(links.where((F.col("a") != F.col("b"))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    reached = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("id"), F.least("a", "m").alias("root")), "hooks")
        if reached is not None and hooks.isEmpty():
            return reached.select("id", F.col("root").alias("component"))
        roots = _roots(hooks)
        if reached is None:
            reached = roots
        else:
            new = roots.select(F.col("id").alias("via"), F.col("root").alias("next"))
            reached = staged(reached.join(new, F.col("root") == F.col("via"), "left").select(
                "id", F.coalesce("next", "root").alias("root")), "reached")
        left, right = (roots.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        edges = staged(edges.join(left, "a").join(right, "b").where(F.col("root_a") != F.col("root_b")).select(
            F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "links")
