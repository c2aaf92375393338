"""Connected components by repeated hooking and shortcutting of parents, as joins; no edges leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltstone.llm.work import Work


def components(links: DataFrame, work: Work, name: str) -> DataFrame:
    """node, component (its smallest node) of every node of the links (a, b).

    Each round hooks a node and its parent to the smallest grandparent among its neighbours, and shortcuts it to its
    own grandparent, so the number of rounds follows the logarithm of the longest shortest path.
    """
    edges = work.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    parent = work.save(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        grand = parent.join(parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent").select("node", "parent", "grand")
        near = edges.join(grand.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("low"))
        met = grand.join(near, "node").select("node", "parent", F.least("grand", "low").alias("low"))
        offers = met.select("node", "low", "parent").unionByName(met.select(F.col("parent").alias("node"), "low", F.lit(None).cast("long").alias("parent")))
        after = offers.groupBy("node").agg(F.least(F.min("low"), F.max("parent")).alias("parent"), F.max("parent").alias("before"))
        after = work.save(after, f"{name}-{turn}")
        work.drop(f"{name}-{turn - 1}")
        if after.filter("parent < before").isEmpty():
            return after.select("node", F.col("parent").alias("component"))
        parent = after.select("node", "parent")
