"""Distributed union-find: the smallest id of each connected component."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hindcast.llm.stored import Workspace


def connected(links: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(id, root) for every id that occurs in ``links`` (a, b).

    Each round hooks every root to the smallest root that a link of its
    members reaches, then halves all paths by pointing an id at its root's
    root. Trees over star-shaped links settle in two or three rounds, chains
    in the logarithm of their length. Each round is a written table; loops end
    by a count on the executors, and no link is brought to the driver.
    """
    edges = work.saved(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .distinct(), f"{name}-edges")
    labels = work.saved(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
                        .unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("root")))
                        .groupBy("id").agg(F.min("root").alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        # Compress until every id points at a root.
        while True:
            up = labels.select(F.col("id").alias("root"), F.col("root").alias("above")).filter("root <> above")
            if up.isEmpty() or labels.join(up, "root").isEmpty():
                break
            labels = work.saved(labels.join(up, "root", "left")
                                .select("id", F.coalesce("above", "root").alias("root")), f"{name}-{step}")
            step += 1
        a = labels.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        b = labels.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        apart = work.saved(edges.join(a, "a").join(b, "b").filter("ra <> rb")
                           .select(F.least("ra", "rb").alias("lower"), F.greatest("ra", "rb").alias("root"))
                           .groupBy("root").agg(F.min("lower").alias("lower")), f"{name}-apart-{step}")
        if apart.isEmpty():
            return labels
        # A root is hooked only below a smaller one, so no cycles arise.
        labels = work.saved(labels.join(apart, "root", "left").select("id", F.coalesce("lower", "root").alias("root")),
                            f"{name}-{step}")
