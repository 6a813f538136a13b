"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut

#: Rows to a task, about, of the tables that the loops write.
ROWS = 500_000


def roots(parents: DataFrame, tasks: int = 1) -> DataFrame:
    """node and root of a forest given as node and parent (a parent is less than its node; roots have no row)."""
    while True:
        # a parent with many nodes is a hot key on the left only; both sides have exchanges of their own
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = cut(parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")).coalesce(tasks))
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents.withColumnRenamed("parent", "root")


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node of links (a, b) but the roots.

    Every node points to its least neighbour if that is less; the forest's roots are found by pointer jumping, links
    are rewritten to roots, and what is left between roots goes another round.
    """
    edges = cut(links.select("a", "b").where("a <> b").distinct())
    # links are few beside documents: the loop's tables get as many tasks as their rows need
    tasks = 1 + edges.count() // ROWS
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).where("parent < node").coalesce(tasks))
        new = roots(step, tasks)
        if found is None:
            found = new
        else:
            later = new.select(F.col("node").alias("root"), F.col("root").alias("above"))
            found = cut(found.join(later, "root", "left").select("node", F.coalesce("above", "root").alias("root")).union(new).coalesce(tasks))
        for side in ("a", "b"):
            edges = edges.join(new.select(F.col("node").alias(side), F.col("root").alias("_to")), side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
        edges = cut(edges.select("a", "b").where("a <> b").distinct().coalesce(tasks))
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
