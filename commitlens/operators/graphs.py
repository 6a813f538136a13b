"""Graph operators over node and edge tables: frontier loops over tables in the shared folder.

Every loop carries a key, so that all repos, commits or roots advance together, and stops when no row is new.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The key of a code graph.
K = ["repo", "commit"]


def settle(df: DataFrame) -> DataFrame:
    """df written as a table in the folder that the cluster names for checkpoints, and read back; in local mode a folder is made where none is named.

    Unlike a checkpoint, the table carries no constraints of the plan that made it, which grow in loops.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        at = tempfile.mkdtemp(prefix="commitlens-")
        sc.setCheckpointDir(at)
    path = f"{at}/commitlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reach(seeds: DataFrame, edges: DataFrame, keys: list[str], max_depth: int | None = None, expand: DataFrame | None = None, seeds_expand: bool = False) -> DataFrame:
    """keys, node and depth: the nodes that each seed row's keys reach along edges (src, dst, and those of keys they have), with the least depth.

    expand: nodes (with those keys) beyond which the walk goes on; others are reached but end it. With seeds_expand it
    goes on beyond all seeds too.
    """
    shared = [k for k in keys if k in edges.columns]
    frontier = settle(seeds.select(*keys, "node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    depth = 0
    while not frontier.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        start = frontier if expand is None or (seeds_expand and depth == 1) else frontier.join(expand, [*[k for k in keys if k in expand.columns], "node"], "left_semi")
        step = start.withColumnRenamed("node", "src").join(edges.select(*shared, "src", "dst"), [*shared, "src"]).select(*keys, F.col("dst").alias("node")).distinct()
        frontier = settle(step.join(seen, [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = settle(seen.unionByName(frontier)) if depth % 8 == 0 else seen.unionByName(frontier)
    return seen


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def in_degree_zero(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.join(edges.select(*keys, F.col("dst").alias("node")).distinct(), [*keys, "node"], "left_anti")


def roots(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node: nodes without an edge into them; and of cycles that no such node reaches and nothing else enters, the least node."""
    free = in_degree_zero(nodes, edges, keys).select(*keys, "node")
    got = reach(free, edges, keys)
    rest = settle(nodes.select(*keys, "node").join(got, [*keys, "node"], "left_anti"))
    if rest.isEmpty():
        return free
    own = edges.join(rest.withColumnRenamed("node", "src"), [*keys, "src"], "left_semi").join(rest.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_semi")
    pairs = reach(rest.withColumn("root", F.col("node")), own, [*keys, "root"]).select(*keys, F.col("root").alias("a"), F.col("node").alias("b"))
    back = pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
    both = pairs.intersect(back)  # of one cycle
    entered = back.subtract(both).select(*keys, F.col("a").alias("node"))  # from nodes that are not on its cycle
    least = both.groupBy(*keys, "a").agg(F.min("b").alias("node")).select(*keys, F.col("a").alias("member"), "node")
    cycles = least.join(entered.select(*keys, F.col("node").alias("member")).distinct(), [*keys, "member"], "left_anti").select(*keys, "node").distinct()
    return free.unionByName(cycles)


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node and root: the least node of each node's component, by least labels with pointer jumping."""
    both = settle(edges.select(*keys, "src", "dst").unionByName(reversed_edges(edges.select(*keys, "src", "dst"))).distinct())
    label = settle(both.groupBy(*keys, F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("root")))
    while True:
        near = both.join(label.select(*keys, F.col("node").alias("dst"), "root"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("node")).agg(F.min("root").alias("near"))
        low = label.join(near, [*keys, "node"]).select(*keys, "node", "root", F.least("root", "near").alias("low"))
        up = label.select(*keys, F.col("node").alias("low"), F.col("root").alias("above"))
        new = settle(low.join(up, [*keys, "low"], "left").select(*keys, "node", F.least("low", F.coalesce("above", "low")).alias("root"), "root").toDF(*keys, "node", "root", "was"))
        label = new.drop("was")
        if new.where("root <> was").isEmpty():
            return label


def overlap_groups(membership: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slice and root: slices that share nodes, directly or through others, have the same root (the least slice)."""
    pairs = membership.groupBy(*keys, "node").agg(F.min("slice").alias("hub"))
    links = membership.join(pairs, [*keys, "node"]).select(*keys, F.col("slice").alias("src"), F.col("hub").alias("dst"))
    return components(links, keys).withColumnRenamed("node", "slice")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_id, b_id and n: how many nodes each pair of sets (id, node) shares, for pairs that share any."""
    return a.distinct().withColumnRenamed("id", "a_id").join(b.distinct().withColumnRenamed("id", "b_id"), "node").groupBy("a_id", "b_id").agg(F.count("*").alias("n"))


def spread(tags: DataFrame, edges: DataFrame, keys: list[str], max_rounds: int | None = 20) -> DataFrame:
    """tags (keys, node, category) joined by those that come from callees to their callers until nothing is new."""
    seeds = tags.select(*keys, "category", "node")
    return reach(seeds, reversed_edges(edges), [*keys, "category"], max_rounds).select(*keys, "node", "category")


def ordered_arguments(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, call and args: the argument nodes of each call by their index."""
    args = edges.where("label = 'ARGUMENT'").join(nodes.select(*keys, F.col("node").alias("dst"), "argument_index"), [*keys, "dst"])
    return args.groupBy(*keys, F.col("src").alias("call")).agg(F.transform(F.array_sort(F.collect_list(F.struct("argument_index", "dst"))), lambda x: x["dst"]).alias("args"))


def compose(*graphs: DataFrame, key: list[str]) -> DataFrame:
    """Union of node or edge tables; of one key the row of the last table wins."""
    rows = graphs[0].withColumn("_p", F.lit(0))
    for i, g in enumerate(graphs[1:], 1):
        rows = rows.unionByName(g.withColumn("_p", F.lit(i)), allowMissingColumns=True)
    from pyspark.sql import Window

    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_p")))).where("_rn = 1").drop("_rn", "_p")


def pdg_with_cfg(pdg: DataFrame, cfg: DataFrame, cpg: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of both graphs, all labelled: an edge without a label takes the big graph's, or CFG, if it is alone between its nodes; else it is redundant and goes."""
    both = pdg.unionByName(cfg).distinct()
    n = both.groupBy(*keys, "src", "dst").agg(F.count("*").alias("_n"))
    named = cpg.groupBy(*keys, "src", "dst").agg(F.min("label").alias("_label"))
    rows = both.join(n, [*keys, "src", "dst"]).join(named, [*keys, "src", "dst"], "left")
    blank = F.coalesce("label", F.lit("")) == ""
    return rows.where(~blank | (F.col("_n") == 1)).withColumn("label", F.when(blank, F.coalesce("_label", F.lit("CFG"))).otherwise(F.col("label"))).drop("_n", "_label")
