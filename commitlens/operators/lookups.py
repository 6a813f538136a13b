"""Lookups over code graphs: functions and files of nodes, methods and callers by name, attributes, positions, earlier slices.

Nodes and edges are as in taint.py; `ord` tells the order in which rows came in, where the first or the last one counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import K, reversed_edges

UNKNOWN = "unknown"
#: Files that say that there is none.
NO_FILE = ["", "<empty>", UNKNOWN]
#: Labels of edges from a caller.
CALLS = ["SUB_FUNCTION_CALL", "FUNCTION_CALL"]


def _last(name) -> F.Column:
    return F.substring_index(name, ".", -1)


def with_attributes(nodes: DataFrame, full: DataFrame, keys: list[str] = K) -> DataFrame:
    """keys, node, attrs of a dependence graph's nodes (the map attrs) with the attributes of the full graph's, which win; adds node_type and display.

    display reads [node][line:column][type]: code, with 0 for a missing place and line ends in the code spelled out.
    """
    f = full.select(*keys, "node", F.col("attrs").alias("_full"))
    out = nodes.join(f, [*keys, "node"])
    kept = F.map_filter("attrs", lambda k, _: ~F.map_contains_key(F.col("_full"), k))
    out = out.withColumn("attrs", F.map_concat(kept, "_full")).drop("_full")
    at = lambda k, other: F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit(other))
    code = F.replace(at("CODE", ""), F.lit("\n"), F.lit("\\n"))
    out = out.withColumn("node_type", at("label", ""))
    return out.withColumn("display", F.concat(F.lit("["), F.col("node").cast("string"), F.lit("]["), at("LINE_NUMBER", "0"), F.lit(":"), at("COLUMN_NUMBER", "0"), F.lit("]["), F.col("node_type"), F.lit("]: "), code))


def function_graphs(calls: DataFrame, functions: DataFrame, keys: list[str] = K) -> DataFrame:
    """calls (keys, file, function, ...) with graph: that of the function of this file and name; else the file's first one whose last name part is the same and whose name holds the call's first part; else null.

    functions: keys, file, name, graph, ord. Of several of one file and name the last is meant, at the first one's place.
    """
    own = functions.groupBy(*keys, "file", "name").agg(F.min("ord").alias("_at"), F.max_by("graph", "ord").alias("graph")).withColumn("_last", _last("name"))
    asked = calls.select(*keys, "file", "function").distinct().withColumn("_last", _last("function"))
    both = asked.join(own, [*keys, "file", "_last"]).where(F.contains("name", F.substring_index("function", ".", 1)))
    best = both.groupBy(*keys, "file", "function").agg(F.min_by("graph", F.struct(F.col("name") != F.col("function"), "_at")).alias("graph"))
    return calls.join(best, [*keys, "file", "function"], "left")


def files_of_functions(functions: DataFrame, keys: list[str] = K) -> DataFrame:
    """keys, name, file: the first file that has a function of the name."""
    return functions.groupBy(*keys, "name").agg(F.min_by("file", "ord").alias("file"))


def files_of_nodes(nodes: DataFrame, members: DataFrame, keys: list[str] = K) -> DataFrame:
    """nodes with file: that of the first function (members: keys, node, file, ord) which the node is in, else unknown."""
    first = members.groupBy(*keys, "node").agg(F.min_by("file", "ord").alias("file"))
    return nodes.join(first, [*keys, "node"], "left").withColumn("file", F.coalesce("file", F.lit(UNKNOWN)))


def methods(nodes: DataFrame, keys: list[str] = K) -> DataFrame:
    """keys, full_name, node: the last METHOD node of each full name that is not empty."""
    return nodes.where("label = 'METHOD' and full_name <> ''").groupBy(*keys, "full_name").agg(F.max_by("node", "ord").alias("node"))


def callers(edges: DataFrame, keys: list[str] = K) -> DataFrame:
    """keys, node, callers: who calls each node, each caller once, in order of ids."""
    return edges.where(F.col("label").isin(CALLS)).groupBy(*keys, F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("callers"))


def relation_nodes(nodes: DataFrame, full: DataFrame, keys: list[str] = K) -> DataFrame:
    """Nodes (file_path, full_name, label; blanks filled from full's file_name, full_name and label) that have a real file and are neither operators nor parameters."""
    own = lambda c: F.nullif(F.col(c), F.lit(""))
    f = full.select(*keys, "node", F.col("file_name").alias("_file"), F.col("full_name").alias("_name"), F.col("label").alias("_label"))
    out = nodes.join(f, [*keys, "node"], "left")
    file = F.coalesce(own("file_path"), F.col("_file"), F.lit(""))
    name, label = (F.coalesce(own(a), F.col(b), F.lit("")) for a, b in (("full_name", "_name"), ("label", "_label")))
    return out.where(~file.isin(NO_FILE) & ~name.startswith("<operator>.") & (label != "METHOD_PARAMETER_IN")).drop("_file", "_name", "_label")


def project_calls(calls: DataFrame, files: DataFrame, keys: list[str] = K) -> DataFrame:
    """Calls (method_full_name, and dynamic_type_hint where there is one) that may be the project's own: not builtin; of no file that is known or Python; or whose file, or its topmost folder, is in files (keys, path)."""
    own = files.select(*keys, F.explode(F.array_distinct(F.array("path", F.substring_index("path", "/", 1)))).alias("_file")).distinct()
    file = F.substring_index(F.coalesce("method_full_name", F.lit("")), ":", 1)
    places = F.array_distinct(F.array(file, F.substring_index(file, "/", 1)))
    if "dynamic_type_hint" in calls.columns:
        calls = calls.where(~F.coalesce("dynamic_type_hint", F.lit("")).contains("__builtin"))
    cand = calls.withColumn("_open", (file == "<unknownFullName>") | ~file.contains("py"))
    known = cand.where("not _open").select(*keys, "node", F.explode(places).alias("_file")).join(own, [*keys, "_file"], "left_semi").select(*keys, "node").distinct().withColumn("_known", F.lit(True))
    return cand.join(known, [*keys, "node"], "left").where("_open or _known").drop("_open", "_known")


def at_line(nodes: DataFrame, line) -> DataFrame:
    """Nodes whose line is the one given, compared as it is."""
    return nodes.where(F.col("line") == F.lit(line))


def same_position(asked: DataFrame, nodes: DataFrame, keys: list[str] = K) -> DataFrame:
    """keys, node, other: the nodes at each asked one's line and column, itself included; a missing place is -1."""
    place = [F.coalesce("line", F.lit(-1)).alias("line"), F.coalesce("column", F.lit(-1)).alias("column")]
    a = asked.where("line is not null and column is not null").select(*keys, "node", "line", "column")
    return a.join(nodes.select(*keys, F.col("node").alias("other"), *place), [*keys, "line", "column"]).select(*keys, "node", "other")


def builtin_calls(nodes: DataFrame) -> DataFrame:
    """Nodes that call a builtin, or whose code reads."""
    return nodes.where(F.coalesce(F.col("method_full_name"), F.lit("")).contains("__builtin") | F.coalesce(F.col("code"), F.lit("")).contains("read"))


def tree_linked(pairs: DataFrame, edges: DataFrame, keys: list[str] = K) -> DataFrame:
    """pairs (keys, src, dst) with is_linked: whether a syntax tree's edge joins them either way."""
    e = edges.where("label = 'AST'").select(*keys, "src", "dst")
    both = e.unionByName(reversed_edges(e)).distinct().withColumn("_is", F.lit(True))
    return pairs.join(both, [*keys, "src", "dst"], "left").withColumn("is_linked", F.coalesce("_is", F.lit(False))).drop("_is")


def slice_ranks(slices: DataFrame, keys: list[str] = K) -> DataFrame:
    """slices (slice_name, has_outer_root, n_nodes, file_path) with rank: modules first, then those of an outer root, the larger ones, by file and by name."""
    w = Window.partitionBy(*keys).orderBy(F.col("slice_name") != "<module>", ~F.coalesce("has_outer_root", F.lit(False)), F.desc("n_nodes"), "file_path", "slice_name")
    return slices.withColumn("rank", F.row_number().over(w))


def earlier_slices(slices: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """slices (keys, slice_name, file_token) with before: the signature of the slice's file of the commit before (before: keys, file, signature); empty without one.

    Meant is the file named after both; else one whose name ends so; for <file> and <module> else the only one of the
    token. Of several, those not marked NEW@ come first, then by name. Names meet by what follows their last @, so that
    no slice is held against all files.
    """
    end = F.concat(F.lit("@"), "file_token", F.lit("_slice.py"))
    own = slices.select(*keys, "slice_name", "file_token").distinct().withColumns({"_end": end, "_tail": F.substring_index(end, "@", -1)})
    both = own.join(before.withColumn("_tail", F.substring_index("file", "@", -1)), [*keys, "_tail"]).where(F.endswith("file", F.col("_end")))
    full = F.concat("slice_name", "_end")
    tier = F.when(F.col("file") == full, 0).when(F.endswith("file", full), 1).otherwise(2)
    best = both.groupBy(*keys, "slice_name", "file_token").agg(F.min(tier).alias("_tier"), F.count("*").alias("_n"), F.min_by("signature", F.struct(tier, F.startswith("file", F.lit("NEW@")), "file")).alias("before"))
    best = best.where(F.col("_tier") < 2).unionByName(best.where((F.col("_tier") == 2) & (F.col("_n") == 1) & F.col("slice_name").isin("<file>", "<module>"))).drop("_tier", "_n")
    return slices.join(best, [*keys, "slice_name", "file_token"], "left").withColumn("before", F.coalesce("before", F.lit("")))
