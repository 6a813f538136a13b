"""Taint graphs: dependence closures of sensitive calls, their growth over calls, and their upkeep from commit to commit.

Nodes: repo, commit, node, label, name, full_name, method_full_name, code, line, file_path, is_sensitive, ord.
Edges: repo, commit, src, dst, label. K is the key of a graph.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.diffs import shifted
from ..functions.text import alike, companions, indel_ratio
from . import lookups
from .graphs import K, compose, reach, reversed_edges, settle

#: The constructor that calls what its `target` argument names.
THREAD = "threading.py:<module>.Thread.__init__"
ASSIGNMENT = "<operator>.assignment"
#: Rounds of growth, at most.
ROUNDS = 10


def dependence(edges: DataFrame, nodes: DataFrame, keys: list[str] = K) -> DataFrame:
    """Directed steps (src, dst, and the edge as from, to, label) that a taint trace takes: data and control dependences both ways.

    Forward, edges without a variable and those into METHOD_RETURN are left out; backward, those without a variable
    unless they come from a METHOD.
    """
    own = edges.where(F.col("label").contains("DDG") | F.col("label").contains("CDG"))
    kind = nodes.select(*keys, "node", F.col("label").alias("kind"))
    own = own.join(kind.withColumnsRenamed({"node": "src", "kind": "src_kind"}), [*keys, "src"]).join(kind.withColumnsRenamed({"node": "dst", "kind": "dst_kind"}), [*keys, "dst"])
    empty = F.trim("label") == "DDG:"
    edge = [F.col("src").alias("from"), F.col("dst").alias("to"), "label"]
    ahead = own.where(~empty & (F.col("dst_kind") != "METHOD_RETURN")).select(*keys, "src", "dst", *edge)
    back = own.where(~empty | (F.col("src_kind") == "METHOD")).select(*keys, F.col("dst").alias("_s"), F.col("src").alias("_d"), *edge).withColumnsRenamed({"_s": "src", "_d": "dst"})
    return ahead.unionByName(back)


def trace(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, keys: list[str] = K) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the dependence closure of all seeds (keys, node) at once."""
    steps = settle(dependence(edges, nodes, keys))
    found = reach(seeds, steps, keys).select(*keys, "node")
    used = steps.join(found.withColumnRenamed("node", "src"), [*keys, "src"], "left_semi").select(*keys, F.col("from").alias("src"), F.col("to").alias("dst"), "label").distinct()
    return found, used


def sensitive_calls(nodes: DataFrame, api: DataFrame, edges: DataFrame | None = None, keys: list[str] = K) -> DataFrame:
    """CALL nodes whose resolved or dynamic name is in the api table (full_name); of an assignment the second argument's counts, and without one it is none."""
    calls = nodes.where("label = 'CALL'")
    name = F.col("method_full_name")
    if edges is not None:
        args = edges.where("label = 'ARGUMENT'").join(nodes.select(*keys, F.col("node").alias("dst"), "argument_index", F.col("method_full_name").alias("_callee"), F.col("code").alias("_code")), [*keys, "dst"]).where("argument_index = 2")
        args = args.groupBy(*keys, F.col("src").alias("node")).agg(F.min(F.struct("_callee", "_code")).alias("_arg")).select(*keys, "node", "_arg.*")
        calls = calls.join(args, [*keys, "node"], "left").where("name not like '<operator>.assignment%' or (_callee is not null and coalesce(_code, '') <> '<empty>')")
        name = F.when(F.col("name").startswith("<operator>.assignment"), F.col("_callee")).otherwise(name)
    calls = calls.withColumn("_callee_name", name)
    if "dynamic_type_hint" in nodes.columns:
        calls = calls.withColumn("_callee_name", F.explode(F.array_distinct(F.array("_callee_name", "dynamic_type_hint"))))
    return calls.join(api.select(F.col("full_name").alias("_callee_name")), "_callee_name", "left_semi").select(*keys, "node").distinct()


def resolved_calls(calls: DataFrame, methods: DataFrame, keys: list[str] = K, loose: bool = True) -> DataFrame:
    """keys, call, method: call sites (node, method_full_name) matched to METHOD nodes: by full name and file; with loose else by an equal last part of the name where the method's file holds the callee's path."""
    m = methods.where("label = 'METHOD'").select(*keys, F.col("node").alias("method"), F.col("full_name").alias("_name"), F.col("file_path").alias("_file"), F.substring_index("full_name", ".", -1).alias("_last"))
    c = calls.select(*keys, F.col("node").alias("call"), F.regexp_replace("method_full_name", r"<returnValue>\.", "").alias("_full"))
    c = c.withColumns({"_file": F.substring_index("_full", ":", 1), "_last": F.substring_index("_full", ".", -1)})
    exact = c.join(m.drop("_last"), [*keys, "_file"]).where(F.col("_name") == F.col("_full")).select(*keys, "call", "method").distinct()
    if not loose:
        return exact
    left = c.where(F.col("_file").contains(".py")).join(exact.select(*keys, "call").distinct(), [*keys, "call"], "left_anti").withColumnRenamed("_file", "_path")
    near = left.join(m, [*keys, "_last"]).where(F.contains(F.col("_file"), F.replace("_path", F.lit(".py"), F.lit("")))).select(*keys, "call", "method")
    return exact.unionByName(near).distinct()


def arguments(nodes: DataFrame, edges: DataFrame, keys: list[str] = K) -> DataFrame:
    """keys, call, arg, pos (its place among the call's arguments, from 1) and what is known of the argument."""
    known = [c for c in ("label", "name", "argument_name", "method_full_name", "dynamic_type_hint", "type_full_name", "code") if c in nodes.columns]
    index = F.coalesce("argument_index", F.lit(0)) if "argument_index" in nodes.columns else F.lit(0)
    own = nodes.select(*keys, F.col("node").alias("arg"), index.alias("_i"), *known)
    both = edges.where("label = 'ARGUMENT'").select(*keys, F.col("src").alias("call"), F.col("dst").alias("arg")).distinct().join(own, [*keys, "arg"])
    return both.withColumn("pos", F.row_number().over(Window.partitionBy(*keys, "call").orderBy("_i", "arg"))).drop("_i")


def _own(calls: DataFrame, files: DataFrame | None, keys: list[str]) -> DataFrame:
    return calls if files is None else lookups.project_calls(calls, files, keys)


def _named(code_columns: list[str], name: str) -> F.Column:
    """What a call calls: its name, or for a named argument the last part of its code."""
    return F.when(F.coalesce("argument_name", F.lit("")) != "", F.substring_index("code", ".", -1)).otherwise(F.col(name)) if "argument_name" in code_columns else F.col(name)


def call_sites(nodes: DataFrame, args: DataFrame, files: DataFrame | None = None, keys: list[str] = K) -> DataFrame:
    """keys, site, call, method: the places that a taint graph grows to from a method that is called there.

    An assignment is the site of later arguments that resolve to the method (loosely too); other calls of module or
    returned names resolve by full name and file; a thread's constructor by its target's code and the file of its type.
    """
    calls = nodes.where("label = 'CALL'")
    assigned = args.where("pos > 1").join(calls.where(F.col("method_full_name") == ASSIGNMENT).select(*keys, F.col("node").alias("call")), [*keys, "call"], "left_semi").withColumnsRenamed({"call": "site", "arg": "node"})
    by_value = resolved_calls(_own(assigned.drop("site", "pos").distinct(), files, keys), nodes, keys).join(assigned.select(*keys, "site", F.col("node").alias("call")), [*keys, "call"])
    named = calls.where(~F.col("method_full_name").isin(ASSIGNMENT, THREAD) & F.rlike("method_full_name", F.lit(r"<(module|returnValue)>\.")))
    out = by_value.unionByName(resolved_calls(_own(named, files, keys), nodes, keys, loose=False).withColumn("site", F.col("call")))
    if {"argument_name", "type_full_name"} <= set(args.columns):
        threads = calls.where(F.col("method_full_name") == THREAD).select(*keys, F.col("node").alias("call"))
        target = args.where("argument_name = 'target'").join(threads, [*keys, "call"], "left_semi").groupBy(*keys, "call").agg(F.min(F.struct("pos", "code", "type_full_name")).alias("t"))
        target = target.select(*keys, "call", F.replace("t.code", F.lit("<returnValue>."), F.lit("")).alias("full_name"), F.substring_index("t.type_full_name", ":", 1).alias("file_path"))
        started = target.join(nodes.where("label = 'METHOD'").select(*keys, "full_name", "file_path", F.col("node").alias("method")), [*keys, "full_name", "file_path"])
        out = out.unionByName(started.select(*keys, "call", "method", F.col("call").alias("site")))
    return out.select(*keys, "site", "call", "method").distinct()


def call_targets(nodes: DataFrame, edges: DataFrame, args: DataFrame, files: DataFrame | None = None, keys: list[str] = K) -> DataFrame:
    """keys, call, dst, is_entry: where a taint graph goes on from a project call: the parameters of the function it calls and, beside a self, its METHOD; without parameters the METHOD. From entries the trace goes on.

    The function is looked for in the call's file, then in the callee's; an assignment of a method's reference calls it.
    """
    functions = nodes.where("label = 'METHOD'").select(*keys, F.col("file_path").alias("file"), F.col("full_name").alias("name"), F.col("node").alias("graph"), "ord")
    calls = _own(nodes.where("label = 'CALL'"), files, keys)
    calls = calls.select(*keys, F.col("node").alias("call"), F.col("file_path").alias("here"), _named(nodes.columns, "method_full_name").alias("function"), F.col("method_full_name").alias("_full"))
    refs = args.where("pos = 2 and label = 'METHOD_REF'").select(*keys, "call", F.col("method_full_name").alias("_ref"))
    ref = (F.col("function") == ASSIGNMENT) & F.col("_ref").isNotNull()
    calls = calls.join(refs, [*keys, "call"], "left").withColumns({"function": F.when(ref, F.col("_ref")).otherwise(F.col("function")), "there": F.substring_index(F.when(ref, F.col("_ref")).otherwise(F.col("_full")), ":", 1)}).drop("_ref", "_full")
    first = lookups.files_of_functions(functions, keys).select(*keys, F.col("name").alias("function"), F.col("file").alias("_any"))
    calls = calls.join(first, [*keys, "function"], "left").withColumn("there", F.when(F.endswith("there", F.lit(".py")), F.col("there")).otherwise(F.col("_any"))).drop("_any")
    at = lambda side: lookups.function_graphs(calls.select(*keys, "call", "function", F.col(side).alias("file")), functions, keys).select(*keys, "call", F.col("graph").alias(side))
    hit = at("here").join(at("there"), [*keys, "call"]).select(*keys, "call", F.coalesce("here", "there").alias("method")).where("method is not null")
    inner = edges.where("label in ('AST', 'CONTAINS')").select(*keys, F.col("src").alias("method"), F.col("dst").alias("node")).distinct()
    params = inner.join(nodes.where("label = 'METHOD_PARAMETER_IN'").select(*keys, "node", "name"), [*keys, "node"])
    both = hit.join(params, [*keys, "method"], "left")
    entry = both.select(*keys, "call", F.coalesce("node", "method").alias("dst"), F.lit(True).alias("is_entry"))
    return entry.unionByName(both.where("name = 'self'").select(*keys, "call", F.col("method").alias("dst"), F.lit(False).alias("is_entry"))).distinct()


def bare_arguments(nodes: DataFrame, args: DataFrame, files: DataFrame | None = None, keys: list[str] = K) -> DataFrame:
    """keys, call, arg: arguments that are calls, of a project function by name, without arguments of their own or of a call that is not the project's."""
    names = nodes.where("label = 'METHOD'").select(*keys, F.col("full_name").alias("_function")).distinct()
    inner = args.where("label = 'CALL'").withColumn("_function", _named(args.columns, "name")).join(names, [*keys, "_function"], "left_semi").select(*keys, "call", "arg")
    calls = nodes.where("label = 'CALL'")
    bare = inner.join(args.select(*keys, F.col("call").alias("arg")).distinct(), [*keys, "arg"], "left_anti")
    if files is not None:
        bare = bare.unionByName(inner.join(_own(calls, files, keys).select(*keys, F.col("node").alias("call")), [*keys, "call"], "left_anti"))
    return bare.join(calls.select(*keys, F.col("node").alias("call")), [*keys, "call"], "left_semi").select(*keys, "call", "arg").distinct()


def grown(found: DataFrame, taint_edges: DataFrame, nodes: DataFrame, edges: DataFrame, keys: list[str] = K, rounds: int = ROUNDS, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A taint graph extended over calls until its nodes stay the same: callers of its methods first, then bare arguments spliced in and callees of its calls, then containment edges repaired.

    files: the projects' own files (keys, path); without them every call counts as the project's.
    """
    args = settle(arguments(nodes, edges, keys))
    sites = settle(call_sites(nodes, args, files, keys))
    targets = settle(call_targets(nodes, edges, args, files, keys))
    bare = settle(bare_arguments(nodes, args, files, keys))
    link = lambda df, src, dst, label: df.select(*keys, F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(label).alias("label"))

    def callers(found, taint_edges):
        hit = sites.join(found.withColumnRenamed("node", "method"), [*keys, "method"], "left_semi")
        links = link(hit.where("site <> call"), "site", "call", "FUNCTION_CALL").unionByName(link(hit, "call", "method", "FUNCTION_CALL"))
        return taint_edges, links, hit.select(*keys, F.col("site").alias("node"))

    def callees(found, taint_edges):
        spliced_in = bare.join(found.withColumnRenamed("node", "call"), [*keys, "call"], "left_semi").select(*keys, F.col("arg").alias("node")).distinct()
        hit = targets.join(found.unionByName(spliced_in).distinct().withColumnRenamed("node", "call"), [*keys, "call"], "left_semi")
        links = link(hit, "call", "dst", "SUB_FUNCTION_CALL").unionByName(link(bare.join(found.withColumnRenamed("node", "call"), [*keys, "call"], "left_semi"), "arg", "call", "ARGUMENT"))
        return spliced(taint_edges, bare, keys), links, hit.where("is_entry").select(*keys, F.col("dst").alias("node"))

    for step in (callers, callees):
        for _ in range(rounds):
            kept, links, seeds = step(found, taint_edges)
            more, used = trace(seeds, edges, nodes, keys)
            ends = links.select(*keys, F.explode(F.array("src", "dst")).alias("node"))
            new = settle(more.unionByName(ends).distinct().join(found, [*keys, "node"], "left_anti"))
            taint_edges = settle(kept.unionByName(links).unionByName(used).distinct())
            if new.isEmpty():
                break
            found = settle(found.unionByName(new))
    return found, repaired(spliced(taint_edges, bare, keys), found, nodes, edges, keys)


def spliced(taint_edges: DataFrame, bare: DataFrame, keys: list[str] = K) -> DataFrame:
    """Edges into a call rerouted through its bare arguments: u to call becomes u to argument to call, labelled ARGUMENT. Edges of that label stay."""
    into = taint_edges.where("label <> 'ARGUMENT'").withColumnRenamed("dst", "call").join(bare, [*keys, "call"]).where("src <> arg")
    gone = into.select(*keys, "src", F.col("call").alias("dst"), "label").distinct()
    put = lambda src, dst: into.select(*keys, F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit("ARGUMENT").alias("label"))
    return taint_edges.join(gone, [*keys, "src", "dst", "label"], "left_anti").unionByName(put("src", "arg")).unionByName(put("arg", "call")).distinct()


def repaired(taint_edges: DataFrame, found: DataFrame, nodes: DataFrame, edges: DataFrame, keys: list[str] = K) -> DataFrame:
    """With CONTAINS edges from tainted methods to tainted calls in them that no edge joins yet."""
    kind = nodes.join(found, [*keys, "node"], "left_semi").select(*keys, "node", F.col("label").alias("kind"))
    own = edges.where("label = 'CONTAINS'").select(*keys, "src", "dst", "label")
    own = own.join(kind.where("kind = 'METHOD'").select(*keys, F.col("node").alias("src")), [*keys, "src"], "left_semi").join(kind.where("kind = 'CALL'").select(*keys, F.col("node").alias("dst")), [*keys, "dst"], "left_semi")
    return taint_edges.unionByName(own.join(taint_edges, [*keys, "src", "dst"], "left_anti"))


def built(nodes: DataFrame, edges: DataFrame, api: DataFrame, keys: list[str] = K, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The taint graph of each (repo, commit): the sensitive calls' closures, grown. Nodes carry is_sensitive."""
    seeds = settle(sensitive_calls(nodes, api, edges if "argument_index" in nodes.columns else None, keys))
    found, used = trace(seeds, edges, nodes, keys)
    found, used = grown(found, used, nodes, edges, keys, files=files)
    return found.join(seeds.withColumn("_s", F.lit(True)), [*keys, "node"], "left").select(*keys, "node", F.coalesce("_s", F.lit(False)).alias("is_sensitive")), used


def same_node(old: str = "o", new: str = "n"):
    """Whether two nodes (structs) are the same: what the old one has must be equal; code by likeness; files and method names unless unknown."""
    o, n = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    unknown = lambda x: x.isNull() | x.contains("<unknown")
    ok = unknown(o("file_path")) | unknown(n("file_path")) | (o("file_path") == n("file_path"))
    ok &= o("label").isNull() | o("label").eqNullSafe(n("label"))
    ok &= o("name").isNull() | o("name").eqNullSafe(n("name"))
    ok &= (o("label") != "METHOD") | o("full_name").eqNullSafe(n("full_name"))
    ok &= unknown(o("method_full_name")) | unknown(n("method_full_name")) | (o("method_full_name") == n("method_full_name"))
    return ok & (o("code").isNull() | alike(o("code"), F.coalesce(n("code"), F.lit(""))))


def corresponding(old: DataFrame, new: DataFrame, hunks: DataFrame) -> DataFrame:
    """repo, old, new: for each old node the first node of the next commit (by ord) on the line it moved to, in the same file, that is the same node."""
    rows = old.where("line is not null and file_path is not null").withColumn("file", F.col("file_path"))
    moved = shifted(rows.select("repo", "file", "line", "node"), hunks.select("repo", "file", "old_start", "old_count", "new_count"), ["repo", "file"])
    o = moved.join(old, ["repo", "node", "line"]).select("repo", "file", "new_line", F.struct(*old.columns).alias("o"))
    n = new.select("repo", F.col("file_path").alias("file"), F.col("line").alias("new_line"), F.struct(*new.columns).alias("n"))
    hit = o.join(n, ["repo", "file", "new_line"]).where(same_node())
    return hit.groupBy("repo", F.col("o.node").alias("old")).agg(F.min_by("n.node", F.struct("n.ord", "n.node")).alias("new"))


def likely(old: DataFrame, new: DataFrame, old_edges: DataFrame, new_edges: DataFrame, least: float = 0.9) -> DataFrame:
    """repo, old, new: within a file, the most alike pair by neighbourhoods, at least this alike; ties go to the first new node by ord.

    A pair's likeness is the share of the larger neighbourhood that matches one to one, taken in order of node; two
    nodes without neighbours are as alike as they are the same. Each (repo, file) is a group of its own.
    """

    def sides(nodes, edges, side):
        near = edges.select("repo", "src", "dst").unionByName(reversed_edges(edges.select("repo", "src", "dst"))).distinct().join(nodes.select("repo", F.col("node").alias("dst"), F.concat_ws("\x1f", "label", "name", "code").alias("text")), ["repo", "dst"])
        near = near.groupBy("repo", F.col("src").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dst", "text"))), lambda x: x["text"]).alias("near"))
        return nodes.join(near, ["repo", "node"], "left").select("repo", F.col("file_path").alias("file"), F.lit(side).alias("side"), "node", "ord", F.concat_ws("\x1f", "label", "name", "code").alias("own"), F.coalesce("near", F.array().cast("array<string>")).alias("near"))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0].sort_values("ord"), pdf[pdf.side == 1].sort_values("ord")
        out = []
        for x in a.itertuples():
            best, at = least - 1e-12, None
            for y in b.itertuples():
                if not len(x.near) and not len(y.near):
                    s = 1.0 if indel_ratio(x.own, y.own) >= 90 else 0.0
                else:
                    free, n = list(y.near), 0
                    for t in x.near:
                        k = next((i for i, u in enumerate(free) if indel_ratio(t, u) >= 90), None)
                        if k is not None:
                            free.pop(k)
                            n += 1
                    s = n / max(len(x.near), len(y.near))
                if s > best:
                    best, at = s, y.node
            if at is not None:
                out.append((x.repo, x.node, at))
        return pd.DataFrame(out, columns=["repo", "old", "new"])

    node = dict(old.dtypes)["node"]
    return sides(old, old_edges, 0).unionByName(sides(new, new_edges, 1)).groupBy("repo", "file").applyInPandas(match, f"repo string, old {node}, new {node}")


def carried(taint_nodes: DataFrame, taint_edges: DataFrame, mapping: DataFrame, new_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A taint graph renamed to the next commit's nodes: what has no counterpart goes; new attributes win and the old id is kept as origin."""
    m = mapping.select("repo", F.col("old").alias("node"), "new")
    moved = taint_nodes.join(m, ["repo", "node"]).withColumn("origin", F.col("node")).withColumn("node", F.col("new")).drop("new")
    own = new_nodes.join(moved.select("repo", "node"), ["repo", "node"], "left_semi")
    nodes = compose(moved.drop("origin"), own.select(*[c for c in moved.columns if c in own.columns]), key=["repo", "node"]).join(moved.select("repo", "node", "origin").dropDuplicates(["repo", "node"]), ["repo", "node"])
    e = taint_edges
    for side in ("src", "dst"):
        e = e.join(m.select("repo", F.col("node").alias(side), "new"), ["repo", side]).withColumn(side, F.col("new")).drop("new")
    return nodes, e.distinct()


def updated(found: DataFrame, taint_edges: DataFrame, nodes: DataFrame, edges: DataFrame, added: DataFrame, api: DataFrame, keys: list[str] = K, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A carried taint graph (found: keys, node) with what added lines (keys, file, line) bring: nodes on them that depend on tainted ones or are sensitive calls, traced and grown."""
    lines = added.withColumnRenamed("file", "file_path").distinct()
    on = nodes.where("label <> 'METHOD_RETURN'").join(lines, [*keys, "file_path", "line"], "left_semi")
    both = edges.where("coalesce(label, '') <> '' and trim(label) <> 'DDG:'").select(*keys, "src", "dst")
    both = both.unionByName(reversed_edges(both))
    near = on.join(both.join(found.withColumnRenamed("node", "src"), [*keys, "src"], "left_semi").select(*keys, F.col("dst").alias("node")).distinct(), [*keys, "node"], "left_semi").select(*keys, "node")
    seeds = near.unionByName(sensitive_calls(on, api, None, keys)).distinct()
    more, used = trace(seeds, edges, nodes, keys)
    return grown(settle(found.unionByName(more).distinct()), settle(taint_edges.unionByName(used).distinct()), nodes, edges, keys, files=files)


def outer_roots(nodes: DataFrame, entry_files: DataFrame, keys: list[str] = K) -> DataFrame:
    """METHOD nodes with is_outer: a module with entry code, or a top-level function."""
    inner = F.regexp_replace("full_name", r"^.*<module>\.?", "")
    m = nodes.where("label = 'METHOD' and name not like '%<metaClassAdapter>' and name not like '%<lambda>%'")
    e = entry_files.select(*keys, "file_path", F.lit(True).alias("_entry"))
    out = m.join(e, [*keys, "file_path"], "left")
    return out.withColumn("is_outer", F.when(F.col("name") == "<module>", F.coalesce("_entry", F.lit(False))).otherwise(~inner.contains("."))).drop("_entry")


def sensitive_subgraphs(roots: DataFrame, nodes: DataFrame, taint_edges: DataFrame, keys: list[str] = K) -> DataFrame:
    """keys, root, node for each root (keys, node, file_path, is_outer) that reaches a sensitive node.

    A walk goes on to all successors and to predecessors that are methods, but for callers, and not into files that
    another outer root owns. Predecessors that are calls, and the companions of methods (by full_name, where nodes have
    it), are added to what it has passed; the walk doesn't go on from them.
    """
    pair = [*keys, "src", "dst"]
    calls = taint_edges.where("label in ('FUNCTION_CALL', 'SUB_FUNCTION_CALL')").select(*pair)
    before = taint_edges.select(*pair).distinct().join(calls, pair, "left_anti").select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    owned = roots.where("is_outer").select(*keys, "file_path").distinct().withColumn("_owned", F.lit(True))
    kind = nodes.select(*keys, F.col("node").alias("dst"), "label", "file_path").join(owned, [*keys, "file_path"], "left")
    before = before.join(kind, [*keys, "dst"]).where("label in ('CALL', 'METHOD')")
    steps = taint_edges.select(*pair).join(kind, [*keys, "dst"], "left")
    steps = settle(steps.unionByName(before.where("label = 'METHOD'")).select(*pair, "file_path", "_owned").distinct())
    free = F.col("_owned").isNull() | (F.col("file_path") == F.col("home"))
    ahead = lambda at, to: at.withColumnRenamed("node", "src").join(to, [*keys, "src"]).where(free).select(*keys, "root", F.col("dst").alias("node"), "home").distinct()
    frontier = seen = settle(roots.select(*keys, F.col("node").alias("root"), "node", F.col("file_path").alias("home")))
    while not frontier.isEmpty():
        frontier = settle(ahead(frontier, steps).join(seen, [*keys, "root", "node"], "left_anti"))
        seen = settle(seen.unionByName(frontier))
    out = seen.unionByName(ahead(seen, before.where("label = 'CALL'")))
    if "full_name" in nodes.columns:
        own = seen.join(nodes.where("label = 'METHOD'").select(*keys, "node", F.explode(companions("full_name")).alias("full_name")), [*keys, "node"]).drop("node")
        out = out.unionByName(own.join(nodes.select(*keys, "node", "full_name"), [*keys, "full_name"]).drop("full_name"))
    hot = seen.join(nodes.where("is_sensitive").select(*keys, "node"), [*keys, "node"], "left_semi").select(*keys, "root").distinct()
    return out.select(*keys, "root", "node").distinct().join(hot, [*keys, "root"], "left_semi")


def slices_by_file(sub: DataFrame, nodes: DataFrame, roots: DataFrame, keys: list[str] = K) -> DataFrame:
    """Per file of roots one slice: its roots by line, name and id, and the union of their nodes."""
    r = roots.select(*keys, F.col("node").alias("root"), "file_path", "line", "name", "is_outer")
    named = sub.join(r, [*keys, "root"])
    listed = F.array_sort(F.collect_set(F.struct("line", "name", "root", "is_outer")))
    return named.groupBy(*keys, "file_path").agg(listed.alias("roots"), F.array_sort(F.collect_set("node")).alias("node_ids"), F.bool_or("is_outer").alias("has_outer_root"))


def attached(slices: DataFrame, score: DataFrame, keys: list[str] = K) -> DataFrame:
    """keys, helper, anchor: slices (keys, id, node_ids, has_outer_root) without an outer root joined to the anchor of best reference score (score: keys, helper, anchor, score), then of most shared nodes; none if both are 0. Anchors are tried in order of id and the first of equal ones stays."""
    helpers = slices.where("not has_outer_root").select(*keys, F.col("id").alias("helper"), F.explode("node_ids").alias("node"))
    anchors = slices.where("has_outer_root").select(*keys, F.col("id").alias("anchor"), F.explode("node_ids").alias("node"))
    shared = helpers.join(anchors, [*keys, "node"]).groupBy(*keys, "helper", "anchor").agg(F.count("*").alias("n"))
    both = shared.join(score, [*keys, "helper", "anchor"], "full").select(*keys, "helper", "anchor", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("n", F.lit(0)).alias("n")).where("score > 0 or n > 0")
    w = Window.partitionBy(*keys, "helper").orderBy(F.desc("score"), F.desc("n"), "anchor")
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def reference_scores(anchors: DataFrame, helpers: DataFrame, keys: list[str] = K) -> DataFrame:
    """keys, helper, anchor, score: how anchors' source (id, content) names helpers' modules (id, modules) and symbols (symbols): 100 for an import from, 100 for an import, 20 for a use, for each module name; 60 for an imported symbol and 40 for a called one.

    Pairs are made only where an anchor's identifiers hold a part of a helper's names.
    """
    words = F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))
    a = anchors.select(*keys, F.col("id").alias("anchor"), "content", F.explode(words).alias("word"))
    parts = F.array_distinct(F.concat(F.transform("modules", lambda m: F.substring_index(m, ".", -1)), F.col("symbols")))
    h = helpers.select(*keys, F.col("id").alias("helper"), "modules", "symbols", F.explode(parts).alias("word"))
    pairs = a.join(h, [*keys, "word"]).where("anchor <> helper").groupBy(*keys, "anchor", "helper").agg(F.first("content").alias("content"), F.first("modules").alias("modules"), F.first("symbols").alias("symbols"))
    quoted = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    hit = lambda pre, x, post, n: F.when(F.rlike("content", F.concat(F.lit(pre), quoted(x), F.lit(post))), n).otherwise(0)
    by_module = F.aggregate("modules", F.lit(0), lambda s, m: s + hit(r"(?m)^\s*from\s+\.*", m, r"\s+import\b", 100) + hit(r"(?m)^\s*import\s+.*\b", m, r"\b", 100) + hit(r"\b", m, r"\.\w", 20))
    by_symbol = F.aggregate("symbols", F.lit(0), lambda s, m: s + hit(r"(?m)^\s*from\s+\S+\s+import\s+.*\b", m, r"\b", 60) + hit(r"\b", m, r"\s*\(", 40))
    return pairs.select(*keys, "helper", "anchor", (by_module + by_symbol).alias("score")).where("score > 0")


def changed(slices: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """slices (keys, signature) with is_new: no slice of the same keys before has the same text; an empty one before never counts."""
    b = before.where("signature <> ''").select(*keys, F.sha2("signature", 256).alias("_h")).distinct().withColumn("_same", F.lit(True))
    out = slices.withColumn("_h", F.sha2("signature", 256)).join(b, [*keys, "_h"], "left")
    return out.withColumn("is_new", F.col("_same").isNull()).drop("_h", "_same")


def followed(commits: DataFrame, nodes: DataFrame, edges: DataFrame, hunks: DataFrame, added: DataFrame, api: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The taint graphs of all commits (repo, commit, node, is_sensitive; repo, commit, src, dst, label), all repos together, a commit's number after the other.

    commits: repo, commit, ord, base (the commit to start from; null builds anew). hunks and added lines have repo,
    commit and file, from base to commit. A base must have a smaller number.
    """
    of = lambda df, own: df.join(own.select(*K), K, "left_semi")
    all_nodes = all_edges = None
    for (n,) in sorted(commits.select("ord").distinct().collect()):
        now = settle(commits.where(F.col("ord") == n))
        fresh = now.where("base is null")
        found, used = built(of(nodes, fresh), of(edges, fresh), api, files=files)
        if all_nodes is not None:
            later = now.where("base is not null")
            base = later.select("repo", F.col("base").alias("commit"), F.col("commit").alias("_now"))
            at = lambda df: df.join(base, K).drop("commit").withColumnRenamed("_now", "commit")  # noqa: E731, B023
            own, own_edges = of(nodes, later), of(edges, later)
            before = at(nodes.join(all_nodes, [*K, "node"], "left_semi"))
            mapping = settle(corresponding(before, own, of(hunks, later)))
            kept, kept_edges = carried(at(all_nodes).drop("commit"), at(all_edges).drop("commit"), mapping, own.select("repo", "node"))
            kept = settle(kept.groupBy("repo", "node").agg(F.bool_or("is_sensitive").alias("is_sensitive")).join(later.select(*K), "repo"))
            grown_nodes, grown_edges = updated(kept.select(*K, "node"), kept_edges.join(later.select(*K), "repo").select(*K, "src", "dst", "label"), own, own_edges, of(added, later), api, files=files)
            hot = kept.where("is_sensitive").select(*K, "node").unionByName(sensitive_calls(own, api, own_edges if "argument_index" in nodes.columns else None)).distinct().withColumn("_s", F.lit(True))
            found = found.unionByName(grown_nodes.join(hot, [*K, "node"], "left").select(*K, "node", F.coalesce("_s", F.lit(False)).alias("is_sensitive")))
            used = used.unionByName(grown_edges.select(*K, "src", "dst", "label"))
        all_nodes = settle(found if all_nodes is None else all_nodes.unionByName(found))
        all_edges = settle(used if all_edges is None else all_edges.unionByName(used.select(*all_edges.columns)))
    return all_nodes, all_edges
