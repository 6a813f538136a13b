"""Graphs in DOT files as node and edge tables."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ID = r'(?:"(?:[^"\\]|\\.)*"|[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*|-?\d+(?:\.\d+)?|<(?:[^<>]|<[^<>]*>)*>)'
_TOKEN = re.compile(rf"\s*(?:(//[^\n]*|/\*.*?\*/|\#[^\n]*)|({_ID})|(->|--)|([\[\]{{}}=;,]))", re.S)


def _plain(x: str) -> str:
    if x.startswith('"'):
        return html.unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], x[1:-1]))
    return html.unescape(x[1:-1]) if x.startswith("<") else x


def parse(content: str) -> tuple[list, list]:
    """(node, attributes) and (src, dst, key, attributes) of a directed graph; a multigraph's parallel edges are numbered."""
    tokens = [(m[2], m[3] or m[4]) for m in _TOKEN.finditer(content or "") if m[2] or m[3] or m[4]]
    nodes: dict[str, dict] = {}
    edges, count, i = [], {}, 0

    def attributes(i):
        out = {}
        while i < len(tokens) and tokens[i][1] == "[":
            i += 1
            while i < len(tokens) and tokens[i][1] != "]":
                if tokens[i][0] and i + 2 < len(tokens) and tokens[i + 1][1] == "=":
                    out[_plain(tokens[i][0])] = _plain(tokens[i + 2][0] or "")
                    i += 3
                else:
                    i += 1
            i += 1
        return out, i

    while i < len(tokens) and tokens[i][1] != "{":
        i += 1
    i += 1
    while i < len(tokens):
        name = tokens[i][0]
        if name is None:
            i += 1
        elif name in ("graph", "node", "edge") and i + 1 < len(tokens) and tokens[i + 1][1] == "[":
            _, i = attributes(i + 1)
        elif i + 1 < len(tokens) and tokens[i + 1][1] == "=":
            i += 3
        else:
            chain, i = [_plain(name)], i + 1
            while i + 1 < len(tokens) and tokens[i][1] in ("->", "--"):
                chain.append(_plain(tokens[i + 1][0] or ""))
                i += 2
            attrs, i = attributes(i)
            for x in chain:
                nodes.setdefault(x, {})
            if len(chain) == 1:
                nodes[chain[0]].update(attrs)
            for a, b in zip(chain, chain[1:]):
                k = count[a, b] = count.get((a, b), -1) + 1
                edges.append((a, b, k, attrs))
    return list(nodes.items()), edges


def graphs(spark: SparkSession, path: str, glob: str = "*.dot") -> tuple[DataFrame, DataFrame]:
    """Nodes (graph, node, ord, attrs) and edges (graph, src, dst, key, label, attrs) of the files below a root; graph is the file's relative path."""
    from .tables import files

    raw = files(spark, path, glob).select("path", F.decode("content", "UTF-8").alias("body"))

    def read(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                ns, es = parse(r.body)
                rows += [(r.path, True, n, None, i, a) for i, (n, a) in enumerate(ns)]
                rows += [(r.path, False, s, d, k, a) for s, d, k, a in es]
            yield pd.DataFrame(rows, columns=["graph", "is_node", "a", "b", "n", "attrs"])

    both = raw.mapInPandas(read, "graph string, is_node boolean, a string, b string, n int, attrs map<string,string>")
    nodes = both.where("is_node").select("graph", F.col("a").alias("node"), F.col("n").alias("ord"), "attrs")
    edges = both.where("not is_node").select("graph", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("key"), F.try_element_at("attrs", F.lit("label")).alias("label"), "attrs")
    return nodes, edges


def code_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with the attributes of code property graphs as columns."""
    at = lambda k: F.try_element_at("attrs", F.lit(k))
    num = lambda k: at(k).try_cast("int")
    return nodes.select("*", at("label").alias("label"), at("NAME").alias("name"), at("FULL_NAME").alias("full_name"), at("METHOD_FULL_NAME").alias("method_full_name"), at("DYNAMIC_TYPE_HINT_FULL_NAME").alias("dynamic_type_hint"), at("CODE").alias("code"), at("ARGUMENT_NAME").alias("argument_name"), num("ARGUMENT_INDEX").alias("argument_index"), num("LINE_NUMBER").alias("line"), num("LINE_NUMBER_END").alias("line_end"), num("COLUMN_NUMBER").alias("column"), at("FILENAME").alias("file_path"))


def rendered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph and text: each graph as a DOT file."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    listed = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(quote(e["key"]), F.lit("="), quote(e["value"]))), " ")
    n = nodes.select("graph", F.lit(0).alias("part"), "ord", F.concat(quote(F.col("node")), F.lit(" ["), listed(F.col("attrs")), F.lit("];")).alias("x"))
    e = edges.select("graph", F.lit(1).alias("part"), F.col("key").alias("ord"), F.concat(quote(F.col("src")), F.lit(" -> "), quote(F.col("dst")), F.lit(" ["), listed(F.col("attrs")), F.lit("];")).alias("x"))
    lines = n.unionByName(e).groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("part", "ord", "x"))).alias("l"))
    return lines.select("graph", F.concat(F.lit("digraph {\n"), F.array_join(F.transform("l", lambda r: r["x"]), "\n"), F.lit("\n}\n")).alias("text"))
