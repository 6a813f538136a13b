"""Lines and the spans of source code around them."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Levels of halves in a bucket, and lines to a bucket.
LEVELS = 6
BUCKET = 1 << LEVELS

_BLOCKS = (ast.If, ast.For, ast.While, ast.Try, ast.With, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.AsyncFor, ast.AsyncWith, ast.Match)
_SIMPLE = (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Expr, ast.Return, ast.Raise, ast.Delete, ast.Assert)


def _ranges(first, last) -> Column:
    """The aligned ranges that make up the lines first to last of a bucket, two a level at most, some null: numbered as in a heap, 1 for the whole bucket, BUCKET + i for line i."""
    out = []
    for j in range(LEVELS + 1):
        lo, hi = F.shiftright(first + (BUCKET + (1 << j) - 1), j), F.shiftright(last + (BUCKET + 1), j)
        out += [F.when((lo < hi) & (lo % 2 == 1), lo), F.when((lo < hi) & (hi % 2 == 1), hi - 1)]
    return F.array(*out)


def innermost(lines: DataFrame, spans: DataFrame, keys: list[str], kinds: list[str] | None = None) -> DataFrame:
    """lines (keys, line) with the smallest span (start_line, end_line and the spans' other columns) that holds them; of equal ones the one that starts last. Lines without a span go.

    No line meets all spans around it: a span is dealt to the aligned ranges of its buckets, each range keeps its best
    span, and a line looks at the LEVELS + 1 ranges that hold it. Line numbers have 32 bits.
    """
    own = spans if kinds is None else spans.where(F.col("kind").isin(kinds))
    own = own.where("start_line <= end_line")
    first, last = F.col("start_line").cast("int"), F.col("end_line").cast("int")
    # the best span of a range as one number, so that it is summed up without sorting: its size, then how early it starts
    rank = F.shiftleft(last.cast("long") - first, 32) + (F.lit(2**31 - 1).cast("long") - first)
    dealt = own.select(*keys, first.alias("_first"), last.alias("_last"), rank.alias("_rank"))
    dealt = dealt.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_first") / BUCKET), F.floor(F.col("_last") / BUCKET))))
    at = F.col("_b") * BUCKET
    cut = F.greatest(F.col("_first") - at, F.lit(0)).cast("int"), F.least(F.col("_last") - at, F.lit(BUCKET - 1)).cast("int")
    dealt = dealt.select(*keys, "_b", "_rank", cut[0].alias("_from"), cut[1].alias("_to")).select(*keys, "_b", "_rank", F.explode(_ranges(F.col("_from"), F.col("_to"))).alias("_r"))
    best = dealt.where("_r is not null").groupBy(*keys, "_b", "_r").agg(F.min("_rank").alias("_rank"))
    best = best.groupBy(*keys, "_b").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_rank"))).alias("_best"))
    i = (F.col("line") - F.col("_b") * BUCKET + BUCKET).cast("int")
    # array_min passes over ranges without a span
    held = F.array_min(F.array(*[F.try_element_at("_best", F.shiftright(i, j)) for j in range(LEVELS + 1)]))
    hit = lines.distinct().withColumn("_b", F.floor(F.col("line") / BUCKET)).join(best, [*keys, "_b"]).select(*lines.columns, held.alias("_rank")).where("_rank is not null")
    start = F.lit(2**31 - 1).cast("long") - F.col("_rank").bitwiseAND(F.lit(2**32 - 1))
    hit = hit.select(*lines.columns, start.alias("_start"), (start + F.shiftright("_rank", 32)).alias("_end"))
    columns = [c for c in spans.columns if c not in keys]
    more = [c for c in columns if c not in ("start_line", "end_line")]
    kind = dict(spans.dtypes)
    bounds = [F.col("_start").cast(kind["start_line"]).alias("start_line"), F.col("_end").cast(kind["end_line"]).alias("end_line")]
    hit = hit.select(*lines.columns, *bounds)
    if more:
        # of spans over the same lines the first by the other columns
        named = own.groupBy(*keys, "start_line", "end_line").agg(F.min(F.struct(*more)).alias("_s"))
        hit = hit.join(named, [*keys, "start_line", "end_line"])
    return hit.select(*lines.columns, *[F.col(c if c in ("start_line", "end_line") else f"_s.{c}") for c in columns])


def read_spans(content: str) -> list[dict]:
    """Spans of a module: functions, classes and blocks over more than a line, with the lines each stands for. None where the source does not parse."""
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError):
        return []
    out: list[dict] = []

    def put(node, kind, name, qualified, parent):
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        lines = {first, node.lineno, node.end_lineno}
        if isinstance(node, (ast.With, ast.AsyncWith, *_SIMPLE)):
            lines |= set(range(first, node.end_lineno + 1))
        if isinstance(node, ast.Try):
            lines |= {h.lineno for h in node.handlers} | {part[0].lineno - 1 for part in (node.orelse, node.finalbody) if part}
        if isinstance(node, ast.If) and node.orelse:
            lines.add(node.orelse[0].lineno if isinstance(node.orelse[0], ast.If) and node.orelse[0].col_offset == node.col_offset else node.orelse[0].lineno - 1)
        out.append({"kind": kind, "name": name, "qualified_name": qualified, "start_line": first, "end_line": node.end_lineno, "parent_kind": parent, "lines": sorted(lines)})

    def walk(node, classes, parent):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                put(child, "function", child.name, ".".join(["<module>", *classes, child.name]), parent)
                walk(child, classes, "function")
            elif isinstance(child, ast.ClassDef):
                put(child, "class", child.name, ".".join(["<module>", *classes, child.name]), parent)
                walk(child, [*classes, child.name], "class")
            elif isinstance(child, (*_BLOCKS, *_SIMPLE)):
                if child.end_lineno > child.lineno:
                    put(child, "block", type(child).__name__, "", parent)
                walk(child, classes, "block")
            else:
                walk(child, classes, parent)

    walk(tree, [], "module")
    return out


def spans(files: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    """keys and the spans of every source file."""

    @F.pandas_udf("array<struct<kind:string,name:string,qualified_name:string,start_line:int,end_line:int,parent_kind:string,lines:array<int>>>")
    def read(s: pd.Series) -> pd.Series:
        return s.map(read_spans)

    return files.select(*keys, F.inline(read(F.col(column))))


def import_lines(files: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    """keys and line: every line of every import statement at any depth."""

    @F.pandas_udf("array<int>")
    def read(s: pd.Series) -> pd.Series:
        def one(content):
            try:
                tree = ast.parse(content or "")
            except (SyntaxError, ValueError):
                return []
            return sorted({n for x in ast.walk(tree) if isinstance(x, (ast.Import, ast.ImportFrom)) for n in range(x.lineno, x.end_lineno + 1)})

        return s.map(one)

    return files.select(*keys, F.explode(read(F.col(column))).alias("line"))


@F.pandas_udf(BooleanType())
def has_entry_code(content: pd.Series) -> pd.Series:
    """Whether a module has a top-level statement beyond imports, definitions and bare strings; false where it does not parse."""

    def one(c):
        try:
            body = ast.parse(c or "").body
        except (SyntaxError, ValueError):
            return False
        return any(not isinstance(x, (ast.Import, ast.ImportFrom, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str)) for x in body)

    return content.map(one)


def enclosing_function(lines: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """lines (keys, with `file` among them, line) with function: file:<module>.A.f, file:<module> outside functions, null where the file is missing."""
    inner = innermost(lines, spans(files, keys), keys, ["function"]).select(*lines.columns, "qualified_name")
    known = files.select(*keys, F.lit(True).alias("_known"))
    out = lines.join(inner, lines.columns, "left").join(known, keys, "left")
    return out.select(*lines.columns, F.when(F.col("_known"), F.concat(F.col("file"), F.lit(":"), F.coalesce("qualified_name", F.lit("<module>")))).alias("function"))


def slice_text(nodes: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """One text per slice (keys of nodes but file and line): the nodes' lines, whole constructors, the ends of the blocks around them, and all import lines of their files, in order.

    nodes: slice columns, file, line; files: file key columns (within keys) and content.
    """
    at = [c for c in nodes.columns if c != "line"]
    group = [c for c in at if c not in keys or c != "file"]
    own = nodes.select(*at, "line").distinct()
    all_spans = spans(files, keys)
    near = innermost(own, all_spans, keys)
    init = innermost(own, all_spans, keys, ["function"]).where("name = '__init__'").select(*at, F.explode(F.sequence("start_line", "end_line")).alias("line"))
    block = near.select(*at, F.explode("lines").alias("line"))
    imports = own.select(*at).distinct().join(import_lines(files, keys), keys).select(*at, "line")
    wanted = own.unionByName(init).unionByName(block).unionByName(imports).distinct()
    text = files.select(*keys, F.posexplode(F.split("content", "\n")).alias("i", "text")).select(*keys, (F.col("i") + 1).alias("line"), "text")
    rows = wanted.join(text, [*keys, "line"])
    listed = F.array_sort(F.collect_list(F.struct("file", "line", F.rtrim("text").alias("text"))))
    return rows.groupBy(*[c for c in group if c != "file"]).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("text"))


def snapshot_roots(dirs: DataFrame) -> DataFrame:
    """Per version the directory of the best class (class, path relative to the version): the shallowest by length of path, then by name."""
    w = Window.partitionBy("package", "version").orderBy("class", F.length("path"), "path")
    return dirs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
