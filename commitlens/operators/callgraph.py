"""Call graphs from Python sources: functions, calls, categories, traces and a rendered context."""

from __future__ import annotations

import ast
import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .graphs import reach, reversed_edges, spread

# Folders that are skipped, and what marks an entry.
SKIPPED = ["venv", ".venv", "site-packages", "node_modules", "__pycache__", ".git", "build"]
ENTRY_DECORATORS = ["app.route", "click.command", "route(", "command(", "celery.task", "task("]
ENTRY_BODIES = ["threading.Thread", "multiprocessing.Process", "Timer(", "subprocess.Popen"]
#: Categories by what a callee's name holds.
KEYWORDS = {
    "network": ["requests.", "urllib", "socket", "http.client", "ftplib", "aiohttp"],
    "process": ["subprocess", "os.system", "os.popen", "pty.spawn"],
    "file": ["open", "shutil", "os.remove", "pathlib"],
    "crypto": ["hashlib", "Crypto", "cryptography", "base64"],
    "dynamic": ["eval", "exec", "__import__", "importlib", "compile"],
    "system": ["ctypes", "winreg", "os.environ", "platform", "getpass"],
}
#: Callees that never count, whatever they hold.
SKIPPED_CALLEES = ["logging.", "unittest", "pytest"]


def read_module(content: str) -> dict:
    """Functions and calls of a module, by qualified name; imports by the name they bind."""
    empty = {"functions": [], "calls": [], "imports": []}
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError):
        return empty
    lines = content.split("\n")
    functions, calls, imports = [], [], []

    def dotted(x):
        if isinstance(x, ast.Name):
            return x.id
        if isinstance(x, ast.Attribute):
            base = dotted(x.value)
            return f"{base}.{x.attr}" if base else None
        return None

    def body_calls(f, qualified):
        todo = list(ast.iter_child_nodes(f))
        while todo:
            x = todo.pop()
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(x, ast.Call) and (name := dotted(x.func)):
                calls.append({"caller": qualified, "callee": name, "line": x.lineno})
            todo += ast.iter_child_nodes(x)

    def walk(node, classes):
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.ClassDef):
                walk(x, [*classes, x.name])
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                first = min([x.lineno, *(d.lineno for d in x.decorator_list)])
                text = "\n".join(lines[first - 1 : x.end_lineno])
                marks = [ast.unparse(d) for d in x.decorator_list]
                qualified = ".".join([*classes, x.name])
                entry = any(p.rstrip("(") in m for m in marks for p in ENTRY_DECORATORS) or any(p in text for p in ENTRY_BODIES)
                functions.append({"name": x.name, "qualified_name": qualified, "start_line": first, "end_line": x.end_lineno, "source_hash": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), "is_entry": entry})
                body_calls(x, qualified)
            elif isinstance(x, ast.Import):
                imports.extend({"name": a.asname or a.name.split(".")[0], "module": a.name if a.asname else a.name.split(".")[0], "member": ""} for a in x.names)
            elif isinstance(x, ast.ImportFrom):
                imports.extend({"name": a.asname or a.name, "module": "." * x.level + (x.module or ""), "member": a.name} for a in x.names)
            elif not isinstance(x, ast.expr):
                walk(x, classes)

    walk(tree, [])
    return {"functions": functions, "calls": calls, "imports": imports}


def _rows(**fields) -> ArrayType:
    return ArrayType(StructType([StructField(k, t) for k, t in fields.items()]))


_S, _I = StringType(), IntegerType()
_SCHEMA = StructType([
    StructField("functions", _rows(name=_S, qualified_name=_S, start_line=_I, end_line=_I, source_hash=_S, is_entry=BooleanType())),
    StructField("calls", _rows(caller=_S, callee=_S, line=_I)),
    StructField("imports", _rows(name=_S, module=_S, member=_S)),
])


@F.pandas_udf(_SCHEMA)
def _read(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_module(c) for c in content], columns=["functions", "calls", "imports"])


def read(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path and parsed (functions, calls, imports) of the Python files outside skipped folders; each is parsed once."""
    own = files.where(F.lower("path").endswith(".py") & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in SKIPPED])))
    return own.select(*keys, "path", _read("content").alias("parsed"))


def functions(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Function nodes: key (path:qualified_name) and what describes them."""
    rows = parsed.select(*keys, "path", F.inline("parsed.functions"))
    return rows.select(*keys, F.concat_ws(":", "path", "qualified_name").alias("node"), *[c for c in rows.columns if c not in keys])


def _module_path(name):
    return F.concat(F.replace(name, F.lit("."), F.lit("/")), F.lit(".py"))


def calls(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Call edges: src, dst, line, is_external. A callee is, in this order: of the own class (self, cls), a function of the file, one of an imported module or an imported function of a project file, else EXTERNAL:name with imported names written out."""
    f = functions(parsed, keys).select(*keys, F.col("path").alias("_p"), F.col("qualified_name").alias("_q"), F.col("node").alias("_n"))
    files = parsed.select(*keys, F.col("path").alias("_file")).distinct()
    rows = parsed.select(*keys, "path", F.inline("parsed.calls")).withColumn("_head", F.substring_index("callee", ".", 1))
    rest = F.when(F.instr("callee", ".") > 0, F.expr("substring(callee, instr(callee, '.') + 1)")).otherwise("")
    rows = rows.withColumn("_rest", rest)
    imports = parsed.select(*keys, "path", F.inline("parsed.imports")).dropDuplicates([*keys, "path", "name"])
    # relative modules: each dot beyond the first goes a folder up
    ups = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    folder = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - ups, F.lit(0))), "/")
    tail = F.regexp_replace("module", r"^\.+", "")
    module = F.when(ups > 0, F.concat_ws(".", F.nullif(F.replace(folder, F.lit("/"), F.lit(".")), F.lit("")), F.nullif(tail, F.lit("")))).otherwise(F.col("module"))
    imports = imports.select(*keys, "path", F.col("name").alias("_head"), module.alias("_module"), F.col("member").alias("_member"))
    rows = rows.join(imports, [*keys, "path", "_head"], "left")
    owner = F.when(F.instr("caller", ".") > 0, F.regexp_replace("caller", r"\.[^.]*$", ""))
    local = F.when(F.col("_head").isin("self", "cls"), F.concat_ws(".", owner, F.col("_rest"))).otherwise(F.col("callee"))
    target = F.when(F.col("_member") == "", F.col("_rest")).when(F.col("_rest") == "", F.col("_member")).otherwise(F.concat_ws(".", "_member", "_rest"))
    rows = rows.withColumns({"_local": local, "_target": target, "_file": _module_path(F.col("_module")), "_sub": _module_path(F.concat_ws(".", "_module", "_member"))})
    same = f.select(*keys, F.col("_p").alias("path"), F.col("_q").alias("_local"), F.col("_n").alias("_own"))
    far = f.select(*keys, F.col("_p").alias("_file"), F.col("_q").alias("_target"), F.col("_n").alias("_far"))
    sub = f.select(*keys, F.col("_p").alias("_sub"), F.col("_q").alias("_rest"), F.col("_n").alias("_of_sub"))
    rows = rows.join(same, [*keys, "path", "_local"], "left").join(far, [*keys, "_file", "_target"], "left").join(sub, [*keys, "_sub", "_rest"], "left").join(files.withColumn("_in", F.lit(True)), [*keys, "_file"], "left")
    full = F.when(F.col("_module").isNotNull(), F.concat_ws(".", "_module", F.nullif("_target", F.lit("")))).otherwise(F.col("callee"))
    dst = F.coalesce("_own", "_far", "_of_sub", F.concat(F.lit("EXTERNAL:"), full))
    return rows.select(*keys, F.concat_ws(":", "path", "caller").alias("src"), dst.alias("dst"), "line", F.coalesce("_own", "_far", "_of_sub").isNull().alias("is_external"))


def categories(edges: DataFrame, keys: list[str], keywords: dict[str, list[str]] = KEYWORDS, skipped: list[str] = SKIPPED_CALLEES) -> DataFrame:
    """keys, node, category: callers by what their external callees' names hold, unless the name is to be skipped."""
    held = F.array(*[F.when(_any(words), F.lit(k)) for k, words in keywords.items()])
    own = edges.where(F.col("is_external") & ~_any(skipped))
    return own.select(*keys, F.col("src").alias("node"), F.explode(F.filter(held, lambda x: x.isNotNull())).alias("category")).distinct()


def _any(words: list[str]):
    out = F.lit(False)
    for w in words:
        out |= F.col("dst").contains(w)
    return out


def tagged(edges: DataFrame, keys: list[str], max_rounds: int = 20) -> DataFrame:
    """categories spread from callees to callers."""
    return spread(categories(edges, keys), edges.where("not is_external"), keys, max_rounds)


def callees(start: DataFrame, edges: DataFrame, tags: DataFrame, keys: list[str], max_depth: int = 5) -> DataFrame:
    """keys, root, node, depth: the calls below each start node; only nodes with a category are looked into."""
    seeds = start.select(*keys, F.col("node").alias("root"), "node")
    return reach(seeds, edges, [*keys, "root"], max_depth, tags.select(*keys, "node").distinct()).where("depth > 0")


def callers(start: DataFrame, edges: DataFrame, entries: DataFrame, keys: list[str], max_depth: int = 5) -> DataFrame:
    """keys, root, node, depth, is_entry: the callers above each start node, not beyond entries."""
    seeds = start.select(*keys, F.col("node").alias("root"), "node")
    ends = entries.select(*keys, "node").distinct()
    every = edges.select(*keys, F.col("dst").alias("node")).unionByName(edges.select(*keys, F.col("src").alias("node"))).distinct()
    on = every.join(ends, [*keys, "node"], "left_anti")
    out = reach(seeds, reversed_edges(edges), [*keys, "root"], max_depth, on, seeds_expand=True).where("depth > 0")
    return out.join(ends.withColumn("_e", F.lit(True)), [*keys, "node"], "left").withColumn("is_entry", F.coalesce("_e", F.lit(False))).drop("_e")


def context(start: DataFrame, up: DataFrame, down: DataFrame, sources: DataFrame, keys: list[str], most_up: int = 2, most_down: int = 10, most_lines: int = 200) -> DataFrame:
    """One text per start node: itself, its nearest callers (entries first) and callees, with their sources (keys, node, text) up to so many lines."""
    w = lambda *o: Window.partitionBy(*keys, "root").orderBy(*o, "node")
    u = up.withColumn("rank", F.row_number().over(w(F.desc("is_entry"), "depth"))).where(F.col("rank") <= most_up).select(*keys, "root", "node", F.lit(1).alias("part"), "rank")
    d = down.withColumn("rank", F.row_number().over(w("depth"))).where(F.col("rank") <= most_down).select(*keys, "root", "node", F.lit(2).alias("part"), "rank")
    own = start.select(*keys, F.col("node").alias("root"), "node", F.lit(0).alias("part"), F.lit(0).alias("rank"))
    rows = own.unionByName(u).unionByName(d).join(sources, [*keys, "node"], "left")
    head = F.get(F.array(F.lit("# changed "), F.lit("# caller "), F.lit("# callee ")), "part")
    block = F.concat(head, "node", F.lit("\n"), F.coalesce("text", F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct("part", "rank", block.alias("x"))))
    text = rows.groupBy(*keys, "root").agg(F.array_join(F.transform(listed, lambda s: s["x"]), "\n").alias("text"))
    return text.withColumn("text", F.array_join(F.slice(F.split("text", "\n"), 1, most_lines), "\n"))


def updated(old_nodes: DataFrame, old_edges: DataFrame, old_tags: DataFrame, changed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and tags after files changed (a parsed table of the new versions): their own are replaced, and categories spread again. Tags of callers only grow."""
    paths = changed.select(*keys, "path").distinct()
    nodes = old_nodes.join(paths, [*keys, "path"], "left_anti").unionByName(functions(changed, keys))
    gone = old_edges.withColumn("path", F.substring_index("src", ":", 1)).join(paths, [*keys, "path"], "left_anti").drop("path")
    edges = gone.unionByName(calls(changed, keys))
    own = old_tags.join(nodes.select(*keys, "node"), [*keys, "node"], "left_semi").unionByName(categories(edges, keys)).distinct()
    return nodes, edges, spread(own, edges.where("not is_external"), keys)
