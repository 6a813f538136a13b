"""Queries over lines, texts, versions and graphs, on inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import diffs, text
from ..operators import callgraph, graphs, likeness, spans, taint
from .inputs import table
from .registry import query

# --- texts and versions


@query("text_signature", r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
n AS (SELECT doc_id, i, trim(regexp_replace(x, '[ \t]+', ' ', 'g')) AS x FROM l) SELECT d.doc_id, md5(coalesce(s.t, '')) AS signature FROM documents d LEFT JOIN (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM n WHERE x <> '' GROUP BY doc_id) s USING (doc_id)""")  # fmt: skip
def text_signature(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.signature("text").cast("binary")).alias("signature"))


@query("slice_change_flag", r"""WITH l AS (SELECT doc_id, source, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
n AS (SELECT doc_id, i, trim(regexp_replace(x, '[ \t]+', ' ', 'g')) AS x FROM l), s AS (SELECT d.doc_id, d.source, d.lang, coalesce(t, '') AS t FROM documents d LEFT JOIN (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM n WHERE x <> '' GROUP BY doc_id) USING (doc_id))
SELECT doc_id, NOT EXISTS (SELECT 1 FROM s b WHERE b.lang = 'en' AND b.source = s.source AND b.t = s.t AND b.t <> '') AS is_new FROM s""")  # fmt: skip
def slice_change_flag(spark, sf_dir):
    """Every document against the English ones: whether it is new to them."""
    own = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", text.signature("text").alias("signature"))
    return taint.changed(own.drop("lang"), own.where("lang = 'en'").drop("lang"), ["source"]).select("doc_id", "is_new")


_VERSION = "concat(CAST(p_size % 3 AS {t}), '.', CAST(p_size AS {t}), '.', CAST(p_partkey % 15 AS {t}), CASE WHEN p_partkey % 11 = 0 THEN '_benign' WHEN p_partkey % 13 = 0 THEN 'rc1' ELSE '' END)"


@query("version_order", f"""WITH v AS (SELECT DISTINCT p_brand, {_VERSION.format(t='VARCHAR')} AS version FROM part),
k AS (SELECT *, list_transform(string_split_regex(regexp_replace(version, '_benign$', ''), '[.-]'), lambda p: {{'kind': CASE WHEN regexp_matches(p, '^[0-9]+$') THEN 0 ELSE 1 END, 'num': coalesce(TRY_CAST(p AS BIGINT), 0), 'txt': CASE WHEN regexp_matches(p, '^[0-9]+$') THEN '' ELSE p END}}) AS key FROM v)
SELECT p_brand, version, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY key, version) AS INT) AS ord FROM k""")  # fmt: skip
def version_order(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_brand", F.expr(_VERSION.format(t="STRING")).alias("version")).distinct()
    return v.select("p_brand", "version", F.row_number().over(Window.partitionBy("p_brand").orderBy(text.version_key("version"), "version")).alias("ord"))


@query("fuzzy_pairs")
def fuzzy_pairs(spark, sf_dir):
    """Pairs of parts of one brand and size whose texts are alike."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.concat_ws(" ", "p_name", "p_type", (F.col("p_partkey") % 50).cast("string")).alias("code"))
    return likeness.row_pairs(p, ["p_brand", "p_size"], "p_partkey", "code").withColumn("ratio", F.round("ratio", 6))


# --- commits in order


@query("prev_commit_lag", "SELECT o_custkey AS repo, o_orderkey AS hash, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS base FROM orders WHERE o_orderstatus = 'F'")
def prev_commit_lag(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("hash"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("base"))


@query("nearest_ancestor_asof", "SELECT o_custkey AS repo, o_orderkey AS hash, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ancestor FROM orders")
def nearest_ancestor_asof(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("hash"), F.last(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")), ignorenulls=True).over(w).alias("ancestor"))


@query("preferred_branch", "SELECT o_custkey AS repo, arg_min(o_orderpriority, (CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderpriority)) AS branch FROM orders GROUP BY 1")
def preferred_branch(spark, sf_dir):
    """The preferred name, then the second, then the first by alphabet: here with priorities for branch names."""
    rank = F.when(F.col("o_orderpriority") == "3-MEDIUM", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(F.min_by("o_orderpriority", F.struct(rank, "o_orderpriority")).alias("branch"))


@query("commit_counts", "SELECT o_custkey AS repo, count(*) AS commit_count, count(*) FILTER (o_orderstatus = 'F') AS useful_commit_count FROM orders GROUP BY 1")
def commit_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(F.count("*").alias("commit_count"), F.count_if(F.col("o_orderstatus") == "F").alias("useful_commit_count"))


# --- hunks and spans

_HUNKS = "concat('f', CAST(o_custkey % 997 AS {t})) AS file, CAST(1 + o_orderkey % 200 AS INT) AS old_start, CAST(CAST(floor(o_totalprice) AS BIGINT) % 4 AS INT) AS old_count, CAST(1 + o_orderkey % 150 AS INT) AS new_start, CAST(CAST(floor(o_totalprice / 10) AS BIGINT) % 5 AS INT) AS new_count"
_LINES = "event_id, concat('f', CAST(user_id % 997 AS {t})) AS file, CAST(1 + event_id % 250 AS INT) AS line"
_HUNKS_SQL, _LINES_SQL = f"h AS (SELECT o_orderkey, {_HUNKS.format(t='VARCHAR')} FROM orders)", f"l AS (SELECT {_LINES.format(t='VARCHAR')} FROM events)"


def _exprs(columns: str) -> list[str]:
    from .inputs import _split

    return _split(columns.format(t="STRING"))


def _hunks(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", *_exprs(_HUNKS))


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*_exprs(_LINES))


@query("hunk_line_shift", f"WITH {_HUNKS_SQL}, {_LINES_SQL} SELECT event_id, file, line, CAST(line + coalesce((SELECT sum(new_count - old_count) FROM h WHERE h.file = l.file AND (old_start < line OR (old_start = line AND old_count > 0))), 0) AS INT) AS new_line FROM l")
def hunk_line_shift(spark, sf_dir):
    return diffs.shifted(_lines(spark, sf_dir), _hunks(spark, sf_dir), ["file"])


@query("changed_lines", f"WITH {_HUNKS_SQL} SELECT o_orderkey, file, 'added' AS side, CAST(unnest(generate_series(new_start, new_start + new_count - 1)) AS INT) AS line FROM h WHERE new_count > 0 UNION ALL SELECT o_orderkey, file, 'deleted', CAST(unnest(generate_series(old_start, old_start + old_count - 1)) AS INT) FROM h WHERE old_count > 0")
def changed_lines(spark, sf_dir):
    return diffs.hunk_lines(_hunks(spark, sf_dir))


_DIFF = "concat('diff --git a/', file, ' b/', file, {n}, '--- a/', file, {n}, '+++ b/', file, {n}, '@@ -', CAST(old_start AS {t}), ',', CAST(old_count AS {t}), ' +', CAST(new_start AS {t}), CASE WHEN new_count = 1 THEN '' ELSE concat(',', CAST(new_count AS {t})) END, ' @@', {n}, repeat(concat('-old', {n}), old_count), repeat(concat('+new', {n}), new_count))"


@query("parse_hunks", f"WITH {_HUNKS_SQL} SELECT o_orderkey, file, 0 AS ord, old_start, old_count, new_start, new_count FROM h")
def parse_hunks(spark, sf_dir):
    d = _hunks(spark, sf_dir).select("o_orderkey", F.expr(_DIFF.format(n="'\\n'", t="STRING")).alias("diff"))
    return diffs.hunks(d, ["o_orderkey"])


@query("diff_changed_lines", f"WITH {_HUNKS_SQL} SELECT o_orderkey, file, 'added' AS side, CAST(unnest(generate_series(new_start, new_start + new_count - 1)) AS INT) AS line, 'new' AS text FROM h WHERE new_count > 0 UNION ALL SELECT o_orderkey, file, 'deleted', CAST(unnest(generate_series(old_start, old_start + old_count - 1)) AS INT), 'old' FROM h WHERE old_count > 0")
def diff_changed_lines(spark, sf_dir):
    d = _hunks(spark, sf_dir).select("o_orderkey", F.expr(_DIFF.format(n="'\\n'", t="STRING")).alias("diff"))
    return diffs.changed_lines(d, ["o_orderkey"])


_SPANS = "concat('f', CAST(o_custkey % 997 AS {t})) AS file, o_orderkey AS name, CAST(1 + o_orderkey % 200 AS INT) AS start_line, CAST(1 + o_orderkey % 200 + CAST(floor(o_totalprice) AS BIGINT) % 60 AS INT) AS end_line"


@query("innermost_span", f"WITH s AS (SELECT {_SPANS.format(t='VARCHAR')} FROM orders), {_LINES_SQL} SELECT event_id, file, line, start_line, end_line FROM (SELECT l.*, start_line, end_line, row_number() OVER (PARTITION BY event_id ORDER BY end_line - start_line, start_line DESC, name) AS rn FROM l JOIN s USING (file) WHERE line BETWEEN start_line AND end_line) WHERE rn = 1")
def innermost_span(spark, sf_dir):
    s = table(spark, sf_dir, "orders").selectExpr(*_exprs(_SPANS)).select("file", "start_line", "end_line")
    return spans.innermost(_lines(spark, sf_dir), s, ["file"])


_CODE = "concat('import os', {n}, {n}, 'def f', CAST(p_partkey AS {t}), '(x):', {n}, '    return os.getcwd()', {n}, {n}, repeat(concat('# note', {n}), CAST(p_size AS INT)), 'class C', CAST(p_partkey AS {t}), ':', {n}, '    def m(self):', {n}, '        if self:', {n}, '            return f', CAST(p_partkey AS {t}), '(1)', {n}, '        return eval(''1'')', {n})"


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("repo"), F.lit("a.py").alias("path"), F.expr(_CODE.format(n="'\\n'", t="STRING").replace("''1''", "\\'1\\'")).alias("content"))


@query("ast_functions", "SELECT p_partkey AS repo, 'a.py:f' || p_partkey AS node, CAST(3 AS INT) AS start_line, CAST(4 AS INT) AS end_line FROM part UNION ALL SELECT p_partkey, 'a.py:C' || p_partkey || '.m', CAST(7 + p_size AS INT), CAST(10 + p_size AS INT) FROM part")
def ast_functions(spark, sf_dir):
    return callgraph.functions(callgraph.read(_sources(spark, sf_dir), ["repo"]), ["repo"]).select("repo", "node", "start_line", "end_line")


@query("ast_calls", "SELECT p_partkey AS repo, 'a.py:f' || p_partkey AS src, 'EXTERNAL:os.getcwd' AS dst, CAST(4 AS INT) AS line, true AS is_external FROM part UNION ALL SELECT p_partkey, 'a.py:C' || p_partkey || '.m', 'a.py:f' || p_partkey, CAST(9 + p_size AS INT), false FROM part UNION ALL SELECT p_partkey, 'a.py:C' || p_partkey || '.m', 'EXTERNAL:eval', CAST(10 + p_size AS INT), true FROM part")
def ast_calls(spark, sf_dir):
    return callgraph.calls(callgraph.read(_sources(spark, sf_dir), ["repo"]), ["repo"])


@query("enclosing_function", "SELECT p_partkey AS repo, 'a.py' AS file, CAST(i AS INT) AS line, CASE WHEN i BETWEEN 3 AND 4 THEN 'a.py:<module>.f' || p_partkey WHEN i BETWEEN 7 + p_size AND 10 + p_size THEN 'a.py:<module>.C' || p_partkey || '.m' ELSE 'a.py:<module>' END AS function FROM (SELECT *, unnest(generate_series(1, 10 + p_size)) AS i FROM part)")
def enclosing_function(spark, sf_dir):
    files = _sources(spark, sf_dir).withColumnRenamed("path", "file")
    lines = files.select("repo", "file", F.explode(F.sequence(F.lit(1), F.size(F.split("content", "\n")) - 1)).alias("line"))
    return spans.enclosing_function(lines, files, ["repo", "file"])


# --- graphs out of parts

_EDGES_SQL = """n AS (SELECT count(*) AS n FROM part),
e AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, (p_partkey * 7 + p_size) % n.n AS dst FROM part, n WHERE p_size > 25 UNION ALL SELECT p_partkey, (p_partkey * 13 + 3) % n.n FROM part, n WHERE p_size % 5 = 0))"""


def _edges(spark, sf_dir):
    """Sparse edges over parts; all in one graph, keyed by g."""
    p = table(spark, sf_dir, "part")
    n = p.count()
    a = p.where("p_size > 25").selectExpr("0 AS g", "p_partkey AS src", f"(p_partkey * 7 + p_size) % {n} AS dst")
    b = p.where("p_size % 5 = 0").selectExpr("0 AS g", "p_partkey AS src", f"(p_partkey * 13 + 3) % {n} AS dst")
    return graphs.settle(a.union(b).distinct())


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.lit(0).alias("g"), F.col("p_partkey").alias("node"), "p_brand", "p_size", "p_name", "p_type")


@query("reachable_pairs", f"WITH RECURSIVE {_EDGES_SQL}, r AS (SELECT p_partkey AS root, p_partkey AS node FROM part UNION SELECT root, dst FROM r JOIN e ON src = node) SELECT root, node FROM r")
def reachable_pairs(spark, sf_dir):
    seeds = _nodes(spark, sf_dir).withColumn("root", F.col("node"))
    return graphs.reach(seeds, _edges(spark, sf_dir), ["g", "root"]).select("root", "node")


@query("sensitive_reach", f"WITH RECURSIVE {_EDGES_SQL}, r AS (SELECT p_partkey AS root, p_partkey AS node FROM part UNION SELECT root, dst FROM r JOIN e ON src = node) SELECT root, count(*) AS n_nodes FROM r GROUP BY root HAVING bool_or(node IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#13'))")
def sensitive_reach(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    seeds = nodes.withColumn("root", F.col("node"))
    got = graphs.reach(seeds, _edges(spark, sf_dir), ["g", "root"])
    hot = nodes.where("p_brand = 'Brand#13'").select("g", "node", F.lit(True).alias("hot"))
    return got.join(hot, ["g", "node"], "left").groupBy("root").agg(F.count("*").alias("n_nodes"), F.bool_or(F.coalesce("hot", F.lit(False))).alias("hot")).where("hot").drop("hot")


_KIND = "CASE p_size % 7 WHEN 0 THEN 'METHOD' WHEN 1 THEN 'METHOD_RETURN' ELSE 'CALL' END"


@query("taint_closure", f"""WITH RECURSIVE {_EDGES_SQL}, k AS (SELECT p_partkey AS node, {_KIND} AS kind FROM part), x AS (SELECT src, dst, CASE (src + dst) % 3 WHEN 0 THEN 'DDG: ' WHEN 1 THEN 'DDG: x' ELSE 'CDG: ' END AS label FROM e),
s AS (SELECT src, dst FROM x JOIN k ON k.node = dst WHERE label <> 'DDG: ' AND kind <> 'METHOD_RETURN' UNION SELECT dst, src FROM x JOIN k ON k.node = src WHERE label <> 'DDG: ' OR kind = 'METHOD'),
r AS (SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#13' UNION SELECT dst FROM r JOIN s ON src = node) SELECT node FROM r""")  # fmt: skip
def taint_closure(spark, sf_dir):
    label = F.when((F.col("src") + F.col("dst")) % 3 == 0, "DDG: ").when((F.col("src") + F.col("dst")) % 3 == 1, "DDG: x").otherwise("CDG: ")
    nodes = _nodes(spark, sf_dir)
    found, _ = taint.trace(nodes.where("p_brand = 'Brand#13'"), _edges(spark, sf_dir).withColumn("label", label), nodes.withColumn("label", F.expr(_KIND)), ["g"])
    return found.select("node")


@query("root_nodes", f"""WITH RECURSIVE {_EDGES_SQL}, free AS (SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT dst FROM e)),
r AS (SELECT node FROM free UNION SELECT dst FROM r JOIN e ON src = node), rest AS (SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT node FROM r)),
i AS (SELECT * FROM e WHERE src IN (SELECT node FROM rest) AND dst IN (SELECT node FROM rest)), p AS (SELECT node AS a, node AS b FROM rest UNION SELECT a, dst FROM p JOIN i ON src = b),
scc AS (SELECT x.a AS node, min(x.b) AS least FROM p x JOIN p y ON x.a = y.b AND x.b = y.a GROUP BY x.a), ent AS (SELECT DISTINCT s.least FROM i JOIN scc s ON s.node = i.dst JOIN scc t ON t.node = i.src WHERE s.least <> t.least)
SELECT node FROM free UNION ALL SELECT DISTINCT least FROM scc WHERE least NOT IN (SELECT least FROM ent)""")  # fmt: skip
def root_nodes(spark, sf_dir):
    return graphs.roots(_nodes(spark, sf_dir).select("g", "node"), _edges(spark, sf_dir), ["g"]).select("node")


_MEMBERS = "SELECT o_orderkey AS slice, o_custkey * 3 + CAST(floor(o_totalprice) AS BIGINT) % 3 AS node FROM orders UNION SELECT o_orderkey, (o_custkey + 1) * 3 FROM orders WHERE o_orderkey % 16 = 0"


@query("overlap_components", f"WITH RECURSIVE m AS ({_MEMBERS}), l AS (SELECT DISTINCT a.slice AS x, b.slice AS y FROM m a JOIN m b USING (node)), r AS (SELECT slice AS s, slice AS t FROM m UNION SELECT s, y FROM r JOIN l ON x = t) SELECT s AS slice, min(t) AS root FROM r GROUP BY s")
def overlap_components(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.selectExpr("0 AS g", "o_orderkey AS slice", "o_custkey * 3 + CAST(floor(o_totalprice) AS BIGINT) % 3 AS node")
    b = o.where("o_orderkey % 16 = 0").selectExpr("0 AS g", "o_orderkey AS slice", "(o_custkey + 1) * 3 AS node")
    return graphs.overlap_groups(a.union(b).distinct(), ["g"]).select("slice", "root")


@query("set_overlap_score", "WITH a AS (SELECT DISTINCT l_suppkey AS id, l_partkey AS node FROM lineitem), n AS (SELECT a.id AS a_id, b.id AS b_id, count(*) AS n FROM a JOIN a b USING (node) WHERE a.id <> b.id GROUP BY ALL) SELECT a_id, max(n) AS best FROM n GROUP BY a_id")
def set_overlap_score(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("node"))
    return graphs.overlaps(li, li).where("a_id <> b_id").groupBy("a_id").agg(F.max("n").alias("best"))


@query("arg_list", "SELECT l_orderkey AS call, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS args FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem) GROUP BY 1")
def arg_list(spark, sf_dir):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    li = table(spark, sf_dir, "lineitem").select(*cols).distinct()
    li = li.withColumn("argument_index", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*cols[1:]))).withColumn("node", F.concat_ws(":", "l_orderkey", "argument_index"))
    got = graphs.ordered_arguments(li.withColumn("g", F.lit(0)), li.select(F.lit(0).alias("g"), F.col("l_orderkey").alias("src"), F.col("node").alias("dst"), F.lit("ARGUMENT").alias("label")), ["g"])
    part = li.select("node", "l_partkey")
    args = got.select("call", F.posexplode("args").alias("i", "node")).join(part, "node")
    return args.groupBy("call").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("args"))


_CATEGORY = "CASE WHEN p_name LIKE 'red%' THEN 'network' WHEN p_name LIKE '%ring' THEN 'file' END"


@query("category_propagation", f"WITH RECURSIVE {_EDGES_SQL}, r AS (SELECT p_partkey AS node, {_CATEGORY} AS category FROM part WHERE {_CATEGORY} IS NOT NULL UNION SELECT src, category FROM r JOIN e ON dst = node) SELECT node, category FROM r")
def category_propagation(spark, sf_dir):
    tags = _nodes(spark, sf_dir).withColumn("category", F.expr(_CATEGORY)).where("category is not null")
    return graphs.spread(tags, _edges(spark, sf_dir), ["g"], None).select("node", "category")


@query("callee_trace", f"WITH RECURSIVE {_EDGES_SQL}, t AS (SELECT p_partkey AS node FROM part WHERE p_size % 4 <> 0), r AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part UNION SELECT root, dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 5 AND node IN (SELECT node FROM t)) SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL HAVING min(depth) > 0")
def callee_trace(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return callgraph.callees(nodes, _edges(spark, sf_dir), nodes.where("p_size % 4 <> 0"), ["g"]).select("root", "node", "depth")


@query("caller_trace", f"WITH RECURSIVE {_EDGES_SQL}, r AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part UNION SELECT root, src, depth + 1 FROM r JOIN e ON dst = node WHERE depth < 5 AND (node NOT IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL') OR depth = 0)) SELECT root, node, min(depth) AS depth, node IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL') AS is_entry FROM r GROUP BY root, node HAVING min(depth) > 0")
def caller_trace(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return callgraph.callers(nodes, _edges(spark, sf_dir), nodes.where("p_type = 'SMALL'"), ["g"]).select("root", "node", "depth", "is_entry")


_CALL_NAME = "CASE WHEN p_type = 'SMALL' THEN '<operator>.assignment' ELSE 'call' END"


@query("sensitive_calls", f"""WITH {_EDGES_SQL}, k AS (SELECT p_partkey AS node, {_KIND} AS label, {_CALL_NAME} AS name, p_name AS callee, p_size % 2 + 1 AS i FROM part), api AS (SELECT p_name FROM part WHERE p_brand = 'Brand#13'),
a AS (SELECT src AS node, min(callee) AS callee FROM e JOIN k ON node = dst WHERE i = 2 GROUP BY src)
SELECT node FROM k LEFT JOIN a USING (node) WHERE label = 'CALL' AND CASE WHEN name = 'call' THEN k.callee ELSE a.callee END IN (SELECT p_name FROM api)""")
def sensitive_calls(spark, sf_dir):
    """Calls of what one brand's parts are named, assignments by their second argument."""
    columns = [f"{_KIND} AS label", f"{_CALL_NAME} AS name", "p_name AS method_full_name", "CAST(p_partkey AS STRING) AS code", "p_size % 2 + 1 AS argument_index"]
    nodes = table(spark, sf_dir, "part").selectExpr("0 AS g", "p_partkey AS node", *columns)
    api = table(spark, sf_dir, "part").where("p_brand = 'Brand#13'").select(F.col("p_name").alias("full_name"))
    return taint.sensitive_calls(nodes, api, _edges(spark, sf_dir).withColumn("label", F.lit("ARGUMENT")), ["g"]).select("node")


_FILE = "concat(p_brand, '/', p_type)"
_FULL_NAME = "concat(p_brand, CASE WHEN p_size % 7 = 0 THEN '.f' WHEN p_size = 3 THEN '.__init__' ELSE '.x' END)"
_OUTER = "p_size = 35"


@query("sensitive_subgraph", f"""WITH RECURSIVE {_EDGES_SQL}, k AS (SELECT p_partkey AS node, {_KIND} AS label, {_FILE} AS file_path, {_FULL_NAME} AS full_name, p_brand, {_OUTER} AS is_outer, p_name LIKE 'red%' AS hot FROM part),
own AS (SELECT DISTINCT file_path FROM k WHERE is_outer), back AS (SELECT e.dst AS src, e.src AS dst, k.label FROM e JOIN k ON k.node = e.src WHERE (e.src + e.dst) % 4 <> 0 AND k.label IN ('CALL', 'METHOD')),
s AS (SELECT src, dst FROM e UNION SELECT src, dst FROM back WHERE label = 'METHOD'),
r AS (SELECT node AS root, file_path AS home, node FROM k WHERE label = 'METHOD' UNION SELECT root, home, k.node FROM r JOIN s ON s.src = r.node JOIN k ON k.node = s.dst WHERE k.file_path = home OR k.file_path NOT IN (SELECT file_path FROM own)),
a AS (SELECT root, node FROM r UNION SELECT root, k.node FROM r JOIN back b ON b.src = r.node AND b.label = 'CALL' JOIN k ON k.node = b.dst WHERE k.file_path = home OR k.file_path NOT IN (SELECT file_path FROM own)
  UNION SELECT root, c.node FROM r JOIN k m ON m.node = r.node AND m.label = 'METHOD' JOIN k c ON c.full_name IN (m.p_brand || '.<body>', m.p_brand || '.__init__'))
SELECT root, node FROM a WHERE root IN (SELECT root FROM r JOIN k USING (node) WHERE hot)""")
def sensitive_subgraph(spark, sf_dir):
    columns = [f"{_KIND} AS label", f"{_FILE} AS file_path", f"{_FULL_NAME} AS full_name", f"{_OUTER} AS is_outer", "p_name LIKE 'red%' AS is_sensitive"]
    nodes = table(spark, sf_dir, "part").selectExpr("0 AS g", "p_partkey AS node", *columns)
    edges = _edges(spark, sf_dir).withColumn("label", F.when((F.col("src") + F.col("dst")) % 4 == 0, "FUNCTION_CALL").otherwise("DDG: x"))
    return taint.sensitive_subgraphs(nodes.where("label = 'METHOD'"), nodes, edges, ["g"]).select("root", "node")
