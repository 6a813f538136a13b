"""Queries over lookups in code graphs: parts stand for nodes, functions, files and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups
from .inputs import table
from .registry import query

G = ["g"]
_WORDS = ["split_part(p_name, ' ', 1) AS w1", "split_part(p_name, ' ', 2) AS w2"]
_P = f"p AS (SELECT *, {', '.join(_WORDS)} FROM part)"


def _parts(spark, sf_dir, *columns: str):
    return table(spark, sf_dir, "part").selectExpr("*", *_WORDS).selectExpr("0 AS g", "p_name", *columns)


_FUNCTION = "concat('<module>.', w1, '.', w2)"
_ASKED = "CASE p_size % 3 WHEN 0 THEN concat('<module>.', w1, '.', w2) WHEN 1 THEN concat(w1, '.<returnValue>.', w2) ELSE concat(p_type, '.', w2) END"


@query("function_graphs", f"""WITH {_P}, f AS (SELECT p_brand AS file, {_FUNCTION} AS name, p_partkey AS graph FROM p), own AS (SELECT file, name, min(graph) AS first, max(graph) AS graph FROM f GROUP BY ALL),
c AS (SELECT p_partkey AS node, p_brand AS file, {_ASKED} AS function FROM p)
SELECT node, function, coalesce((SELECT graph FROM own WHERE own.file = c.file AND own.name = c.function),
  (SELECT min_by(graph, first) FROM own WHERE own.file = c.file AND split_part(own.name, '.', -1) = split_part(c.function, '.', -1) AND contains(own.name, split_part(c.function, '.', 1)))) AS graph FROM c""")  # fmt: skip
def function_graphs(spark, sf_dir):
    functions = _parts(spark, sf_dir, "p_brand AS file", f"{_FUNCTION} AS name", "p_partkey AS graph", "p_partkey AS ord")
    return lookups.function_graphs(_parts(spark, sf_dir, "p_partkey AS node", "p_brand AS file", f"{_ASKED} AS function"), functions, G).select("node", "function", "graph")


@query("files_of_functions", f"WITH {_P} SELECT {_FUNCTION} AS name, min_by(p_brand, p_partkey) AS file FROM p GROUP BY 1")
def files_of_functions(spark, sf_dir):
    return lookups.files_of_functions(_parts(spark, sf_dir, "p_brand AS file", f"{_FUNCTION} AS name", "p_partkey AS ord"), G).select("name", "file")


@query("files_of_nodes", "WITH m AS (SELECT l_partkey AS node, min_by(concat('f', CAST(l_suppkey AS VARCHAR)), (l_orderkey, l_suppkey)) AS file FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) SELECT p_partkey AS node, coalesce(file, 'unknown') AS file FROM part LEFT JOIN m ON node = p_partkey")
def files_of_nodes(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").selectExpr("0 AS g", "l_partkey AS node", "concat('f', CAST(l_suppkey AS STRING)) AS file", "struct(l_orderkey, l_suppkey) AS ord")
    return lookups.files_of_nodes(_parts(spark, sf_dir, "p_partkey AS node"), members, G).select("node", "file")


_LABEL = "CASE p_size % 4 WHEN 0 THEN 'METHOD' WHEN 1 THEN 'METHOD_PARAMETER_IN' WHEN 2 THEN '' ELSE 'CALL' END"


@query("method_index", f"WITH {_P} SELECT concat(p_brand, w1) AS full_name, max(p_partkey) AS node FROM p WHERE {_LABEL} = 'METHOD' GROUP BY 1")
def method_index(spark, sf_dir):
    return lookups.methods(_parts(spark, sf_dir, "p_partkey AS node", f"{_LABEL} AS label", "concat(p_brand, w1) AS full_name", "p_partkey AS ord"), G).select("full_name", "node")


_CALL_EDGES = "l_suppkey AS src, l_partkey AS dst, CASE l_linenumber % 3 WHEN 0 THEN 'FUNCTION_CALL' WHEN 1 THEN 'SUB_FUNCTION_CALL' ELSE 'AST' END AS label"


@query("caller_index", f"SELECT dst AS node, array_to_string(list_sort(list(DISTINCT src)), ',') AS callers FROM (SELECT {_CALL_EDGES} FROM lineitem) WHERE label <> 'AST' GROUP BY dst")
def caller_index(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").selectExpr("0 AS g", *[c.strip() for c in _CALL_EDGES.split(", ")])
    return lookups.callers(edges, G).select("node", F.array_join(F.transform("callers", lambda x: x.cast("string")), ",").alias("callers"))


@query("tree_linked", f"WITH e AS (SELECT {_CALL_EDGES} FROM lineitem), a AS (SELECT src, dst FROM e WHERE label = 'AST'), q AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem) SELECT src, dst, EXISTS (SELECT 1 FROM a WHERE (a.src = q.src AND a.dst = q.dst) OR (a.src = q.dst AND a.dst = q.src)) AS is_linked FROM q")
def tree_linked(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").selectExpr("0 AS g", *[c.strip() for c in _CALL_EDGES.split(", ")])
    return lookups.tree_linked(edges.selectExpr("g", "dst AS src", "src AS dst").distinct(), edges, G).select("src", "dst", "is_linked")


@query("relation_nodes", f"""WITH {_P}, n AS (SELECT p_partkey AS node, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS file_path, CASE WHEN p_size % 5 = 0 THEN NULL ELSE concat(CASE WHEN p_size % 7 = 0 THEN '<operator>.' ELSE '' END, w1) END AS full_name, {_LABEL} AS label FROM p),
f AS (SELECT p_partkey AS node, CASE p_size % 6 WHEN 0 THEN '<empty>' WHEN 3 THEN p_type END AS f_file, concat('<operator>.', w2) AS f_name, 'METHOD_PARAMETER_IN' AS f_label FROM p WHERE p_size % 2 = 0 OR p_size % 9 = 0)
SELECT node FROM n LEFT JOIN f USING (node) WHERE coalesce(nullif(file_path, ''), f_file, '') NOT IN ('', '<empty>', 'unknown') AND NOT starts_with(coalesce(nullif(full_name, ''), f_name, ''), '<operator>.') AND coalesce(nullif(label, ''), f_label, '') <> 'METHOD_PARAMETER_IN'""")  # fmt: skip
def relation_nodes(spark, sf_dir):
    nodes = _parts(spark, sf_dir, "p_partkey AS node", "CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS file_path", "CASE WHEN p_size % 5 = 0 THEN NULL ELSE concat(CASE WHEN p_size % 7 = 0 THEN '<operator>.' ELSE '' END, w1) END AS full_name", f"{_LABEL} AS label")
    full = _parts(spark, sf_dir, "p_size", "p_partkey AS node", "CASE p_size % 6 WHEN 0 THEN '<empty>' WHEN 3 THEN p_type END AS file_name", "concat('<operator>.', w2) AS full_name", "'METHOD_PARAMETER_IN' AS label").where("p_size % 2 = 0 or p_size % 9 = 0")
    return lookups.relation_nodes(nodes, full, G).select("node")


_CALLEE = "CASE p_size % 5 WHEN 0 THEN '<unknownFullName>' WHEN 1 THEN concat('lib/', w1, '.py:<module>.f') WHEN 2 THEN concat(w1, '.py:<module>.f') WHEN 3 THEN concat(w2, '/a.py:<module>.g') ELSE w2 END"
_HINT = "CASE WHEN p_size % 8 = 0 THEN '__builtin.str' WHEN p_size % 8 = 1 THEN NULL ELSE '' END"


@query("project_calls", f"""WITH {_P}, c AS (SELECT p_partkey AS node, split_part({_CALLEE}, ':', 1) AS file, {_HINT} AS hint FROM p), f AS (SELECT 'red.py' AS path UNION ALL SELECT 'cold.py' UNION ALL SELECT 'ring/z.py' UNION ALL SELECT 'widget/b.py'),
own AS (SELECT path FROM f UNION SELECT split_part(path, '/', 1) FROM f)
SELECT node FROM c WHERE NOT contains(coalesce(hint, ''), '__builtin') AND (file = '<unknownFullName>' OR NOT contains(file, 'py') OR file IN (SELECT path FROM own) OR (contains(file, '/') AND split_part(file, '/', 1) IN (SELECT path FROM own)))""")  # fmt: skip
def project_calls(spark, sf_dir):
    files = spark.createDataFrame([(0, p) for p in ("red.py", "cold.py", "ring/z.py", "widget/b.py")], "g int, path string")
    return lookups.project_calls(_parts(spark, sf_dir, "p_partkey AS node", f"{_CALLEE} AS method_full_name", f"{_HINT} AS dynamic_type_hint"), files, G).select("node")


@query("same_position", "SELECT a.p_partkey AS node, b.p_partkey AS other FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey % 97 = b.p_partkey % 97")
def same_position(spark, sf_dir):
    nodes = _parts(spark, sf_dir, "p_brand AS file", "p_partkey AS node", "p_size AS line", "p_partkey % 97 AS column")
    return lookups.same_position(nodes, nodes, ["file"]).select("node", "other")


@query("builtin_calls", "SELECT p_partkey AS node FROM part WHERE p_size % 6 = 0 OR p_name LIKE '%r%'")
def builtin_calls(spark, sf_dir):
    return lookups.builtin_calls(_parts(spark, sf_dir, "p_partkey AS node", "CASE WHEN p_size % 6 = 0 THEN concat('__builtin.', w1) END AS method_full_name", "CASE WHEN p_name LIKE '%r%' THEN 'f.read()' END AS code")).select("node")


@query("nodes_at_line", "SELECT p_partkey AS node FROM part WHERE p_size = 24")
def nodes_at_line(spark, sf_dir):
    return lookups.at_line(_parts(spark, sf_dir, "p_partkey AS node", "CAST(p_size AS STRING) AS line"), "24").select("node")


@query("node_attributes", r"""WITH p AS (SELECT *, p_size % 3 = 0 AS bare FROM part)
SELECT p_partkey AS node, p_type AS node_type, concat('[', CAST(p_partkey AS VARCHAR), '][', CASE WHEN bare THEN '0' ELSE CAST(p_size AS VARCHAR) END, ':4][', p_type, ']: ', CASE WHEN bare THEN '' ELSE concat(p_name, '\n', p_brand) END) AS display, CASE WHEN bare THEN 4 ELSE 5 END AS n_attrs FROM p""")  # fmt: skip
def node_attributes(spark, sf_dir):
    nodes = _parts(spark, sf_dir, "p_partkey AS node", "map('COLUMN_NUMBER', '4', 'label', 'old', 'ORDER', '1') AS attrs")
    full = _parts(spark, sf_dir, "p_partkey AS node", "CASE WHEN p_size % 3 = 0 THEN map('label', p_type, 'NAME', p_name) ELSE map('label', p_type, 'CODE', concat(p_name, '\\n', p_brand), 'LINE_NUMBER', CAST(p_size AS STRING)) END AS attrs")
    return lookups.with_attributes(nodes, full, G).select("node", "node_type", "display", F.size("attrs").alias("n_attrs"))


_SLICE_NAME = "CASE WHEN p_size % 6 = 0 THEN '<module>' WHEN p_size % 6 = 1 THEN '<file>' ELSE split_part(p_name, ' ', 1) END"


@query("slice_ranks", f"SELECT p_partkey AS node, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN n = '<module>' THEN 0 ELSE 1 END, CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END, p_size DESC, file, n) AS INT) AS rank FROM (SELECT *, {_SLICE_NAME} AS n, concat('f', CAST(p_partkey AS VARCHAR)) AS file FROM part)")
def slice_ranks(spark, sf_dir):
    own = _parts(spark, sf_dir, "p_partkey AS node", "p_brand", f"{_SLICE_NAME} AS slice_name", "p_size % 4 = 0 AS has_outer_root", "p_size AS n_nodes", "concat('f', CAST(p_partkey AS STRING)) AS file_path")
    return lookups.slice_ranks(own, ["p_brand"]).select("node", "rank")


_BEFORE = "concat(CASE WHEN p_size % 2 = 0 THEN 'NEW@' ELSE '' END, CASE WHEN p_size % 5 = 0 THEN 'x' ELSE '' END, w1, '@', p_type, '_', CAST(p_partkey % 40 AS {t}), '_slice.py')"
_TOKEN = "concat(p_type, '_', CAST(p_partkey % 45 AS {t}))"


@query("earlier_slices", f"""WITH {_P}, b AS (SELECT p_brand, {_BEFORE.format(t='VARCHAR')} AS file, max(CAST(p_partkey AS VARCHAR)) AS signature FROM p GROUP BY ALL),
s AS (SELECT DISTINCT p_brand, {_SLICE_NAME} AS slice_name, {_TOKEN.format(t='VARCHAR')} AS file_token FROM p), x AS (SELECT *, concat(slice_name, '@', file_token, '_slice.py') AS suffix FROM s)
SELECT p_brand, slice_name, file_token, coalesce((SELECT signature FROM b WHERE b.p_brand = x.p_brand AND b.file = suffix), (SELECT min_by(signature, (starts_with(b.file, 'NEW@'), b.file)) FROM b WHERE b.p_brand = x.p_brand AND ends_with(b.file, suffix)),
  CASE WHEN slice_name IN ('<file>', '<module>') THEN (SELECT CASE WHEN count(*) = 1 THEN any_value(signature) END FROM b WHERE b.p_brand = x.p_brand AND ends_with(b.file, concat('@', file_token, '_slice.py'))) END, '') AS before FROM x""")  # fmt: skip
def earlier_slices(spark, sf_dir):
    own = _parts(spark, sf_dir, "p_brand", f"{_SLICE_NAME} AS slice_name", f"{_TOKEN.format(t='STRING')} AS file_token").drop("g", "p_name").distinct()
    before = _parts(spark, sf_dir, "p_brand", f"{_BEFORE.format(t='STRING')} AS file", "CAST(p_partkey AS STRING) AS signature").groupBy("p_brand", "file").agg(F.max("signature").alias("signature"))
    return lookups.earlier_slices(own, before, ["p_brand"]).select("p_brand", "slice_name", "file_token", "before")
