"""Diffs, spans, graphs, call graphs, sources, sinks and streams on small fixtures."""

import json
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from commitlens.functions import diffs, settings, text
from commitlens.operators import callgraph, classify, graphs, likeness, rollups, spans, taint
from commitlens.plans import graph_queries
from commitlens.sources import dot, git, sinks, tables
from commitlens.streaming import carry

CODE = "import os\nfrom b import helper\n\n\nclass A:\n    def __init__(self):\n        self.x = 1\n\n    def run(self):\n        if self.x:\n            helper(1)\n        else:\n            os.system('x')\n        return self.stop()\n\n    def stop(self):\n        return 0\n\n\nA().run()\n"


def test_line_shift_against_loop(spark):
    hunks = spark.createDataFrame([("f", 5, 0, 2), ("f", 10, 3, 1)], "file string, old_start int, old_count int, new_count int")
    lines = spark.createDataFrame([("f", n) for n in (5, 6, 10, 12, 20)] + [("g", 3)], "file string, line int")
    got = {(r.file, r.line): r.new_line for r in diffs.shifted(lines, hunks, ["file"]).collect()}
    assert got == {("f", 5): 5, ("f", 6): 8, ("f", 10): 10, ("f", 12): 12, ("f", 20): 20, ("g", 3): 3}


def test_changed_lines_quirk(spark):
    d = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -3 +3,3 @@\n-old\n+new\n++plus\n+last\n"
    df = spark.createDataFrame([("c", d), ("e", None)], "commit string, diff string")
    assert [(r.side, r.line, r.text) for r in diffs.changed_lines(df, ["commit"]).collect()] == [("deleted", 3, "old"), ("added", 3, "new"), ("added", 5, "last")]
    assert [tuple(r)[1:] for r in diffs.hunks(df, ["commit"]).collect()] == [("x.py", 0, 3, 1, 3, 3)]


def test_likeness():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            prev, row = row, [0] * (len(b) + 1)
            for j, y in enumerate(b):
                row[j + 1] = prev[j] + 1 if x == y else max(prev[j + 1], row[j])
        assert text.lcs_length(a, b) == row[-1]
    assert text.indel_ratio("", "") == 100 and text.indel_ratio("abcdefghij", "abcdefghiX") == 90 and text.indel_ratio("abcdefghi", "abcdefghX") < 90


def test_alike_rows_compare_texts_once(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randrange(25))) for _ in range(25)] + ["", None, "x" * 90]
    texts += ["".join(c for c in t or "" if rng.random() > 0.06) for t in texts for _ in range(3)]
    rows = [(rng.randrange(1000), rng.choice("gh"), rng.choice(texts)) for _ in range(400)] + [(1000 + i, "g", "the same text") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, t string")
    for least in (90.0, 75.0):
        want = []
        for i, (a, g, x) in enumerate(rows):
            for b, h, y in rows[:i]:
                if g == h and a != b and (r := text.indel_ratio(x or "", y or "")) >= least:
                    want.append((min(a, b), max(a, b), r))
        got = likeness.row_pairs(df, ["g"], "id", "t", least).collect()
        assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 20000
    most, got = joined_rows(likeness.text_pairs(df, ["g"], "t"))
    # rows of one text are not compared with each other, nor texts that edits rule out
    assert len({(r.g, r.one, r.two) for r in got}) == len(got) and most < 1000


def test_fuzzy_pairs_does_not_compare_copies(spark, tmp_path):
    rows = [(50 * i + k, "ab ring", "Brand#1", "LARGE", 7) for i in range(100) for k in range(2)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    seen = spark.sparkContext.accumulator(0)
    one = text.indel.func

    def counted(a, b):
        seen.add(len(a))
        return one(a, b)

    plain, text.indel = text.indel, F.pandas_udf(counted, text.DoubleType())
    try:
        got = graph_queries.fuzzy_pairs(spark, str(tmp_path)).collect()
    finally:
        text.indel = plain
    assert len(got) == 200 * 199 // 2 and {r.ratio for r in got} == {100.0, round(200 * 14 / 30, 6)}
    assert seen.value == 1


def test_versions(spark):
    v = ["1.10.0", "1.9.0", "1.9.0_benign", "1.9.0rc1"]
    df = spark.createDataFrame([(x,) for x in v], "v string")
    assert [r.v for r in df.orderBy(text.version_key("v"), "v").collect()] == ["1.9.0", "1.9.0_benign", "1.9.0rc1", "1.10.0"]


def joined_rows(df):
    """The most rows that a join of df gives while df is collected, and df's rows."""
    rows, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        elif "Join" in name or name == "CartesianProduct":
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most, rows


def test_innermost_meets_few_spans(spark):
    rng = random.Random(5)
    own = [(rng.choice("ab"), s := rng.randrange(-70, 300), s + rng.choice([-1, 0, 1, 5, 40, 64, 200, 1000]), rng.choice("xyz")) for _ in range(900)] + [("a", None, 3, "n"), ("b", 3, None, "n")]
    at = [(rng.choice("abc"), rng.randrange(-80, 1400), i) for i in range(400)] + [("a", None, 401), ("a", 5, 402), ("a", 5, 402)]
    want = {}
    for f, n, i in at:
        held = [(e - s, -s, k, e) for g, s, e, k in own if g == f and None not in (s, e, n) and s <= n <= e]
        if held:
            want[f, n, i] = (-min(held)[1], min(held)[3], min(held)[2])
    lines = spark.createDataFrame(at, "file string, line int, id int")
    named = spark.createDataFrame(own, "file string, start_line int, end_line int, name string")
    most, got = joined_rows(spans.innermost(lines, named, ["file"]))
    assert len(got) == len(want) and {(r.file, r.line, r.id): (r.start_line, r.end_line, r.name) for r in got} == want
    assert most <= len(at)
    most, got = joined_rows(spans.innermost(lines, named.drop("name"), ["file"]))
    assert {(r.file, r.line, r.id): (r.start_line, r.end_line) for r in got} == {k: v[:2] for k, v in want.items()} and most <= len(at)


def test_spans_and_slices(spark):
    files = spark.createDataFrame([("r", "a.py", CODE), ("r", "bad.py", "def ("), ("r", "none.py", None)], "repo string, file string, content string")
    lines = spark.createDataFrame([("r", "a.py", 11), ("r", "a.py", 20), ("r", "zzz.py", 1), ("r", "bad.py", 1)], "repo string, file string, line int")
    got = {(r.file, r.line): r.function for r in spans.enclosing_function(lines, files, ["repo", "file"]).collect()}
    assert got == {("a.py", 11): "a.py:<module>.A.run", ("a.py", 20): "a.py:<module>", ("zzz.py", 1): None, ("bad.py", 1): "bad.py:<module>"}
    nodes = spark.createDataFrame([("r", "s", "a.py", 7), ("r", "s", "a.py", 11)], "repo string, slice string, file string, line int")
    out = spans.slice_text(nodes, files, ["repo", "file"]).first().text.split("\n")
    assert out[:2] == ["import os", "from b import helper"] and "    def __init__(self):" in out and "        if self.x:" in out and "            helper(1)" in out
    assert [r.e for r in files.select(spans.has_entry_code("content").alias("e")).collect()] == [True, False, False]


def test_call_graph(spark):
    files = spark.createDataFrame([("r", "a.py", CODE), ("r", "b.py", "import requests\n\n\ndef helper(n):\n    return _send(n)\n\n\ndef _send(n):\n    return requests.post(n)\n"), ("r", "venv/x.py", "def f():\n    pass\n")], "repo string, path string, content string")
    parsed = callgraph.read(files, ["repo"])
    edges = callgraph.calls(parsed, ["repo"])
    got = {(r.src, r.dst) for r in edges.collect()}
    assert {("a.py:A.run", "b.py:helper"), ("a.py:A.run", "a.py:A.stop"), ("a.py:A.run", "EXTERNAL:os.system"), ("b.py:helper", "b.py:_send"), ("b.py:_send", "EXTERNAL:requests.post")} == got
    tags = callgraph.tagged(edges, ["repo"])
    assert {(r.node, r.category) for r in tags.collect()} == {("a.py:A.run", "process"), ("a.py:A.run", "network"), ("b.py:helper", "network"), ("b.py:_send", "network")}
    start = spark.createDataFrame([("r", "b.py:helper")], "repo string, node string")
    up = callgraph.callers(start, edges, start.where("false"), ["repo"])
    down = callgraph.callees(start, edges, tags, ["repo"])
    assert [(r.node, r.depth) for r in up.collect()] == [("a.py:A.run", 1)]
    assert {(r.node, r.depth) for r in down.collect()} == {("b.py:_send", 1), ("EXTERNAL:requests.post", 2)}
    sources = callgraph.functions(parsed, ["repo"]).select("repo", "node", F.lit("x").alias("text"))
    assert callgraph.context(start, up, down, sources, ["repo"]).first().text.startswith("# changed b.py:helper\nx\n# caller a.py:A.run")


def test_taint(spark):
    n = [("a", "CALL"), ("b", "CALL"), ("c", "METHOD_RETURN"), ("d", "CALL"), ("m", "METHOD")]
    nodes = spark.createDataFrame([("r", "c0", x, k, x, x, "api.x" if x == "a" else "", f"{x}()", i, "f.py", i) for i, (x, k) in enumerate(n)], "repo string, commit string, node string, label string, name string, full_name string, method_full_name string, code string, line int, file_path string, ord int")
    edges = spark.createDataFrame([("r", "c0", *e) for e in [("a", "b", "DDG: v"), ("b", "a", "CDG: "), ("b", "c", "DDG: v"), ("b", "d", "DDG: "), ("m", "a", "DDG: ")]], "repo string, commit string, src string, dst string, label string")
    api = spark.createDataFrame([("api.x",)], "full_name string")
    found, used = taint.built(nodes, edges, api)
    assert {(r.node, r.is_sensitive) for r in found.collect()} == {("a", True), ("b", False), ("m", False)}
    sub = taint.sensitive_subgraphs(nodes.where("node = 'm'").withColumn("is_outer", F.lit(True)), nodes.join(found, ["repo", "commit", "node"]), used)
    assert {r.node for r in sub.collect()} >= {"m", "a", "b"}
    later = nodes.withColumn("line", F.col("line") + 2)
    hunks = spark.createDataFrame([("r", "f.py", 0, 0, 2)], "repo string, file string, old_start int, old_count int, new_count int")
    m = taint.corresponding(nodes.where("line > 0"), later, hunks)
    assert {(r.old, r.new) for r in m.collect()} == {(x, x) for x, _ in n[1:]}
    assert {(r.old, r.new) for r in taint.likely(nodes, later, edges, edges).collect()} >= {("a", "a")}


def code_graph(spark, rows, links, commit="c0"):
    fields = "node label name full_name method_full_name argument_index code file_path argument_name type_full_name".split()
    blank = dict.fromkeys(fields, "") | {"argument_index": 0, "file_path": "a.py"}
    rows = [blank | {"node": n, "label": k, "code": f"{n}()"} | more for n, k, more in rows]
    nodes = spark.createDataFrame([("r", commit, *[x[f] for f in fields], 1 + i, i) for i, x in enumerate(rows)], "repo string, commit string, " + ", ".join(f"{f} {'int' if f == 'argument_index' else 'string'}" for f in fields) + ", line int, ord int")
    return nodes, spark.createDataFrame([("r", commit, *e) for e in links], "repo string, commit string, src string, dst string, label string")


def test_taint_grows_over_calls(spark):
    rows = [
        ("m", "METHOD", {"full_name": "a.py:<module>.f", "name": "f"}), ("hot", "CALL", {"method_full_name": "os.py:<module>.system"}),
        ("asg", "CALL", {"method_full_name": "<operator>.assignment", "name": "<operator>.assignment"}), ("lhs", "IDENTIFIER", {"argument_index": 1}), ("val", "CALL", {"method_full_name": "a.py:<module>.f", "argument_index": 2, "file_path": "b.py"}),
        ("direct", "CALL", {"method_full_name": "a.py:<module>.f", "file_path": "b.py"}), ("other", "CALL", {"method_full_name": "x.py:<module>.f"}),
        ("thr", "CALL", {"method_full_name": "threading.py:<module>.Thread.__init__"}), ("tgt", "IDENTIFIER", {"argument_name": "target", "code": "a.py:<module>.f", "type_full_name": "a.py:<module>.T", "argument_index": 1}),
        ("use", "CALL", {"method_full_name": "g.py:<module>.C.g"}), ("g", "METHOD", {"full_name": "g.py:<module>.C.g", "name": "g", "file_path": "g.py"}), ("self", "METHOD_PARAMETER_IN", {"name": "self", "file_path": "g.py"}), ("p", "METHOD_PARAMETER_IN", {"name": "p", "file_path": "g.py"}), ("in_g", "CALL", {"file_path": "g.py"}),
        ("bare", "CALL", {"name": "h", "argument_index": 1}), ("h", "METHOD", {"full_name": "h", "name": "h", "file_path": "h.py"}), ("kept", "CALL", {"name": "unknown", "argument_index": 2}), ("sub", "CALL", {}),
    ]
    links = [("m", "hot", "DDG: "), ("asg", "lhs", "ARGUMENT"), ("asg", "val", "ARGUMENT"), ("thr", "tgt", "ARGUMENT"), ("hot", "use", "DDG: x"), ("g", "self", "AST"), ("g", "p", "AST"), ("p", "in_g", "DDG: p"), ("use", "bare", "ARGUMENT"), ("use", "kept", "ARGUMENT"), ("m", "hot", "CONTAINS")]
    nodes, edges = code_graph(spark, rows, links)
    found, used = taint.built(nodes, edges, spark.createDataFrame([("os.py:<module>.system",)], "full_name string"))
    got = {r.node for r in found.collect()}
    assert got == {"m", "hot", "asg", "val", "direct", "thr", "use", "self", "p", "in_g", "g", "bare"}
    e = {(r.src, r.dst, r.label) for r in used.collect()}
    assert {("asg", "val", "FUNCTION_CALL"), ("val", "m", "FUNCTION_CALL"), ("direct", "m", "FUNCTION_CALL"), ("thr", "m", "FUNCTION_CALL")} <= e
    assert {("use", "self", "SUB_FUNCTION_CALL"), ("use", "p", "SUB_FUNCTION_CALL"), ("use", "g", "SUB_FUNCTION_CALL")} <= e
    # the edge into the call now leads through its argument without arguments, which names a function
    assert {("hot", "bare", "ARGUMENT"), ("bare", "use", "ARGUMENT")} <= e and ("hot", "use", "DDG: x") not in e
    assert ("other", "m", "FUNCTION_CALL") not in e
    # of a call to no file of the project nothing is followed
    files = spark.createDataFrame([("r", "c0", p) for p in ("a.py", "b.py")], "repo string, commit string, path string")
    some = {r.node for r in taint.built(nodes, edges, spark.createDataFrame([("os.py:<module>.system",)], "full_name string"), files=files)[0].collect()}
    assert "val" in some and not {"p", "self", "in_g"} & some


def test_taint_followed_over_commits(spark):
    rows = [("a", "CALL", {"method_full_name": "api.x"}), ("b", "CALL", {}), ("c", "CALL", {}), ("d", "CALL", {})]
    nodes, edges = code_graph(spark, rows[:2], [("a", "b", "DDG: v")])
    more_nodes, more_edges = code_graph(spark, rows, [("a", "b", "DDG: v"), ("b", "c", "DDG: v")], "c1")
    commits = spark.createDataFrame([("r", "c0", 0, None), ("r", "c1", 1, "c0")], "repo string, commit string, ord int, base string")
    hunks = spark.createDataFrame([("r", "c1", "a.py", 2, 0, 2)], "repo string, commit string, file string, old_start int, old_count int, new_count int")
    added = spark.createDataFrame([("r", "c1", "a.py", 3), ("r", "c1", "a.py", 4)], "repo string, commit string, file string, line int")
    n, e = taint.followed(commits, nodes.unionByName(more_nodes), edges.unionByName(more_edges), hunks, added, spark.createDataFrame([("api.x",)], "full_name string"))
    assert sorted((r.commit, r.node, r.is_sensitive) for r in n.collect()) == [("c0", "a", True), ("c0", "b", False), ("c1", "a", True), ("c1", "b", False), ("c1", "c", False)]
    assert {(r.commit, r.src, r.dst) for r in e.collect()} == {("c0", "a", "b"), ("c1", "a", "b"), ("c1", "b", "c")}


def test_settings_and_rewrite(spark, tmp_path):
    assert settings.positive_int("3") == 3
    for bad in ("0", "x", None, -2):
        with pytest.raises(ValueError):
            settings.positive_int(bad)
    for value, want in (("2.5", 2.5), ("0", 20.0), ("x", 20.0), ("nan", 20.0)):
        spark.conf.set("commitlens.test.rate", value)
        assert settings.positive_setting(spark, "commitlens.test.rate", 20.0) == want
    assert settings.positive_setting(spark, "commitlens.test.unset", 7.0) == 7.0
    at = str(tmp_path / "t")
    sinks.rewrite(spark.createDataFrame([(1, "x")], "a int, b string"), at, ["a", "b"])
    sinks.rewrite(spark.read.parquet(at).withColumn("a", F.lit("2")), at, ["a", "b", "c"], backup=True)
    assert [tuple(r) for r in spark.read.parquet(at).collect()] == [("2", "x", "")] and [tuple(r) for r in spark.read.parquet(at + ".bak").collect()] == [("1", "x")]


def test_sensitive_subgraph_adds_callers_but_does_not_follow_them(spark):
    kinds = {"m": "METHOD", "a": "CALL", "c": "CALL", "d": "CALL", "x": "CALL", "p": "METHOD", "q": "CALL", "o": "METHOD", "z": "CALL"}
    files = {"o": "o.py", "z": "o.py"}
    nodes = spark.createDataFrame([(0, n, k, files.get(n, "f.py"), n == "a", n in "mo") for n, k in kinds.items()], "g int, node string, label string, file_path string, is_sensitive boolean, is_outer boolean")
    edges = [("m", "a", "DDG"), ("c", "a", "DDG"), ("d", "c", "DDG"), ("c", "x", "DDG"), ("p", "a", "DDG"), ("p", "q", "DDG"), ("o", "a", "FUNCTION_CALL"), ("a", "z", "DDG")]
    e = spark.createDataFrame([(0, *x) for x in edges], "g int, src string, dst string, label string")
    got = taint.sensitive_subgraphs(nodes.where("node in ('m', 'o')"), nodes, e, ["g"])
    # c is a call: added, but neither x nor d is reached through it; p is a method: followed; o calls, and z is another root's
    # and o, to which f.py is closed, reaches nothing sensitive
    assert {(r.root, r.node) for r in got.collect()} == {("m", n) for n in "macpq"}


def test_graph_roots_with_cycles(spark):
    e = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 2, 3), (0, 4, 5), (0, 6, 6)], "g int, src long, dst long")
    n = spark.createDataFrame([(0, i) for i in range(1, 8)], "g int, node long")
    assert sorted(r.node for r in graphs.roots(n, e, ["g"]).collect()) == [1, 4, 6, 7]
    assert {(r.node, r.root) for r in graphs.components(e, ["g"]).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}


def test_dot(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "1.dot").write_text('digraph "x" {\nnode [shape=box];\n"1" [label=CALL NAME="a \\"b\\""]\n"2" [label="METHOD" LINE_NUMBER=7];\n1 -> 2 [label="DDG: &lt;x&gt;"]; 1 -> 2\n}\n')
    nodes, edges = dot.graphs(spark, str(tmp_path))
    assert {(r.node, r.label, r.name, r.line) for r in dot.code_nodes(nodes).collect()} == {("1", "CALL", 'a "b"', None), ("2", "METHOD", None, 7)}
    assert {(r.src, r.dst, r.key, r.label) for r in edges.collect()} == {("1", "2", 0, "DDG: <x>"), ("1", "2", 1, None)}
    again = dot.rendered(nodes, edges).first().text
    assert [x[:3] for x in dot.parse(again)[1]] == [("1", "2", 0), ("1", "2", 1)]


def test_git(spark, tmp_path):
    repo = str(tmp_path / "r")
    run = lambda *a: subprocess.run(["git", "-C", repo, *a], check=True, capture_output=True)
    os.mkdir(repo)
    run("init", "-q", "-b", "main")
    run("config", "user.email", "a@b.c")
    run("config", "user.name", "a")
    for i, (name, body) in enumerate([("a.py", "x = 1\n"), ("n.txt", "n\n"), ("a.py", "x = 2\n")]):
        (tmp_path / "r" / name).write_text(body)
        run("add", "-A")
        run("commit", "-qm", str(i))
    older = git.commits(spark, [repo], first_parent=False, merges=False).orderBy("ord").collect()
    assert [r.is_useful for r in older] == [False, False, True]  # the first commit tells no file
    c = git.commits(spark, [repo]).orderBy("ord").collect()
    assert [r.is_useful for r in c] == [True, False, True] and c[2].base_hash == c[0].hash and c[0].parent_hash is None
    assert git.branches(spark, [repo]).first().branch == "main"
    d = diffs.changed_lines(git.diff(spark, repo, c[0].hash, c[2].hash).where("diff <> ''"), ["commit"]).where("file = 'a.py'")
    assert {(r.side, r.line) for r in d.collect()} == {("added", 1), ("deleted", 1)}
    assert git.snapshot(spark, [repo], c[0].hash).first().content == "x = 1\n"


def test_tables_and_sinks(spark, tmp_path):
    p = str(tmp_path / "in.csv")
    with open(p, "w", newline="") as f:
        f.write('repo_name,commit_num,commit,code_slice,ground_truth,prediction\r\nr,1,c,"a,b",,Benign\r\n')
    df = tables.slice_labels(spark, p)
    assert df.first().asDict() == {"repo_name": "r", "commit_num": 1, "commit": "c", "code_slice": "a,b", "ground_truth": "", "prediction": "Benign", "malware_type": "", "_row_id": 0}
    with pytest.raises(ValueError):
        tables.csv(spark, p, ["nope"])
    out = str(tmp_path / "out")
    sinks.write_csv(df.where("false"), out, ["repo_name", "commit_num"])
    assert tables.csv(spark, out).columns == ["repo_name", "commit_num", "_row_id"]
    t = str(tmp_path / "t")
    sinks.append(df, t, ["repo_name", "commit"])
    sinks.append(df, t, ["repo_name", "commit"])
    assert spark.read.parquet(t).count() == 2
    with pytest.raises(ValueError):
        sinks.append(df, t, ["commit"])
    (tmp_path / "l.txt").write_text(" a \n\nrepo_name\nb,1\n")
    assert [r.value for r in tables.lines(spark, str(tmp_path / "l.txt")).orderBy("ord").collect()] == ["a", "repo_name", "b,1"]
    assert [r.value for r in tables.first_column(spark, str(tmp_path / "l.txt")).orderBy("ord").collect()] == ["a", "b"]


def test_answers_join_labels(spark, tmp_path):
    d = tmp_path / "res" / "r" / "1_abcde_00000"
    d.mkdir(parents=True)
    (d / "A@f.py_slice_two_steps.json").write_text(json.dumps({"Malware Type": "type c"}))
    labels = spark.createDataFrame([("r", 1, "abcde", "a@f.py_slice.py"), ("r", 2, "abcde", "a@f.py_slice.py")], "repo_name string, commit_num int, commit string, code_slice string")
    got = tables.attach_types(labels, tables.sidecars(spark, str(tmp_path / "res")))
    assert [r.malware_type for r in got.orderBy("commit_num").collect()] == ["Type C", ""]


def test_classifier(spark):
    s = "repo_name string, commit_num int, commit string, code_slice string, text string"
    slices = spark.createDataFrame([("r", 0, "c", "NEW@a", "exec(requests.get(u).text)"), ("r", 0, "c", "b", "x"), ("r", 0, "c", "NEW@k", "x")], s)
    cached = spark.createDataFrame([("r", 0, "c", "NEW@k", '{"Classification": "Undetermined"}')], "repo_name string, commit_num int, commit string, code_slice string, body string")
    got = {r.code_slice: r.prediction for r in classify.label_rows(slices, cached).collect()}
    assert got == {"NEW@a": "Core Attack Chain", "b": "SAME AS BEFORE", "NEW@k": "Undetermined"}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    schema = "_row_id long, repo_name string, commit_num int, commit string, code_slice string, ground_truth string"
    data = [(i, "r", i // 4, f"c{i // 4}", rng.choice(["NEW@", ""]) + rng.choice("ab") + "@f", rng.choice(["Benign", "Core Attack Chain", "SAME AS BEFORE", "bad"])) for i in range(60)]
    src = str(tmp_path / "src")
    for k in range(3):
        spark.createDataFrame(data[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(src)
    q = carry.carried(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src), "ground_truth").writeStream.format("memory").queryName("carried").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r._row_id: (r.resolved, r.is_open) for r in spark.table("carried").collect()}
    want = {r._row_id: (r.ground_truth_resolved, r.ground_truth_open) for r in rollups.resolved(spark.createDataFrame(data, schema), "ground_truth").collect()}
    assert got == want
