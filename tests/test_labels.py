"""Label operators on small fixtures, and against plain loops on random rows."""

import random
import time

from pyspark.sql import functions as F

from commitlens.functions import labels as L
from commitlens.functions import text
from commitlens.functions import verdicts as V
from commitlens.operators import chains, compare, rollups
from commitlens.sources import sinks

SCHEMA = "_row_id long, repo_name string, commit_num int, commit string, code_slice string, ground_truth string, malware_type string"


def rows(spark, data):
    return spark.createDataFrame([(i, "r", n, f"c{n}", s, g, t) for i, (n, s, g, t) in enumerate(data)], SCHEMA)


def test_carry_forward_drops_invalid_and_open(spark):
    df = rows(spark, [(0, "NEW@a@f", L.FULL, ""), (1, "a@f", L.SAME, ""), (2, "b@f", L.SAME, ""), (3, "NEW@a@f", "Error: x", ""), (4, "a@f", L.SAME, "")])
    got = {r.commit_num: r.ground_truth for r in rollups.commit_rollup(df, "ground_truth").collect()}
    assert got == {0: L.FULL, 1: L.FULL, 2: "", 3: "", 4: L.FULL}


def test_carry_forward_random(spark):
    rng = random.Random(5)
    data = [(rng.randrange(12), rng.choice(["NEW@", ""]) + rng.choice("abc") + "@f", rng.choice([*L.STATES, L.SAME, L.SAME, "bad", None]), rng.choice(["", "Type A", "none"])) for _ in range(300)]
    df = rows(spark, data)
    got = {r._row_id: (r.ground_truth_resolved, r.ground_truth_open) for r in rollups.resolved(df, "ground_truth").collect()}
    last, want = {}, {}
    for i, (n, s, g, _) in sorted(enumerate(data), key=lambda x: (x[1][0], f"c{x[1][0]}", x[1][1], x[0])):
        key, g = s.removeprefix("NEW@"), g or ""
        if g in L.STATES:
            last[key] = g
        want[i] = (last.get(key) if g == L.SAME else g if g in L.STATES else None, g == L.SAME and key not in last)
    assert got == want


def test_status_and_required_repos(spark):
    df = rows(spark, [(0, "a@f", L.SAME, ""), (1, "NEW@a@f", L.CORE, "")])
    repos = spark.createDataFrame([("r", 0), ("s", 1)], "repo_name string, ord int")
    got = rollups.commit_status(df, repos, "ground_truth")
    assert [tuple(r) for r in got.orderBy("commit_num").select("commit_num", "ground_truth_current_commit_status").collect()] == [(0, 0), (1, 1)]
    try:
        rollups.require_all_repos(got, repos)
        raise AssertionError("a repo without rows passed")
    except ValueError as e:
        assert "s" in str(e)


def test_chain_that_starts_full_is_left_out(spark):
    full = rows(spark, [(0, "NEW@a@f", L.FULL, "Type A"), (1, "a@f", L.SAME, "")])
    core = rows(spark, [(0, "NEW@a@f", L.CORE, "Type A"), (1, "a@f", L.SAME, "")])
    assert chains.typed_chains(full, "ground_truth").count() == 0
    r = chains.typed_chains(core, "ground_truth").first()
    assert (r.starts_as_cf, r.cf_commit_nums, r.timeline) == (1, "0;1", "0(c0):Core Attack Chain -> 1(c1):Core Attack Chain")


def test_patterns(spark):
    cases = [([L.UNDETERMINED, L.CORE, L.FULL], "B/U->C->F"), ([L.CORE, L.CORE], "ALL C"), ([L.FULL, L.CORE], "F->C"), ([L.BENIGN, L.FULL], "B/U->C_or_F"), ([L.BENIGN], None), ([L.MERGED, L.CORE], "ALL C"), ([], None)]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s array<string>")
    assert [r.p for r in df.select("i", L.pattern("s").alias("p")).orderBy("i").collect()] == [p for _, p in cases]
    assert df.where("i = 5").select(L.pattern("s", True).alias("p")).first().p == "B/U->C_or_F"


def test_identities_and_types(spark):
    df = spark.createDataFrame([("NEW@<module>@a_b.py_slice.py", "type b (Client)"), ("x_slice.py", "weird"), (None, None)], "s string, t string")
    got = df.select(L.slice_identity("s").alias("i"), L.type_letter("t").alias("t")).select("i.*", "t").collect()
    assert [tuple(r) for r in got] == [("<module>@a_b.py_slice.py", "<module>", "a_b.py", "Type B"), ("x_slice.py", "", "x", "weird"), ("", "", "", "")]


def test_mismatches(spark):
    s = "repo_name string, malware_type string, commit_num int, state string"
    t = spark.createDataFrame([("r", "A", 0, L.BENIGN), ("r", "A", 1, L.CORE)], s)
    p = spark.createDataFrame([("r", "A", 0, L.UNDETERMINED), ("r", "A", 1, L.FULL), ("r", "A", 2, L.CORE)], s)
    assert compare.rendered(compare.mismatches(t, p)).first().mismatch_commits == "1:Core Attack Chain->Full Attack Chain;2:None->Core Attack Chain"


def test_run_length(spark):
    states = [L.BENIGN, L.CORE, L.FULL, L.BENIGN, L.CORE]
    df = spark.createDataFrame([(1, i, s in L.CF) for i, s in enumerate(states)] + [(2, 0, False)], "k int, pos int, hit boolean")
    got = {r.k: (r.n, r.first_hit, r.run_length) for r in chains.onset_runs(df, "k").collect()}
    assert got == {1: (5, 1, 2), 2: (1, 1, 0)}


def test_timelines_parse(spark):
    df = spark.createDataFrame([("0(ab):Benign -> 1(cd):Core Attack Chain", "0(a):Benign->x->1(b):Full->1(c):Core"), (None, None)], "a string, b string")
    got = df.select(chains.parsed("a").alias("p"), chains.parsed_loose("b").alias("m")).collect()
    assert [tuple(x) for x in got[0].p] == [(0, "ab", "Benign"), (1, "cd", "Core Attack Chain")] and got[0].m == {0: "Benign", 1: L.CORE}
    assert got[1].p == [] and got[1].m == {}


def test_long_timelines_parse_in_one_pass(spark):
    n = 60000
    parts = [f"{i * 7919 % n - 5}(a:{L.FULL if i % 3 else 'Benign Artifact'}" for i in range(n)] + ["4(x", "(y:Core", " 4 (z): maybe Core: ", "9(w):  ", "3.5(v):Full", "4(u)x: odd:one "]
    df = spark.createDataFrame([("->".join(parts),), ("1(a):Core->1(b):Full->2(c):x:y->1(d):",)], "t string")
    start = time.monotonic()
    got = [r.m for r in df.select(chains.parsed_loose("t").alias("m")).collect()]
    assert time.monotonic() - start < 20  # a copy of the map for each part takes minutes
    want = {i * 7919 % n - 5: L.FULL if i % 3 else L.BENIGN for i in range(n)} | {4: "odd:one"}
    assert got[0] == want and got[1] == {1: L.FULL, 2: "x:y"}


def test_bar_labels_round_as_printf(spark):
    for own in ([57, 40, 303, 0], [285, 1715], [287, 1713], [1, 1999], [7]):
        df = spark.createDataFrame(list(zip(L.PATTERNS, own)), "pattern string, count long")
        got = {r.count_: r.label for r in sinks.bar_labels(df).withColumnRenamed("count", "count_").collect()}
        assert got == {n: "%d (%.1f%%)" % (n, 100.0 * n / sum(own)) for n in own}
    rng = random.Random(3)
    x = [i / 20 for i in range(2001)] + [i / 4 for i in range(401)] + [rng.random() * 100 for _ in range(2000)] + [100 * n / t for t in (40, 80, 400, 2000) for n in range(t)]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", text.one_decimal("x").alias("s")).collect()
    assert not [(r.x, r.s) for r in got if r.s != "%.1f" % r.x]


def test_verdicts(spark):
    bodies = ['{"Classification": "Benign", "Malware Type": null, "Malware_Type": "Type C"}', '{"Detected Category": "Malicious"}', '{"error": "e"}', "[1]", None, '[{"x": 1}, {"Malware Type": "Type D"}]']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").orderBy("i")
    got = df.select(V.label("b").alias("l"), V.kind("b").alias("k"), V.kind_or_list("b").alias("kl"), V.safe("b").alias("s")).collect()
    assert [r.l for r in got] == ["Benign", "Malicious", "Error: e", "Undetermined", "Undetermined", "Undetermined"]
    assert got[0].k == "Type C" and got[5].kl == "Type D" and "invalid_json" in got[3].s and got[1].s == bodies[1]


def test_updates_and_barriers(spark):
    keys = ["repo_name", "commit_num", "commit", "code_slice"]
    t = spark.createDataFrame([("r", 0, "c", "a", "x"), ("r", 1, "c", "a", "x")], "repo_name string, commit_num int, commit string, code_slice string, prediction string")
    u = spark.createDataFrame([("r", 0, "c", "a", ""), ("q", 0, "c", "a", "z")], "repo_name string, commit_num int, commit string, code_slice string, new string")
    out = compare.updated(t, u, "prediction", "new")
    assert [r.prediction for r in out.orderBy("commit_num").collect()] == ["", "x"]
    assert tuple(compare.update_metrics(out, t, u, keys).first()) == (2, 1, 1, 1)
    e = spark.createDataFrame([("r", 0, False), ("r", 1, True), ("r", 2, False), ("q", 2, False)], "repo_name string, commit_num int, error boolean")
    assert sorted(tuple(r) for r in compare.until_error(e).select("repo_name", "commit_num").collect()) == [("q", 2), ("r", 0)]


def test_empty_tables(spark):
    df = rows(spark, [])
    assert rollups.commit_rollup(df, "ground_truth").count() == 0 and chains.typed_chains(df, "ground_truth").count() == 0
    assert df.select(F.col("repo_name")).isEmpty()
