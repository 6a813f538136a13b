"""Queries over slice labels: rollups, chains, comparison, explanation and updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import verdicts as V
from ..operators import chains, compare, explain, rollups
from ..operators.graphs import settle
from .inputs import CF_SQL, RESOLVED_SQL, SLICES_SQL, chains_sql, severity_sql, slices, state_sql
from .registry import query

_EMPTY = "coalesce({}, '')"


def _worst(c: str) -> str:
    return f"coalesce({state_sql('max(' + severity_sql(c) + ')')}, '')"


def _set(c: str) -> str:
    return f"coalesce(string_agg(DISTINCT {c}, ' | ' ORDER BY {c}), '')"


@query("commit_rollup_truth", f"WITH {RESOLVED_SQL} SELECT repo_name, commit_num, commit, {_worst('gt')} AS ground_truth FROM resolved GROUP BY ALL")
def commit_rollup_truth(spark, sf_dir):
    return rollups.commit_rollup(slices(spark, sf_dir), "ground_truth")


@query("commit_rollup_both", f"WITH {RESOLVED_SQL} SELECT repo_name, commit_num, commit, {_worst('gt')} AS ground_truth, {_worst('pr')} AS prediction FROM resolved GROUP BY ALL")
def commit_rollup_both(spark, sf_dir):
    return rollups.commit_rollup(slices(spark, sf_dir), "ground_truth", "prediction")


@query("unresolved_same_counts", f"WITH {RESOLVED_SQL} SELECT repo_name, commit_num, commit, count(*) FILTER (g0 = 'SAME AS BEFORE' AND gt IS NULL) AS gt_open, count(*) FILTER (p0 = 'SAME AS BEFORE' AND pr IS NULL) AS pr_open FROM resolved GROUP BY ALL")
def unresolved_same_counts(spark, sf_dir):
    got = rollups.commit_rollup(slices(spark, sf_dir), "ground_truth", "prediction", debug=True)
    return got.select(*rollups.COMMIT, F.col("ground_truth_unresolved_same_count").alias("gt_open"), F.col("prediction_unresolved_same_count").alias("pr_open"))


@query("label_frequency", f"WITH {RESOLVED_SQL}, r AS (SELECT repo_name, commit_num, commit, {_worst('gt')} AS l FROM resolved GROUP BY ALL) SELECT CASE WHEN l = '' THEN '<empty>' ELSE l END AS label, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, label")
def label_frequency(spark, sf_dir):
    return rollups.label_frequency(rollups.commit_rollup(slices(spark, sf_dir), "ground_truth"), "ground_truth")


# the states' names sort by severity only in part, so the set is ordered by severity through a list of pairs
@query("label_sets", f"WITH {RESOLVED_SQL} SELECT repo_name, commit_num, commit, coalesce(array_to_string(list_transform(list_sort(list(DISTINCT {severity_sql('gt')}) FILTER (gt IS NOT NULL)), lambda s: {state_sql('s')}), ' | '), '') AS label_set FROM resolved GROUP BY ALL")
def label_sets(spark, sf_dir):
    got = rollups.commit_rollup(slices(spark, sf_dir), "ground_truth", debug=True)
    return got.select(*rollups.COMMIT, F.col("ground_truth_resolved_label_set").alias("label_set"))


def _repos(spark, sf_dir):
    return slices(spark, sf_dir).select("repo_name").distinct().where("repo_name not like '%7'").withColumn("ord", F.substring("repo_name", 6, 9).cast("int"))


def _status_sql(c: str, name: str) -> str:
    return f"CAST(coalesce(bool_or({c} IN {CF_SQL}) FILTER (code_slice LIKE 'NEW@%'), false) AS INT) AS {name}_current_commit_status"


@query("commit_status_new_only", f"WITH {RESOLVED_SQL} SELECT CAST(substr(repo_name, 6) AS INT) AS ord, repo_name, commit_num, commit, {_status_sql('g0', 'ground_truth')}, {_status_sql('p0', 'prediction')} FROM resolved WHERE repo_name NOT LIKE '%7' GROUP BY ALL")
def commit_status_new_only(spark, sf_dir):
    repos = _repos(spark, sf_dir)
    return rollups.require_all_repos(rollups.commit_status(slices(spark, sf_dir), repos, "ground_truth", "prediction"), repos)


def _chain_sql(p: str) -> str:
    """Summaries of {p}states."""
    cf = f"FILTER (state IN {CF_SQL})"
    return f"""SELECT repo_name, malware_type, min_by(commit_num, (commit_num, commit)) AS first_commit_num, min_by(commit, (commit_num, commit)) AS first_commit, min_by(state, (commit_num, commit)) AS first_state,
min(commit_num) {cf} AS first_cf_commit_num, coalesce(min_by(commit, (commit_num, commit)) {cf}, '') AS first_cf_commit, coalesce(min_by(state, (commit_num, commit)) {cf}, '') AS first_cf_state,
CAST(min_by(state, (commit_num, commit)) IN {CF_SQL} AS INT) AS starts_as_cf, CAST(count(*) AS INT) AS timeline_len, CAST(count(*) {cf} AS INT) AS cf_occurrence_count,
coalesce(string_agg(CAST(commit_num AS VARCHAR), ';' ORDER BY commit_num, commit) {cf}, '') AS cf_commit_nums, coalesce(string_agg(commit, ';' ORDER BY commit_num, commit) {cf}, '') AS cf_commits,
string_agg(state, ' -> ' ORDER BY commit_num, commit) AS state_path, string_agg(commit_num || '(' || commit || '):' || state, ' -> ' ORDER BY commit_num, commit) AS timeline, CAST(count(*) {cf} > 0 AS INT) AS has_cf
FROM {p}states GROUP BY repo_name, malware_type"""


@query("typed_chains_truth", f"WITH {RESOLVED_SQL}, {chains_sql('gt', 't_')} {_chain_sql('t_')}")
def typed_chains_truth(spark, sf_dir):
    return chains.typed_chains(slices(spark, sf_dir), "ground_truth")


@query("typed_chains_prediction", f"WITH {RESOLVED_SQL}, {chains_sql('pr', 'p_')} {_chain_sql('p_')}")
def typed_chains_prediction(spark, sf_dir):
    return chains.typed_chains(slices(spark, sf_dir), "prediction")


@query("chains_both_union", f"WITH {RESOLVED_SQL}, {chains_sql('gt', 't_')}, {chains_sql('pr', 'p_')} SELECT DISTINCT repo_name, malware_type FROM (SELECT * FROM t_states UNION ALL SELECT * FROM p_states)")
def chains_both_union(spark, sf_dir):
    t, p = _states(spark, sf_dir)
    return t.select("repo_name", "malware_type").union(p.select("repo_name", "malware_type")).distinct()


def _states(spark, sf_dir):
    df = slices(spark, sf_dir)
    return settle(chains.states(df, "ground_truth")), settle(chains.states(df, "prediction"))


def _keys(states):
    return states.groupBy("repo_name", "malware_type").agg(F.max(L.is_cf("state").cast("int")).alias("has_cf"))


_CLASS_SQL = f"""{RESOLVED_SQL}, {chains_sql("gt", "t_")}, {chains_sql("pr", "p_")},
tk AS (SELECT repo_name, malware_type, max(CAST(state IN {CF_SQL} AS INT)) AS t FROM t_states GROUP BY ALL), pk AS (SELECT repo_name, malware_type, max(CAST(state IN {CF_SQL} AS INT)) AS p FROM p_states GROUP BY ALL),
classes AS (SELECT repo_name, malware_type, CASE WHEN coalesce(t, 0) = 1 AND coalesce(p, 0) = 0 THEN 'missing' WHEN coalesce(t, 0) = 0 AND coalesce(p, 0) = 1 THEN 'extra' WHEN t = 1 AND p = 1 THEN 'both' ELSE 'none' END AS class FROM tk FULL JOIN pk USING (repo_name, malware_type)),
mism AS (SELECT repo_name, malware_type, commit_num, t.state AS gt, p.state AS pred FROM (SELECT * FROM t_states SEMI JOIN (FROM classes WHERE class = 'both') USING (repo_name, malware_type)) t
  FULL JOIN (SELECT * FROM p_states SEMI JOIN (FROM classes WHERE class = 'both') USING (repo_name, malware_type)) p USING (repo_name, malware_type, commit_num)
  WHERE t.state IS DISTINCT FROM p.state AND (coalesce(t.state IN {CF_SQL}, false) OR coalesce(p.state IN {CF_SQL}, false)))"""


@query("chain_compare_class", f"WITH {_CLASS_SQL} SELECT * FROM classes")
def chain_compare_class(spark, sf_dir):
    t, p = _states(spark, sf_dir)
    return compare.chain_classes(_keys(t), _keys(p))


@query("chain_mismatches", f"WITH {_CLASS_SQL} SELECT repo_name, malware_type, string_agg(commit_num || ':' || coalesce(gt, 'None') || '->' || coalesce(pred, 'None'), ';' ORDER BY commit_num) AS mismatch_commits FROM mism GROUP BY ALL")
def chain_mismatches(spark, sf_dir):
    return compare.rendered(compare.mismatches(*_states(spark, sf_dir)))


def _short(c: str) -> str:
    return f"CASE WHEN {c} = 'Core Attack Chain' THEN 'C' WHEN {c} = 'Full Attack Chain' THEN 'F' WHEN {c} IS NULL THEN 'None' ELSE 'B/U' END"


@query("mismatch_transitions", f"WITH {_CLASS_SQL} SELECT {_short('gt')} || '->' || {_short('pred')} AS transition, count(*) AS n FROM mism GROUP BY 1")
def mismatch_transitions(spark, sf_dir):
    return compare.transitions(compare.mismatches(*_states(spark, sf_dir)))


_PATTERN_SQL = """CASE WHEN core = 0 AND fu = 0 THEN NULL WHEN fu = 0 THEN CASE WHEN bu THEN 'B/U->C_or_F' ELSE 'ALL C' END WHEN core = 0 THEN CASE WHEN bu THEN 'B/U->C_or_F' ELSE 'ALL F' END
WHEN core < fu THEN CASE WHEN bu THEN 'B/U->C->F' ELSE 'C->F' END ELSE CASE WHEN bu THEN 'B/U->F->C' ELSE 'F->C' END END"""


def _patterns(p: str) -> str:
    return f"""{p}seq AS (SELECT repo_name, malware_type, list(state ORDER BY commit_num, commit) AS s FROM {p}states GROUP BY ALL),
{p}pat AS (SELECT repo_name, malware_type, {_PATTERN_SQL} AS pattern FROM (SELECT repo_name, malware_type, coalesce(list_position(s, 'Core Attack Chain'), 0) AS core, coalesce(list_position(s, 'Full Attack Chain'), 0) AS fu, list_has_any(s, ['Benign', 'Undetermined', 'Benign/Undetermined']) AS bu FROM {p}seq))"""


@query("pattern_counts", f"""WITH {_CLASS_SQL}, {_patterns("t_")}, {_patterns("p_")},
t AS (FROM t_pat WHERE pattern IS NOT NULL), p AS (FROM p_pat WHERE pattern IS NOT NULL), bad AS (SELECT DISTINCT repo_name, malware_type FROM mism),
rows AS (SELECT pattern, 'gt' AS k FROM t UNION ALL SELECT pattern, 'tp' FROM (FROM t SEMI JOIN p USING (repo_name, malware_type)) x ANTI JOIN bad USING (repo_name, malware_type)
  UNION ALL SELECT pattern, 'fp' FROM p WHERE EXISTS (SELECT 1 FROM bad b WHERE b.repo_name = p.repo_name AND b.malware_type = p.malware_type) OR NOT EXISTS (SELECT 1 FROM t WHERE t.repo_name = p.repo_name AND t.malware_type = p.malware_type))
SELECT pattern, count(*) FILTER (k = 'gt') AS gt_count, count(*) FILTER (k = 'tp') AS tp_count, count(*) FILTER (k = 'fp') AS fp_count FROM rows GROUP BY pattern""")  # fmt: skip
def pattern_counts(spark, sf_dir):
    t, p = _states(spark, sf_dir)
    seq = lambda s: chains.assemble(s, "repo_name", "malware_type").select("repo_name", "malware_type", F.transform("seq", lambda x: x["state"]).alias("states"))
    return compare.pattern_counts(seq(t), seq(p), compare.mismatches(t, p))


@query("recall_precision", f"""WITH {_CLASS_SQL}, bad AS (SELECT DISTINCT repo_name, malware_type, 1 AS bad FROM mism), x AS (SELECT * FROM classes LEFT JOIN bad USING (repo_name, malware_type))
SELECT truth_chains, predicted_chains, exact_chains, failures, missing, extra, round(exact_chains / nullif(truth_chains, 0), 6) AS recall, round(exact_chains / nullif(predicted_chains, 0), 6) AS precision
FROM (SELECT count(*) FILTER (class IN ('both', 'missing')) AS truth_chains, count(*) FILTER (class IN ('both', 'extra')) AS predicted_chains, count(*) FILTER (class = 'both' AND bad IS NULL) AS exact_chains, count(*) FILTER (bad = 1) AS failures, count(*) FILTER (class = 'missing') AS missing, count(*) FILTER (class = 'extra') AS extra FROM x)""")  # fmt: skip
def recall_precision(spark, sf_dir):
    t, p = _states(spark, sf_dir)
    return compare.rates(compare.chain_classes(_keys(t), _keys(p)), compare.mismatches(t, p))


_RANK_SQL = f"""{RESOLVED_SQL}, {chains_sql("gt", "t_")},
ids AS (SELECT repo_name, commit_num, commit, type, slice_id, CASE WHEN strpos(regexp_replace(slice_id, '_slice\\.py$', ''), '@') > 0 THEN split_part(regexp_replace(slice_id, '_slice\\.py$', ''), '@', 1) ELSE '' END AS method,
  CASE WHEN strpos(regexp_replace(slice_id, '_slice\\.py$', ''), '@') > 0 THEN substr(regexp_replace(slice_id, '_slice\\.py$', ''), strpos(regexp_replace(slice_id, '_slice\\.py$', ''), '@') + 1) ELSE regexp_replace(slice_id, '_slice\\.py$', '') END AS file_token, {severity_sql("gt")} AS sev FROM t_typed WHERE type <> ''),
pos AS (SELECT * FROM (SELECT *, min(CASE WHEN package_state IN {CF_SQL} THEN pos END) OVER (PARTITION BY repo_name, malware_type) AS t0 FROM (SELECT repo_name, malware_type, commit_num, commit, state AS package_state, CAST(row_number() OVER (PARTITION BY repo_name, malware_type ORDER BY commit_num, commit) - 1 AS INT) AS pos FROM t_states)) WHERE t0 IS NOT NULL)"""


def _score_sql(name: str, cand: str) -> str:
    """CTE `name`: scores of the candidates {cand}(repo_name, malware_type, candidate_id, commit_num, commit, sev), with rank."""
    return f"""{name}_a AS (SELECT p.*, i.candidate_id, coalesce({state_sql("c.sev")}, 'Absent') AS state FROM pos p JOIN (SELECT DISTINCT repo_name, malware_type, candidate_id FROM {cand}) i USING (repo_name, malware_type) LEFT JOIN {cand} c USING (repo_name, malware_type, candidate_id, commit_num, commit)),
{name}_b AS (SELECT repo_name, malware_type, candidate_id, count(*) AS n, any_value(t0) AS t0, count(*) FILTER (package_state IN {CF_SQL}) AS malicious_commits, max(state) FILTER (pos = t0) AS t0_state,
  count(*) FILTER (package_state IN {CF_SQL} AND state = package_state) AS exact, count(*) FILTER (package_state IN {CF_SQL} AND state IN {CF_SQL}) AS coverage,
  min(pos) FILTER (state IN {CF_SQL}) AS first_cf, min(pos) FILTER (state <> 'Absent') AS first_seen, min(pos) FILTER (pos >= t0 AND state NOT IN {CF_SQL}) AS stop FROM {name}_a GROUP BY ALL),
{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_name, malware_type ORDER BY onset_match DESC, onset_severity DESC, exact DESC, coverage DESC, run_length DESC, first_cf_index, first_seen_index, candidate_id) AS INT) AS rank FROM
  (SELECT repo_name, malware_type, candidate_id, t0_state, CAST(t0_state IN {CF_SQL} AS INT) AS onset_match, {severity_sql("t0_state")} AS onset_severity, exact, coverage, malicious_commits, coverage / malicious_commits AS ratio,
   CASE WHEN t0_state IN {CF_SQL} THEN coalesce(stop, n) - t0 ELSE 0 END AS run_length, coalesce(first_cf, n) AS first_cf_index, coalesce(first_seen, n) AS first_seen_index FROM {name}_b WHERE coverage > 0))"""


_FILES_SQL = "fc AS (SELECT repo_name, type AS malware_type, file_token AS candidate_id, commit_num, commit, max(sev) AS sev FROM ids GROUP BY ALL), " + _score_sql("fs", "fc")
_SHOWN = ["repo_name", "malware_type", "candidate_id", "t0_state", "onset_match", "exact", "coverage", "run_length", "rank"]


def _explained(spark, sf_dir):
    df = slices(spark, sf_dir)
    by_slice, by_file = rollups.slice_states(df, "ground_truth")
    return settle(chains.states(df, "ground_truth")), by_slice, by_file


@query("key_file_rank", f"WITH {_RANK_SQL}, {_FILES_SQL} SELECT {', '.join(_SHOWN)} FROM fs WHERE rank <= 2")
def key_file_rank(spark, sf_dir):
    states, _, by_file = _explained(spark, sf_dir)
    return explain.key_files(states, by_file).select(*_SHOWN)


@query("key_slice_rank", f"WITH {_RANK_SQL}, {_FILES_SQL}, sc AS (SELECT i.repo_name, i.type AS malware_type, slice_id AS candidate_id, commit_num, commit, max(sev) AS sev FROM ids i JOIN (FROM fs WHERE rank = 1) f ON f.repo_name = i.repo_name AND f.malware_type = i.type AND f.candidate_id = i.file_token GROUP BY ALL), {_score_sql('ss', 'sc')} SELECT {', '.join(_SHOWN)} FROM ss WHERE rank = 1")
def key_slice_rank(spark, sf_dir):
    states, by_slice, by_file = _explained(spark, sf_dir)
    return explain.key_slices(states, by_slice, explain.key_files(states, by_file)).where("file_rank = 1").select(*_SHOWN)


@query("multi_source", f"WITH {_RANK_SQL}, {_FILES_SQL} SELECT repo_name, malware_type, candidate_id AS key_file, round(ratio, 6) AS key_file_ratio, CAST(ratio < 0.5 AS INT) AS multi_source FROM fs WHERE rank = 1")
def multi_source(spark, sf_dir):
    got = explain.evolution(*_explained(spark, sf_dir))
    return got.select("repo_name", "malware_type", "key_file", F.round("key_file_ratio", 6).alias("key_file_ratio"), "multi_source")


_KEY = "repo_name, commit_num, commit, code_slice"
_LAST = f"last AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY _row_id DESC) AS rn FROM slices) WHERE rn = 1)"


@query("last_wins_map", f"WITH {SLICES_SQL}, {_LAST} SELECT * FROM last")
def last_wins_map(spark, sf_dir):
    return compare.last_wins(slices(spark, sf_dir), compare.KEY4)


@query("dedupe_first", f"WITH {SLICES_SQL} SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, code_slice ORDER BY _row_id) AS rn FROM slices) WHERE rn = 1")
def dedupe_first(spark, sf_dir):
    return compare.first_wins(slices(spark, sf_dir), ["repo_name", "code_slice"])


@query("audit_inconsistent", f"""WITH {SLICES_SQL}, {_LAST}, a AS (FROM last WHERE _row_id % 10 <> 0), b AS (SELECT * REPLACE (CASE WHEN _row_id % 4 = 0 THEN 'Benign' ELSE prediction END AS prediction) FROM last WHERE _row_id % 7 <> 0)
SELECT {_KEY}, a.prediction AS prediction_x, a.malware_type AS malware_type_x, b.prediction AS prediction_y, b.malware_type AS malware_type_y, CASE WHEN b._row_id IS NULL THEN 'left_only' WHEN a._row_id IS NULL THEN 'right_only' ELSE 'both' END AS _merge
FROM a FULL JOIN b USING ({_KEY}) WHERE a._row_id IS NULL OR b._row_id IS NULL OR a.prediction IS DISTINCT FROM b.prediction OR a.malware_type IS DISTINCT FROM b.malware_type""")  # fmt: skip
def audit_inconsistent(spark, sf_dir):
    last = compare.last_wins(slices(spark, sf_dir), compare.KEY4)
    b = last.where("_row_id % 7 <> 0").withColumn("prediction", F.when(F.col("_row_id") % 4 == 0, "Benign").otherwise(F.col("prediction")))
    return compare.inconsistent(last.where("_row_id % 10 <> 0"), b, ["prediction", "malware_type"])


_UPDATES = f"up AS (SELECT {_KEY}, CASE WHEN _row_id % 2 = 0 THEN '' ELSE ground_truth END AS result_two_steps FROM last WHERE _row_id % 3 = 0 UNION ALL SELECT concat('no_', repo_name), commit_num, commit, code_slice, 'x' FROM last WHERE _row_id % 50 = 0)"


def _updates(spark, sf_dir):
    last = compare.last_wins(slices(spark, sf_dir), compare.KEY4)
    own = last.where("_row_id % 3 = 0").select(*compare.KEY4, F.when(F.col("_row_id") % 2 == 0, "").otherwise(F.col("ground_truth")).alias("result_two_steps"))
    lost = last.where("_row_id % 50 = 0").select(F.concat(F.lit("no_"), "repo_name").alias("repo_name"), "commit_num", "commit", "code_slice", F.lit("x").alias("result_two_steps"))
    return own.unionByName(lost)


@query("prediction_upsert", f"WITH {SLICES_SQL}, {_LAST}, {_UPDATES} SELECT s._row_id, {_KEY}, CASE WHEN up.repo_name IS NULL THEN s.prediction ELSE result_two_steps END AS prediction FROM slices s LEFT JOIN up USING ({_KEY})")
def prediction_upsert(spark, sf_dir):
    return compare.updated(slices(spark, sf_dir), _updates(spark, sf_dir), "prediction", "result_two_steps").select("_row_id", *compare.KEY4, "prediction")


@query("upsert_metrics", f"""WITH {SLICES_SQL}, {_LAST}, {_UPDATES}, j AS (SELECT s.prediction, up.repo_name IS NOT NULL AS matched, up.result_two_steps AS v FROM slices s LEFT JOIN up USING ({_KEY}))
SELECT count(*) AS total, count(*) FILTER (matched) AS matched, count(*) FILTER (matched AND prediction IS DISTINCT FROM v) AS changed, (SELECT count(*) FROM up ANTI JOIN slices USING ({_KEY})) AS unmatched FROM j""")  # fmt: skip
def upsert_metrics(spark, sf_dir):
    own, up = slices(spark, sf_dir), _updates(spark, sf_dir)
    return compare.update_metrics(compare.updated(own, up, "prediction", "result_two_steps"), own, up)


@query("resume_pending", f"WITH {SLICES_SQL}, todo AS (SELECT DISTINCT repo_name, commit_num, commit FROM slices), done AS (FROM todo WHERE commit_num % 3 = 0), flagged AS (SELECT DISTINCT repo_name, commit_num, commit FROM slices WHERE ground_truth = 'Full Attack Chain') SELECT * FROM todo ANTI JOIN done USING (repo_name, commit_num, commit) ANTI JOIN flagged USING (repo_name, commit_num, commit) ORDER BY repo_name, commit_num, commit LIMIT 100")
def resume_pending(spark, sf_dir):
    own = slices(spark, sf_dir)
    todo = own.select(*rollups.COMMIT).distinct()
    return compare.pending(todo, todo.where("commit_num % 3 = 0"), own.where("ground_truth = 'Full Attack Chain'").select(*rollups.COMMIT), keys=rollups.COMMIT, limit=100)


@query("exclusion_antijoin", f"WITH {RESOLVED_SQL} SELECT DISTINCT repo_name, slice_id FROM resolved ANTI JOIN (SELECT DISTINCT repo_name, slice_id FROM resolved WHERE commit_num = 0 AND gt = 'Full Attack Chain') USING (repo_name, slice_id)")
def exclusion_antijoin(spark, sf_dir):
    rows = rollups.resolved(slices(spark, sf_dir), "ground_truth")
    bad = rows.where((F.col("commit_num") == 0) & (F.col("ground_truth_resolved") == L.FULL))
    return compare.without(rows.select("repo_name", "slice_id").distinct(), bad, ["repo_name", "slice_id"])


_SEQ_SQL = f"{RESOLVED_SQL}, {chains_sql('gt', 't_')}, seq AS (SELECT repo_name, malware_type, CAST(row_number() OVER (PARTITION BY repo_name, malware_type ORDER BY commit_num, commit) - 1 AS INT) AS pos, state IN {CF_SQL} AS hit FROM t_states)"


@query("run_length_onset", f"WITH {_SEQ_SQL}, f AS (SELECT repo_name, malware_type, count(*) AS n, min(pos) FILTER (hit) AS first FROM seq GROUP BY ALL) SELECT repo_name, malware_type, n, coalesce(first, n) AS first_hit, coalesce(coalesce((SELECT min(pos) FROM seq s WHERE s.repo_name = f.repo_name AND s.malware_type = f.malware_type AND pos >= first AND NOT hit), n) - first, 0) AS run_length FROM f")
def run_length_onset(spark, sf_dir):
    states = chains.states(slices(spark, sf_dir), "ground_truth")
    w = rollups.Window.partitionBy("repo_name", "malware_type").orderBy("commit_num", "commit")
    return chains.onset_runs(states.select("repo_name", "malware_type", (F.row_number().over(w) - 1).alias("pos"), L.is_cf("state").alias("hit")), "repo_name", "malware_type")


@query("first_cf", f"WITH {RESOLVED_SQL}, {chains_sql('gt', 't_')} SELECT repo_name, malware_type, min(commit_num) FILTER (state IN {CF_SQL}) AS first_cf_commit_num, coalesce(min_by(commit, (commit_num, commit)) FILTER (state IN {CF_SQL}), '') AS first_cf_commit FROM t_states GROUP BY ALL")
def first_cf(spark, sf_dir):
    return chains.typed_chains(slices(spark, sf_dir), "ground_truth").select("repo_name", "malware_type", "first_cf_commit_num", "first_cf_commit")


@query("timeline_roundtrip", f"WITH {RESOLVED_SQL}, {chains_sql('gt', 't_')} SELECT repo_name, malware_type, commit_num, commit, state FROM t_states")
def timeline_roundtrip(spark, sf_dir):
    got = chains.typed_chains(slices(spark, sf_dir), "ground_truth")
    return got.select("repo_name", "malware_type", F.inline(chains.parsed("timeline")))


@query("slice_identity", f"WITH {SLICES_SQL} SELECT DISTINCT code_slice, regexp_replace(code_slice, '^NEW@', '') AS slice_id, split_part(regexp_replace(code_slice, '^NEW@', ''), '@', 1) AS method, split_part(regexp_replace(regexp_replace(code_slice, '^NEW@', ''), '_slice\\.py$', ''), '@', 2) AS file_token FROM slices")
def slice_identity(spark, sf_dir):
    return slices(spark, sf_dir).select("code_slice").distinct().select("code_slice", L.slice_identity("code_slice").alias("i")).select("code_slice", "i.*")


_BODY_SQL = """body AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"Classification": "' || event_type || '", "Malware_Type": "type b (Client)"}' WHEN 1 THEN '{"Detected Category": "Malicious", "Malware Type": "Type ' || chr(CAST(65 + event_id % 13 AS INT)) || '"}' WHEN 2 THEN '{"error": "invalid_json", "raw_response": "x"}' WHEN 3 THEN '{"Other": 1}' ELSE '{"Classification": "Full Attack Chain", "malware_type": "weird"}' END AS body FROM events)"""


@query("verdict_labels", f"""WITH {_BODY_SQL}, x AS (SELECT event_id, coalesce(body->>'$.Classification', body->>'$."Detected Category"', 'Error: ' || (body->>'$.error'), 'Undetermined') AS label, coalesce(body->>'$."Malware Type"', body->>'$.Malware_Type', body->>'$.malware_type', '') AS kind, body->>'$."Detected Category"' AS cat FROM body)
SELECT event_id, label, kind, CASE WHEN cat = 'Malicious' THEN 'Core Attack Chain' ELSE 'Undetermined' END AS step_one, CASE WHEN label IN ('Benign', 'Undetermined', 'Core Attack Chain', 'Full Attack Chain') THEN label ELSE 'Undetermined' END AS step_two FROM x""")  # fmt: skip
def verdict_labels(spark, sf_dir):
    body = """CASE event_id % 5 WHEN 0 THEN concat('{"Classification": "', event_type, '", "Malware_Type": "type b (Client)"}') WHEN 1 THEN concat('{"Detected Category": "Malicious", "Malware Type": "Type ', chr(65 + event_id % 13), '"}') WHEN 2 THEN '{"error": "invalid_json", "raw_response": "x"}' WHEN 3 THEN '{"Other": 1}' ELSE '{"Classification": "Full Attack Chain", "malware_type": "weird"}' END"""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(body).alias("body"))
    return df.select("event_id", V.label("body").alias("label"), V.kind("body").alias("kind"), V.step_one(F.get_json_object("body", "$['Detected Category']")).alias("step_one"), V.step_two(V.label("body")).alias("step_two"))


@query("type_letter", f"WITH {_BODY_SQL}, x AS (SELECT DISTINCT trim(coalesce(body->>'$.\"Malware Type\"', body->>'$.Malware_Type', body->>'$.malware_type', '')) AS raw FROM body) SELECT raw, CASE WHEN regexp_matches(raw, '(?i)\\bType\\s*[A-Z]\\b') THEN 'Type ' || upper(regexp_extract(raw, '(?i)\\bType\\s*([A-Z])\\b', 1)) ELSE raw END AS kind FROM x")
def type_letter(spark, sf_dir):
    return verdict_labels(spark, sf_dir).select(F.trim("kind").alias("raw")).distinct().select("raw", L.type_letter("raw").alias("kind"))
