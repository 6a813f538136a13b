"""Engine inputs derived from the driver's tables, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Valid in both engines.
_SLICE_COLUMNS = """
event_id AS _row_id, concat('repo_', CAST(user_id % 20 AS {text})) AS repo_name, CAST(floor(event_id / 50.0) AS INT) AS commit_num,
left(md5(CAST(CAST(floor(event_id / 50.0) AS INT) AS {text})), 5) AS commit,
concat(CASE WHEN event_type = 'view' THEN '' ELSE 'NEW@' END, '<module>@f', CAST(event_id % 7 AS {text}), '.py_slice.py') AS code_slice,
CASE event_type WHEN 'signup' THEN 'Benign Artifact' WHEN 'click' THEN 'Undetermined Call Chain' WHEN 'purchase' THEN 'Core Attack Chain' WHEN 'error' THEN 'Full Attack Chain' ELSE 'SAME AS BEFORE' END AS ground_truth,
CASE WHEN event_type = 'view' THEN 'SAME AS BEFORE' ELSE CASE CAST(abs(floor(value)) AS BIGINT) % 5 WHEN 0 THEN 'Benign' WHEN 1 THEN 'Undetermined' WHEN 2 THEN 'Core Attack Chain' WHEN 3 THEN 'Full Attack Chain' ELSE 'Error: invalid_json' END END AS prediction,
CASE WHEN {k} % 4 = 0 THEN '' ELSE concat('Type ', chr(CAST(65 + {k} % 13 AS INT))) END AS malware_type
"""
SLICES_SQL = "slices AS (SELECT " + _SLICE_COLUMNS.format(text="VARCHAR", k="CAST(regexp_extract(props, '[0-9]+', 0) AS INT)") + " FROM events)"


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice labels out of the event stream."""
    k = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
    return table(spark, sf_dir, "events").selectExpr(*[x for x in _split(_SLICE_COLUMNS.format(text="STRING", k=k))])


def _split(columns: str) -> list[str]:
    """A select list cut at its outermost commas."""
    out, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(columns):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(columns[start:i].strip())
                start = i + 1
    return [*out, columns[start:].strip()]


def _canonical(c: str) -> str:
    return f"CASE trim(coalesce({c}, '')) WHEN 'Benign Artifact' THEN 'Benign' WHEN 'Undetermined Call Chain' THEN 'Undetermined' WHEN 'Fragmented Attack Chain' THEN 'Undetermined' ELSE trim(coalesce({c}, '')) END"


def severity_sql(c: str) -> str:
    return f"CASE {c} WHEN 'Benign' THEN 0 WHEN 'Undetermined' THEN 1 WHEN 'Core Attack Chain' THEN 2 WHEN 'Full Attack Chain' THEN 3 WHEN 'Benign/Undetermined' THEN 0 WHEN 'Absent' THEN -1 END"


def state_sql(sev: str) -> str:
    return f"CASE {sev} WHEN 0 THEN 'Benign' WHEN 1 THEN 'Undetermined' WHEN 2 THEN 'Core Attack Chain' WHEN 3 THEN 'Full Attack Chain' END"


CF_SQL = "('Core Attack Chain', 'Full Attack Chain')"
_VALID = "('Benign', 'Undetermined', 'Core Attack Chain', 'Full Attack Chain')"
_W = "OVER (PARTITION BY repo_name, slice_id ORDER BY commit_num, commit, code_slice, _row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

#: Carry-forward of both label columns: gt and pr (null where unresolved), with gt_open and pr_open.
RESOLVED_SQL = f"""{SLICES_SQL},
named AS (SELECT *, regexp_replace(code_slice, '^NEW@', '') AS slice_id, {_canonical("ground_truth")} AS g0, {_canonical("prediction")} AS p0 FROM slices),
resolved AS (SELECT *,
  CASE WHEN g0 = 'SAME AS BEFORE' THEN last_value(CASE WHEN g0 IN {_VALID} THEN g0 END IGNORE NULLS) {_W} WHEN g0 IN {_VALID} THEN g0 END AS gt,
  CASE WHEN p0 = 'SAME AS BEFORE' THEN last_value(CASE WHEN p0 IN {_VALID} THEN p0 END IGNORE NULLS) {_W} WHEN p0 IN {_VALID} THEN p0 END AS pr FROM named)"""


def chains_sql(label: str, p: str) -> str:
    """CTEs after RESOLVED_SQL that end in {p}states: the typed states of a label column (gt or pr)."""
    sev = severity_sql(label)
    return f"""{p}typed AS (SELECT *, coalesce(last_value(nullif(malware_type, '') IGNORE NULLS) {_W}, '') AS type FROM resolved WHERE {label} IS NOT NULL),
{p}own AS (SELECT repo_name, commit_num, commit, type, max({sev}) AS s FROM {p}typed WHERE type <> '' GROUP BY ALL),
{p}soft AS (SELECT repo_name, commit_num, commit, max({sev}) AS s FROM {p}typed WHERE {sev} <= 1 GROUP BY ALL),
{p}all AS (SELECT c.repo_name, t.type AS malware_type, c.commit_num, c.commit,
  coalesce(CASE WHEN o.s <= 1 THEN 'Benign/Undetermined' ELSE {state_sql("o.s")} END, {state_sql("f.s")}, 'Benign/Undetermined') AS state
  FROM (SELECT DISTINCT repo_name, commit_num, commit FROM slices) c JOIN (SELECT DISTINCT repo_name, type FROM {p}own) t USING (repo_name)
  LEFT JOIN {p}own o ON o.repo_name = c.repo_name AND o.commit_num = c.commit_num AND o.commit = c.commit AND o.type = t.type
  LEFT JOIN {p}soft f ON f.repo_name = c.repo_name AND f.commit_num = c.commit_num AND f.commit = c.commit),
{p}states AS (SELECT * FROM {p}all a WHERE NOT EXISTS (SELECT 1 FROM {p}all b WHERE b.repo_name = a.repo_name AND b.malware_type = a.malware_type AND b.commit_num = 0 AND b.state = 'Full Attack Chain'))"""
