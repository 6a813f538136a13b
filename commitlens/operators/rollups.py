"""Carry-forward of labels and rollups per commit.

slice labels: repo_name, commit_num, commit, code_slice, ground_truth, prediction, malware_type, _row_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L

COMMIT = ["repo_name", "commit_num", "commit"]


def require(df: DataFrame, *names: str) -> DataFrame:
    """df, if it has these columns."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return df


def history(*more: str):
    """Rows of a slice in order of its commits up to this one; the row id breaks ties."""
    return Window.partitionBy("repo_name", "slice_id", *more).orderBy("commit_num", "commit", "code_slice", "_row_id").rowsBetween(Window.unboundedPreceding, 0)


def resolved(df: DataFrame, *label_cols: str) -> DataFrame:
    """df with slice_id and, for each label column, <column>_resolved: the label, or for SAME AS BEFORE the slice's last valid one.

    It is null for labels out of the domain and for SAME without a label before, and <column>_open marks the latter.
    One window serves all columns.
    """
    df = require(df, *COMMIT, "code_slice", "_row_id", *label_cols).withColumn("slice_id", L.slice_id("code_slice"))
    raw = {c: L.canonical(c) for c in label_cols}
    valid = {c: F.when(L.is_valid(x), x) for c, x in raw.items()}
    df = df.withColumns({f"{c}_resolved": F.when(raw[c] == L.SAME, F.last(valid[c], ignorenulls=True).over(history())).otherwise(valid[c]) for c in label_cols})
    return df.withColumns({f"{c}_open": (raw[c] == L.SAME) & F.col(f"{c}_resolved").isNull() for c in label_cols})


def typed(df: DataFrame, label_col: str, type_col: str = "malware_type") -> DataFrame:
    """resolved rows with `type`: the slice's last type that is not empty, over rows whose label resolved only."""
    rows = resolved(df, label_col).where(F.col(f"{label_col}_resolved").isNotNull())
    return rows.withColumn("type", F.coalesce(F.last(F.nullif(L.malware_type(type_col), F.lit("")), ignorenulls=True).over(history()), F.lit("")))


def worst(label: Column) -> Column:
    """Aggregate: the label of greatest severity; empty of none."""
    return F.coalesce(L.state_of(F.max(L.severity(label))), F.lit(""))


def label_set(label: Column) -> Column:
    """Aggregate: the distinct labels in order of severity, joined by bars."""
    pairs = F.array_sort(F.collect_set(F.when(label.isNotNull(), F.struct(L.severity(label).alias("s"), label.alias("l")))))
    return F.array_join(F.transform(pairs, lambda x: x["l"]), " | ")


def commit_rollup(df: DataFrame, *label_cols: str, debug: bool = False) -> DataFrame:
    """One row per commit with the worst resolved label of each label column; commits without one stay, with an empty label."""
    rows = resolved(df, *label_cols)
    aggs = [worst(F.col(f"{c}_resolved")).alias(c) for c in label_cols]
    if debug:
        aggs += [label_set(F.col(f"{c}_resolved")).alias(f"{c}_resolved_label_set") for c in label_cols]
        aggs += [F.count_if(F.col(f"{c}_open")).alias(f"{c}_unresolved_same_count") for c in label_cols]
    return rows.groupBy(*COMMIT).agg(*aggs)


def label_frequency(rollup: DataFrame, label_col: str) -> DataFrame:
    """label and n, by falling count and then name; empty labels as <empty>."""
    label = F.when(F.col(label_col) == "", "<empty>").otherwise(F.col(label_col))
    return rollup.groupBy(label.alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def commit_status(df: DataFrame, repos: DataFrame, *label_cols: str) -> DataFrame:
    """Per commit of the listed repos, whether any slice that is new there is a core or full attack; in list order (ord)."""
    rows = require(df, *COMMIT, "code_slice", *label_cols).join(repos.select("repo_name", "ord"), "repo_name")
    hit = {c: F.coalesce(F.bool_or(F.when(L.is_new("code_slice"), L.is_cf(L.canonical(c)))), F.lit(False)) for c in label_cols}
    return rows.groupBy("ord", *COMMIT).agg(*[h.cast("int").alias(f"{c}_current_commit_status") for c, h in hit.items()])


def require_all_repos(status: DataFrame, repos: DataFrame) -> DataFrame:
    """status, if every listed repo has rows in it."""
    missing = repos.join(status, "repo_name", "left_anti").select("repo_name").limit(20)
    if names := [r.repo_name for r in missing.collect()]:
        raise ValueError(f"no rows for listed repos, such as {names}")
    return status


def slice_states(df: DataFrame, label_col: str) -> tuple[DataFrame, DataFrame]:
    """The worst state per (repo, type, slice, commit), and per (repo, type, file, commit); rows without a type are left out."""
    rows = typed(df, label_col).where("type <> ''").withColumn("_id", L.slice_identity("code_slice"))
    rows = rows.select(*COMMIT, "type", "slice_id", F.col("_id.method").alias("method"), F.col("_id.file_token").alias("file_token"), F.col(f"{label_col}_resolved").alias("state"))
    return (rows.groupBy(*COMMIT, "type", "slice_id", "method", "file_token").agg(worst(F.col("state")).alias("state")), rows.groupBy(*COMMIT, "type", "file_token").agg(worst(F.col("state")).alias("state")))


def in_result_order(rows: DataFrame) -> DataFrame:
    """Rows (repo_name, commit_num, commit, file) with rank: their place in the repo's result table, by number, hash and file."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("repo_name").orderBy("commit_num", "commit", "file")))


def in_list_order(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of listed repos (repo_name, ord) sorted as the list names them, then by commit."""
    return rows.drop("ord").join(listed.select("repo_name", "ord"), "repo_name").orderBy("ord", "commit_num", "commit")


def by_name(c) -> list:
    """Sort keys of names in any case; of names that differ in case alone, upper case comes first."""
    return [F.lower(c), F.col(c)]
