"""Chains: the states of a (package, malware type) over the package's commits, their summaries, texts and kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from .graphs import settle
from .rollups import COMMIT, history, resolved


def states(df: DataFrame, label_col: str, keep_full_start: bool = False) -> DataFrame:
    """repo_name, malware_type, commit_num, commit, state: every commit of a repo for every type seen in it.

    A commit's state for a type is the worst typed state there (Benign and Undetermined merged); else the commit's
    worst of Benign and Undetermined over all slices, unmerged; else the merged state. Unless keep_full_start, chains
    that are a full attack at commit number 0 are left out.
    """
    label = F.col(f"{label_col}_resolved")
    severity = F.when(label.isNotNull(), L.severity(label))
    # one pass over the labels; a row per commit and type is left, the type null for labels that did not resolve
    own = F.when(label.isNotNull(), F.nullif(L.malware_type("malware_type"), F.lit("")))
    rows = resolved(df, label_col).withColumn("type", F.last(own, ignorenulls=True).over(history()))
    rows = rows.withColumn("type", F.when(label.isNotNull(), F.coalesce("type", F.lit(""))))
    one = settle(rows.groupBy(*COMMIT, "type").agg(F.max(severity).alias("worst"), F.max(F.when(label.isin(L.BENIGN, L.UNDETERMINED), severity)).alias("soft")))
    commits = one.groupBy(*COMMIT).agg(L.state_of(F.max("soft")).alias("soft"))
    by_type = one.where("type <> ''").select(*COMMIT, "type", L.merged(L.state_of(F.col("worst"))).alias("own"))
    types = by_type.select("repo_name", "type").distinct()
    out = commits.join(types, "repo_name").join(by_type, [*COMMIT, "type"], "left")
    out = out.select("repo_name", F.col("type").alias("malware_type"), "commit_num", "commit", F.coalesce("own", "soft", F.lit(L.MERGED)).alias("state"))
    if keep_full_start:
        return out
    full = F.max((F.col("commit_num") == 0) & (F.col("state") == L.FULL)).over(Window.partitionBy("repo_name", "malware_type"))
    return out.withColumn("_full", full).where(~F.coalesce("_full", F.lit(False))).drop("_full")


def assemble(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and seq: the chain as an array of (commit_num, commit, state), in order of commits."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("commit_num", "commit", "state"))).alias("seq"))


def state_path(seq: Column) -> Column:
    return F.array_join(F.transform(seq, lambda x: x["state"]), " -> ")


def timeline(seq: Column) -> Column:
    return F.array_join(F.transform(seq, lambda x: F.concat(x["commit_num"].cast("string"), F.lit("("), x["commit"], F.lit("):"), x["state"])), " -> ")


def summarized(chains: DataFrame) -> DataFrame:
    """chains (with seq) as flat rows: first commit, first attack, counts, flags and texts. Without an attack its fields are null or empty."""
    keys = [c for c in chains.columns if c != "seq"]
    seq = F.col("seq")
    cf = F.filter(seq, lambda x: L.is_cf(x["state"]))
    first, hit = F.get(seq, 0), F.get(cf, 0)
    return chains.select(
        *keys,
        first["commit_num"].alias("first_commit_num"), first["commit"].alias("first_commit"), first["state"].alias("first_state"),
        hit["commit_num"].alias("first_cf_commit_num"), F.coalesce(hit["commit"], F.lit("")).alias("first_cf_commit"), F.coalesce(hit["state"], F.lit("")).alias("first_cf_state"),
        L.is_cf(first["state"]).cast("int").alias("starts_as_cf"), F.size(seq).alias("timeline_len"), F.size(cf).alias("cf_occurrence_count"),
        F.array_join(F.transform(cf, lambda x: x["commit_num"].cast("string")), ";").alias("cf_commit_nums"), F.array_join(F.transform(cf, lambda x: x["commit"]), ";").alias("cf_commits"),
        state_path(seq).alias("state_path"), timeline(seq).alias("timeline"), (F.size(cf) > 0).cast("int").alias("has_cf"),
    )


def typed_chains(df: DataFrame, label_col: str, keep_full_start: bool = False) -> DataFrame:
    return summarized(assemble(states(df, label_col, keep_full_start), "repo_name", "malware_type"))


def slice_chains(df: DataFrame, label_col: str) -> DataFrame:
    """Chains of single slices over the commits in which they resolved."""
    rows = resolved(df, label_col).where(F.col(f"{label_col}_resolved").isNotNull())
    rows = rows.groupBy("repo_name", "slice_id", "commit_num", "commit").agg(L.state_of(F.max(L.severity(F.col(f"{label_col}_resolved")))).alias("state"))
    return summarized(assemble(rows, "repo_name", "slice_id"))


def parsed(line) -> Column:
    """A timeline's text as (commit_num, commit, state) structs; parts without number, hash or state are skipped."""
    c = F.col(line) if isinstance(line, str) else line
    own = r"^\s*(-?\d+)\s*\(([^:]*)\)\s*:(.*)$"
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), " -> "), lambda t: t.rlike(own))
    return F.transform(parts, lambda t: F.struct(F.regexp_extract(t, own, 1).cast("int").alias("commit_num"), F.regexp_extract(t, own, 2).alias("commit"), F.trim(F.regexp_extract(t, own, 3)).alias("state")))


def parsed_loose(line) -> Column:
    """A timeline's text as a map of commit number to comparison state: cut at any arrow, bad parts skipped, the last of a number wins."""
    c = F.col(line) if isinstance(line, str) else line
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "->"), lambda t: F.struct(F.substring_index(F.substring_index(t, ":", 1), "(", 1).alias("n"), F.when(F.instr(t, ":") > 0, F.substring(t, F.instr(t, ":") + 1, F.length(t))).alias("state")))
    nums = F.transform(parts, lambda p, i: F.struct(F.trim(p["n"]).try_cast("int").alias("n"), i.alias("i"), L.comparison_state(p["state"]).alias("state")))
    good = F.sort_array(F.filter(nums, lambda p: p["n"].isNotNull() & p["state"].isNotNull()))
    # in order of numbers and places, a number's last part stands before the next number; the array of one names `good`, else each part would make it anew
    last = F.get(F.transform(F.array(good), lambda s: F.filter(s, lambda p, i: F.coalesce(F.get(s, i + 1)["n"] != p["n"], F.lit(True)))), 0)
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["n"], p["state"])))


def path_states(path) -> Column:
    """The states of a state path's text, aliases resolved and blanks left out."""
    c = F.col(path) if isinstance(path, str) else path
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "->"), lambda s: L.canonical(s)), lambda s: s != "")


def has_attack(c: str = "has_cf") -> Column:
    """Chains that are not said to be without an attack."""
    return F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "1")


def onset_runs(rows: DataFrame, *keys: str) -> DataFrame:
    """Per sequence (keys, pos, hit): its length, the position of the first hit (the length without one) and how long hits go on from there."""
    first = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.when(F.col("hit"), F.col("pos"))).alias("first"))
    back = rows.join(first, list(keys)).groupBy(*keys, "n", "first").agg(F.min(F.when((F.col("pos") >= F.col("first")) & ~F.col("hit"), F.col("pos"))).alias("stop"))
    return back.select(*keys, "n", F.coalesce("first", "n").alias("first_hit"), F.coalesce(F.coalesce("stop", "n") - F.col("first"), F.lit(0)).alias("run_length"))
