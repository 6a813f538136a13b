"""Which file and which slice of a package best explain a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from .graphs import settle

CHAIN = ["repo_name", "malware_type"]


def aligned(chains: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every candidate (repo_name, malware_type, candidate_id, commit_num, commit, state) at every commit of its chain (pos, package_state); Absent where it has no state."""
    ids = candidates.select(*CHAIN, "candidate_id").distinct()
    own = candidates.select(*CHAIN, "candidate_id", "commit_num", "commit", "state")
    return chains.join(ids, CHAIN).join(own, [*CHAIN, "candidate_id", "commit_num", "commit"], "left").withColumn("state", F.coalesce("state", F.lit(L.ABSENT)))


def positions(states: DataFrame) -> DataFrame:
    """Chain rows with pos, package_state and t0 (the position of the chain's first attack); chains without one go."""
    w = Window.partitionBy(*CHAIN).orderBy("commit_num", "commit")
    rows = states.withColumn("pos", F.row_number().over(w) - 1).withColumnRenamed("state", "package_state")
    t0 = F.min(F.when(L.is_cf("package_state"), F.col("pos"))).over(Window.partitionBy(*CHAIN))
    return rows.withColumn("t0", t0).where("t0 is not null")


def scored(states: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per candidate with any coverage, the measures that rank it and its texts."""
    rows = aligned(positions(states), candidates)
    cf, pcf = L.is_cf("state"), L.is_cf("package_state")
    one = rows.groupBy(*CHAIN, "candidate_id").agg(
        F.count("*").alias("n"), F.first("t0").alias("t0"), F.count_if(pcf).alias("package_cf"),
        F.max(F.when(F.col("pos") == F.col("t0"), F.col("state"))).alias("t0_state"),
        F.count_if(pcf & (F.col("state") == F.col("package_state"))).alias("exact"), F.count_if(pcf & cf).alias("coverage"),
        F.min(F.when(cf, F.col("pos"))).alias("first_cf"), F.min(F.when(F.col("state") != L.ABSENT, F.col("pos"))).alias("first_seen"),
        F.min(F.when((F.col("pos") >= F.col("t0")) & ~cf, F.col("pos"))).alias("stop"),
        F.min(F.when(cf, F.struct("pos", "commit_num", "commit"))).alias("hit"),
        F.array_sort(F.collect_list(F.struct("pos", "commit_num", "commit", "state"))).alias("seq"),
    )
    on = L.is_cf("t0_state")
    out = one.where("coverage > 0").select(
        *CHAIN, "candidate_id", "t0_state", on.cast("int").alias("onset_match"), L.severity("t0_state").alias("onset_severity"), "exact", "coverage", F.col("package_cf").alias("malicious_commits"),
        (F.col("coverage") / F.col("package_cf")).alias("ratio"), F.when(on, F.coalesce("stop", "n") - F.col("t0")).otherwise(0).alias("run_length"),
        F.coalesce("first_cf", "n").alias("first_cf_index"), F.coalesce("first_seen", "n").alias("first_seen_index"), F.col("hit.commit_num").alias("first_cf_commit_num"), F.col("hit.commit").alias("first_cf_commit"),
        F.array_join(F.transform("seq", lambda x: x["state"]), " -> ").alias("state_path"),
        F.array_join(F.transform("seq", lambda x: F.concat(x["commit_num"].cast("string"), F.lit("("), x["commit"], F.lit("):"), x["state"])), " -> ").alias("timeline"),
    )
    return out


def ranked(scores: DataFrame, *more: str) -> DataFrame:
    """scores with rank, by eight keys."""
    w = Window.partitionBy(*CHAIN, *more).orderBy(F.desc("onset_match"), F.desc("onset_severity"), F.desc("exact"), F.desc("coverage"), F.desc("run_length"), "first_cf_index", "first_seen_index", "candidate_id")
    return scores.withColumn("rank", F.row_number().over(w))


def key_files(states: DataFrame, file_states: DataFrame) -> DataFrame:
    """The best and the second file of each chain."""
    c = file_states.select("repo_name", F.col("type").alias("malware_type"), F.col("file_token").alias("candidate_id"), "commit_num", "commit", "state")
    return settle(ranked(scored(states, c)).where("rank <= 2"))


def key_slices(states: DataFrame, slice_states: DataFrame, files: DataFrame) -> DataFrame:
    """The best slice of each chain within its best and within its second file (file_rank)."""
    chosen = files.select(*CHAIN, F.col("candidate_id").alias("file_token"), F.col("rank").alias("file_rank"))
    c = slice_states.select("repo_name", F.col("type").alias("malware_type"), F.col("slice_id").alias("candidate_id"), "file_token", "method", "commit_num", "commit", "state")
    c = settle(c.join(chosen, [*CHAIN, "file_token"]))  # of the chosen files alone
    names = c.select(*CHAIN, "candidate_id", "file_token", "method", "file_rank").distinct()
    return ranked(scored(states, c).join(names, [*CHAIN, "candidate_id"]), "file_rank").where("rank = 1")


def evolution(states: DataFrame, slice_states: DataFrame, file_states: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per chain that a file and a slice explain: the key file, the key slice, whether several sources carry it, and the runners-up."""
    files = key_files(states, file_states)
    slices = key_slices(states, slice_states, files)
    fields = ["t0_state", "onset_match", "exact", "coverage", "ratio", "run_length", "first_cf_commit_num", "first_cf_commit", "state_path", "timeline"]
    best = files.where("rank = 1").select(*CHAIN, F.col("candidate_id").alias("key_file"), "malicious_commits", *[F.col(c).alias(f"key_file_{c}") for c in fields])
    own = slices.where("file_rank = 1").select(*CHAIN, F.col("candidate_id").alias("key_slice"), F.col("method").alias("key_slice_method"), *[F.col(c).alias(f"key_slice_{c}") for c in fields])
    next_file = files.where("rank = 2").select(*CHAIN, F.col("candidate_id").alias("runner_up_file"), F.col("coverage").alias("runner_up_file_coverage"), F.col("ratio").alias("runner_up_file_ratio"))
    next_slice = slices.where("file_rank = 2").select(*CHAIN, F.col("candidate_id").alias("runner_up_slice"), F.col("method").alias("runner_up_slice_method"), F.col("coverage").alias("runner_up_slice_coverage"), F.col("ratio").alias("runner_up_slice_ratio"))
    out = best.join(own, CHAIN).join(next_file, CHAIN, "left").join(next_slice, CHAIN, "left")
    return out.withColumn("multi_source", (F.col("key_file_ratio") < threshold).cast("int"))


def totals(rows: DataFrame) -> DataFrame:
    """One row over evolution's: all cases, those of several sources, and those whose key file or key slice covers every malicious commit."""
    full = lambda c: F.count_if(F.col(c) == F.col("malicious_commits"))
    return rows.agg(F.count("*").alias("total_cases"), F.count_if(F.col("multi_source") == 1).alias("multi_source_cases"), full("key_file_coverage").alias("full_file_coverage_cases"), full("key_slice_coverage").alias("full_slice_coverage_cases"))
