"""Truth against prediction: classes of chains, mismatches, pattern counts, rates, audits and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L

KEY4 = ["repo_name", "commit_num", "commit", "code_slice"]


def last_wins(df: DataFrame, keys: list[str], order: str = "_row_id") -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_wins(df: DataFrame, keys: list[str], order: str = "_row_id") -> DataFrame:
    """The first row of each key: duplicates dropped in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def chain_classes(truth: DataFrame, prediction: DataFrame) -> DataFrame:
    """repo_name, malware_type and class for chains (keyed, with has_cf) of either side: missing, extra, none or both."""
    t = truth.select("repo_name", "malware_type", (F.col("has_cf") == 1).alias("t"))
    p = prediction.select("repo_name", "malware_type", (F.col("has_cf") == 1).alias("p"))
    both = t.join(p, ["repo_name", "malware_type"], "full")
    t, p = F.coalesce("t", F.lit(False)), F.coalesce("p", F.lit(False))
    return both.select("repo_name", "malware_type", F.when(t & ~p, "missing").when(~t & p, "extra").when(t & p, "both").otherwise("none").alias("class"))


def mismatches(truth: DataFrame, prediction: DataFrame) -> DataFrame:
    """Per commit, where the states of both sides (repo_name, malware_type, commit_num, state) differ and one is an attack; chains without an attack on both sides are left to their class."""
    keys = ["repo_name", "malware_type"]
    hit = lambda df: df.where(L.is_cf("state")).select(*keys).distinct()
    both = hit(truth).intersect(hit(prediction))
    g = truth.join(both, keys, "left_semi").select(*keys, "commit_num", F.col("state").alias("gt"))
    p = prediction.join(both, keys, "left_semi").select(*keys, "commit_num", F.col("state").alias("pred"))
    rows = g.join(p, [*keys, "commit_num"], "full")
    return rows.where(~F.col("gt").eqNullSafe(F.col("pred")) & (F.coalesce(L.is_cf("gt"), F.lit(False)) | F.coalesce(L.is_cf("pred"), F.lit(False))))


def rendered(rows: DataFrame) -> DataFrame:
    """mismatches as one text per chain: n:truth->prediction joined by semicolons, None for a side without the commit."""
    part = F.concat(F.col("commit_num").cast("string"), F.lit(":"), F.coalesce("gt", F.lit("None")), F.lit("->"), F.coalesce("pred", F.lit("None")))
    listed = F.array_sort(F.collect_list(F.struct("commit_num", part.alias("x"))))
    return rows.groupBy("repo_name", "malware_type").agg(F.array_join(F.transform(listed, lambda s: s["x"]), ";").alias("mismatch_commits"))


def transitions(rows: DataFrame) -> DataFrame:
    """How often each pair of states is mismatched."""
    short = lambda c: F.when(F.col(c) == L.CORE, "C").when(F.col(c) == L.FULL, "F").when(F.col(c).isNull(), "None").otherwise("B/U")
    return rows.groupBy(F.concat(short("gt"), F.lit("->"), short("pred")).alias("transition")).agg(F.count("*").alias("n"))


def pattern_counts(truth: DataFrame, prediction: DataFrame, wrong: DataFrame, merge_bu: bool = True) -> DataFrame:
    """pattern, gt_count, tp_count and fp_count over chains with a `states` array; wrong: keys of chains with mismatches.

    A chain of the truth is a true positive if the prediction has an attack too and no mismatch; predicted chains that
    are mismatched or extra are false positives, by their own pattern.
    """
    keys = ["repo_name", "malware_type"]
    t = truth.select(*keys, L.pattern("states", merge_bu).alias("pattern")).where("pattern is not null")
    p = prediction.select(*keys, L.pattern("states", merge_bu).alias("pattern")).where("pattern is not null")
    bad = wrong.select(*keys).distinct().withColumn("bad", F.lit(1))
    tp = t.join(p.select(*keys), keys, "left_semi").join(bad, keys, "left_anti")
    fp = p.join(bad, keys, "left").join(t.select(*keys, F.lit(1).alias("is_true")), keys, "left").where("bad = 1 or is_true is null")
    rows = [df.select("pattern", F.lit(k).alias("k")) for k, df in (("gt", t), ("tp", tp), ("fp", fp))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("pattern").agg(*[F.count_if(F.col("k") == k).alias(f"{k}_count") for k in ("gt", "tp", "fp")])


def rates(classes: DataFrame, wrong: DataFrame) -> DataFrame:
    """One row: chains of both sides, exact ones, and exact recall and precision."""
    bad = wrong.select("repo_name", "malware_type").distinct().withColumn("bad", F.lit(1))
    x = classes.join(bad, ["repo_name", "malware_type"], "left")
    truth, pred, exact = F.count_if(F.col("class").isin("both", "missing")), F.count_if(F.col("class").isin("both", "extra")), F.count_if((F.col("class") == "both") & F.col("bad").isNull())
    return x.agg(truth.alias("truth_chains"), pred.alias("predicted_chains"), exact.alias("exact_chains"), F.count_if(F.col("bad") == 1).alias("failures"), F.count_if(F.col("class") == "missing").alias("missing"), F.count_if(F.col("class") == "extra").alias("extra"), F.round(exact / F.nullif(truth, F.lit(0)), 6).alias("recall"), F.round(exact / F.nullif(pred, F.lit(0)), 6).alias("precision"))


def inconsistent(a: DataFrame, b: DataFrame, values: list[str], keys: list[str] = KEY4) -> DataFrame:
    """Keys on one side only, or whose values differ, with both sides' values and _merge."""
    x = a.select(*keys, *[F.col(v).alias(f"{v}_x") for v in values], F.lit(True).alias("_l"))
    y = b.select(*keys, *[F.col(v).alias(f"{v}_y") for v in values], F.lit(True).alias("_r"))
    both = x.join(y, keys, "full").withColumn("_merge", F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both"))
    differs = F.lit(False)
    for v in values:
        differs |= ~F.col(f"{v}_x").eqNullSafe(F.col(f"{v}_y"))
    return both.where((F.col("_merge") != "both") | differs).drop("_l", "_r")


def inconsistent_repos(rows: DataFrame) -> DataFrame:
    """One row: repos with an inconsistent row, and the rows."""
    return rows.agg(F.count_distinct("repo_name").alias("n_repos"), F.count("*").alias("n_rows"))


def updated(target: DataFrame, updates: DataFrame, column: str, new: str, keys: list[str] = KEY4) -> DataFrame:
    """target with column replaced where a key has an update (an empty one counts); adds matched and changed. Unmatched updates add no row."""
    up = updates.select(*keys, F.coalesce(F.col(new), F.lit("")).alias("_new"), F.lit(True).alias("_is"))
    out = target.join(up, keys, "left").withColumn("matched", F.col("_is").isNotNull())
    out = out.withColumn("changed", F.col("matched") & ~F.col(column).eqNullSafe(F.col("_new")))
    return out.withColumn(column, F.when(F.col("matched"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_is")


def update_metrics(result: DataFrame, target: DataFrame, updates: DataFrame, keys: list[str] = KEY4) -> DataFrame:
    """One row: total, matched and changed rows, and updates without a row."""
    lost = updates.select(*keys).distinct().join(target.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("unmatched"))
    return result.agg(F.count("*").alias("total"), F.count_if("matched").alias("matched"), F.count_if("changed").alias("changed")).join(F.broadcast(lost))


def pending(todo: DataFrame, *done: DataFrame, keys: list[str], limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows of todo in none of the done tables (completed, or to be skipped); the first `limit` in order."""
    skip = done[0].select(*keys)
    for d in done[1:]:
        skip = skip.unionByName(d.select(*keys))
    out = todo.join(skip.distinct(), keys, "left_anti")
    return out if limit is None else out.orderBy(*(order or keys)).limit(limit)


def without(df: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(excluded.select(*keys).distinct(), keys, "left_anti")


def until_error(rows: DataFrame) -> DataFrame:
    """Rows (repo_name, commit_num, error) of commits before the repo's first with an error in it."""
    first = rows.where("error").groupBy("repo_name").agg(F.min("commit_num").alias("_stop"))
    return rows.join(first, "repo_name", "left").where("_stop is null or commit_num < _stop").drop("_stop")


def until_attack(rows: DataFrame, label: Column) -> DataFrame:
    """Rows up to and with the repo's first commit that holds an attack."""
    first = rows.where(L.is_cf(label)).groupBy("repo_name").agg(F.min("commit_num").alias("_stop"))
    return rows.join(first, "repo_name", "left").where("_stop is null or commit_num <= _stop").drop("_stop")
