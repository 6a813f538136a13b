"""Sinks: fixed-column CSV, guarded appends, JSON answers, slice files, reports and summaries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str] | None = None) -> None:
    """Columns in this order with a header, even of no rows."""
    out = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns]) if not order else df.orderBy(*order).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns])
    if out.isEmpty():
        out = out.repartition(1)
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def rewrite(df: DataFrame, path: str, columns: list[str], backup: bool = False) -> None:
    """The Parquet table at path replaced by df's columns, which may be read from it: written beside it first, then renamed.

    With backup the table before stays at path.bak. A write that fails leaves the table as it was; a driver lost between
    the two renames leaves it at path.old.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    at, new, old, kept = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", ".new", ".old", ".bak"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def move(a, b):
        fs.delete(b, True)
        if not fs.rename(a, b):
            raise OSError(f"can't rename {a} to {b}")

    df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]).write.mode("overwrite").parquet(new.toString())
    had = fs.exists(at)
    if had:
        move(at, old)
    move(new, at)
    if had:
        if backup:
            move(old, kept)
        else:
            fs.delete(old, True)


def append(df: DataFrame, path: str, columns: list[str]) -> None:
    """Rows appended to a Parquet table whose columns must be these."""
    spark = df.sparkSession
    try:
        had = spark.read.parquet(path).columns
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        had = columns
    if had != columns:
        raise ValueError(f"the table's columns are {had}, not {columns}")
    df.select(*columns).write.mode("append").parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Rows whose key the table does not hold yet, each key once."""
    spark = df.sparkSession
    new = df.select(key).distinct()
    try:
        new = new.join(spark.read.parquet(path), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new.write.mode("append").parquet(path)


def write_slices(slices: DataFrame, path: str) -> None:
    """repo_name, commit_num, slice_file, is_new, text as a table by repo and commit; written anew."""
    own = slices.withColumn("text", F.array_join(F.transform(F.split("text", "\n"), F.rtrim), "\n"))
    own.repartition("repo_name", "commit_num").write.mode("overwrite").partitionBy("repo_name", "commit_num").parquet(path)


def write_answers(answers: DataFrame, path: str) -> None:
    """Answers as JSON lines; what is no JSON object is kept inside an error object."""
    from ..functions.verdicts import safe

    answers.select("*", safe("body").alias("_b")).drop("body").withColumnRenamed("_b", "body").write.mode("overwrite").json(path)


def report(chains: DataFrame, title: str) -> Iterator[str]:
    """Lines of a numbered report of chains with their timelines, a partition at a time on the driver."""
    yield title
    for i, r in enumerate(chains.orderBy("repo_name", "malware_type").select("repo_name", "malware_type", "state_path", "timeline").toLocalIterator(), 1):
        yield f"[{i}] {r.repo_name} | {r.malware_type}"
        yield f"  states: {r.state_path}"
        yield from (f"    {part}" for part in r.timeline.split(" -> "))


def summary(df: DataFrame, **aggs) -> DataFrame:
    """One row of name=aggregate."""
    return df.agg(*[a.alias(k) for k, a in aggs.items()])


def bar_labels(counts: DataFrame) -> DataFrame:
    """pattern, count, share and label of a bar chart, by falling count and then the patterns' own order."""
    from ..functions.labels import PATTERNS
    from ..functions.text import one_decimal

    total = counts.agg(F.sum("count").alias("_t"))
    share = F.col("count") / F.col("_t")
    order = F.array_position(F.array(*[F.lit(p) for p in PATTERNS]), F.col("pattern"))
    return counts.join(F.broadcast(total)).select("pattern", "count", share.alias("share"), F.format_string("%d (%s%%)", "count", one_decimal(100 * F.col("count") / F.col("_t"))).alias("label"), order.alias("ord")).orderBy(F.desc("count"), "ord").drop("ord")


def processed_flags(repos: DataFrame, dirs: DataFrame) -> DataFrame:
    """repos with Processed: whether a result folder of the repo's base name exists."""
    own = repos.withColumn("_base", F.substring_index("Repo Name", "/", -1))
    return own.join(dirs.select(F.col("name").alias("_base"), F.lit(True).alias("_is")).distinct(), "_base", "left").withColumn("Processed", F.when(F.col("_is"), "Yes").otherwise("No")).drop("_base", "_is")
