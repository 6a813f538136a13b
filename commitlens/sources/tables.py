"""Tables from files: CSV, lists, JSON sidecars and source trees, all read by Spark's own readers."""

from __future__ import annotations

import posixpath
import zipfile
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SLICE_LABELS = ["repo_name", "commit_num", "commit", "code_slice", "ground_truth", "prediction", "Malware Type"]


def csv(spark: SparkSession, path: str, require: list[str] | None = None, fill: str = "") -> DataFrame:
    """A CSV with a header, all text, nulls filled, with _row_id in order of lines within a file."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    if require and (missing := [c for c in require if c not in df.columns]):
        raise ValueError(f"columns are missing: {missing}")
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(fill)).alias(c) for c in df.columns]).withColumn("_row_id", F.monotonically_increasing_id())


def slice_labels(spark: SparkSession, path: str) -> DataFrame:
    """Slice labels with typed columns; a number that is none is an error."""
    df = csv(spark, path, SLICE_LABELS[:-1])
    kind = F.col("`Malware Type`") if "Malware Type" in df.columns else F.lit("")
    return df.select("repo_name", F.col("commit_num").cast("int").alias("commit_num"), *SLICE_LABELS[2:-1], kind.alias("malware_type"), "_row_id")


def exact_header(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    df = csv(spark, path)
    if df.columns[:-1] != columns:
        raise ValueError(f"the header is {df.columns[:-1]}, not {columns}")
    return df


def first_column(spark: SparkSession, path: str, header: str = "repo_name") -> DataFrame:
    """value and ord: the first cell of each line, trimmed; blank ones and the header's name go."""
    return _numbered(spark.read.text(path, wholetext=True), F.trim(F.regexp_replace(F.substring_index("value", ",", 1), '^"|"$', ""))).where(F.col("value") != header)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and ord: the lines of a file, trimmed, blank ones left out, in order."""
    return _numbered(spark.read.text(path, wholetext=True), F.trim("value"))


def _numbered(whole: DataFrame, value) -> DataFrame:
    rows = whole.select(F.posexplode(F.split("value", r"\R")).alias("ord", "value")).select(value.alias("value"), "ord")
    return rows.where("value <> ''")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path (relative to the root), length and content of all files below a root."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.select(relative(F.col("path"), path).alias("path"), "length", "content")


def relative(full, root: str):
    """The part of a file's path after its root."""
    tail = posixpath.normpath(root.split("://")[-1]).rstrip("/") + "/"
    return F.url_decode(F.replace(F.substring_index(full, tail, -1), F.lit("+"), F.lit("%2B")))


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the Python files below a root, .git left out; undecodable bytes are replaced and tabs expanded."""
    from ..functions.text import expand_tabs

    own = files(spark, path, "*.{py,pyw}").where("path not like '%.git/%'").select("path", _decoded("content").alias("content"))
    return own.withColumn("content", F.when(F.instr("content", "\t") > 0, expand_tabs("content")).otherwise(F.col("content")))


@F.pandas_udf(StringType())
def _decoded(content: pd.Series) -> pd.Series:
    def one(b):
        for coding in ("utf-8-sig", "utf-16" if b[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8"):
            try:
                return b.decode(coding)
            except UnicodeDecodeError:
                pass
        return b.decode("utf-8", "replace")

    return content.map(one)


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """repo, dir, file (slice file name in lower case) and body of the JSON answers below a root of repo/dir/.../file_two_steps.json."""
    df = files(spark, path, "*_two_steps.json").select("path", F.decode("content", "UTF-8").alias("body"))
    parts = F.split("path", "/")
    return df.select(F.get(parts, 0).alias("repo_name"), F.get(parts, 1).alias("dir"), F.lower(F.regexp_replace(F.substring_index("path", "/", -1), r"_two_steps\.json$", "")).alias("file"), F.when(F.size(parts) > 3, F.get(parts, F.size(parts) - 2)).otherwise("").alias("subdir"), "body")


def unzipped(spark: SparkSession, path: str) -> DataFrame:
    """version, path and content of version folders that hold nothing but zips: of the first zip by name."""
    df = files(spark, path)
    df = df.withColumn("version", F.substring_index("path", "/", 1))
    only = df.groupBy("version").agg(F.bool_and(F.lower("path").endswith(".zip")).alias("all"), F.min("path").alias("path")).where("all").select("version", "path")

    def expand(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                with zipfile.ZipFile(BytesIO(r.content)) as z:
                    names = [n for n in z.namelist() if not n.endswith("/") and ".." not in n.split("/")]
                    yield pd.DataFrame({"version": r.version, "path": names, "content": [z.read(n) for n in names]})

    return df.join(only, ["version", "path"], "left_semi").select("version", "path", "content").mapInPandas(expand, StructType([StructField("version", StringType()), StructField("path", StringType()), *df.select("content").schema.fields]))


def commit_dirs(df: DataFrame, column: str = "dir") -> DataFrame:
    """df with ord, hash and base of its commit directories, of those with three parts or more, and rank: by number (others last), hash and name."""
    from pyspark.sql import Window

    from ..functions.text import dir_parts

    df = df.withColumn("_p", dir_parts(column)).where("_p is not null")
    w = Window.partitionBy("repo_name").orderBy(F.coalesce("_p.ord", F.lit(2147483647)), "_p.hash", column)
    return df.withColumns({"ord": F.col("_p.ord"), "hash": F.col("_p.hash"), "base": F.col("_p.base"), "rank": F.row_number().over(w)}).drop("_p")


def attach_types(labels: DataFrame, answers: DataFrame) -> DataFrame:
    """labels with malware_type from the answer of each slice: matched by commit number, hash and the slice file's name in any case; of several the first subfolder's."""
    from ..functions import verdicts
    from ..functions.labels import type_letter
    from ..functions.text import dir_parts

    a = answers.withColumn("_p", dir_parts("dir")).select("repo_name", F.col("_p.ord").alias("commit_num"), F.col("_p.hash").alias("commit"), "file", "subdir", type_letter(verdicts.kind_or_list("body")).alias("_type"))
    a = a.groupBy("repo_name", "commit_num", "commit", "file").agg(F.min_by("_type", F.struct(F.col("subdir") == "", "subdir")).alias("_type"))
    own = labels.withColumn("file", F.lower(F.regexp_replace("code_slice", r"\.py$", "")))
    out = own.join(a, ["repo_name", "commit_num", "commit", "file"], "left")
    return out.withColumn("malware_type", F.coalesce("_type", F.lit(""))).drop("file", "_type")
