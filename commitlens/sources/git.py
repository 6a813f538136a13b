"""Git histories as Python data sources: format commitlens_git with option `what`.

Options: repos (paths joined by line ends), what (log, refs, diff, files), first_parent, merges (whether merges and first
commits tell their files, as they do unless it is false), revision, base, commit. One
partition reads one repository; no work tree is touched, as all reads name a hash.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMAS = {
    "log": "repo string, ord int, hash string, parent_hash string, path string",
    "refs": "repo string, name string, tip string",
    "diff": "repo string, base string, commit string, diff string",
    "files": "repo string, commit string, path string, content string",
}


def git(repo: str, *args: str, text: str | None = None) -> str:
    out = subprocess.run(["git", "-c", "core.quotepath=false", "-C", repo, *args], input=text, capture_output=True, text=True, errors="replace", check=False)
    if out.returncode:
        raise ValueError(f"git {args[0]} failed in {repo}: {out.stderr[:300]}")
    return out.stdout


class _Repo(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.o = dict(options)

    def partitions(self):
        return [_Repo(p) for p in self.o["repos"].split("\n") if p.strip()]

    def read(self, part):
        repo, what = part.path, self.o.get("what", "log")
        first = ["--first-parent"] if self.o.get("first_parent", "true").lower() == "true" else []
        if what == "refs":
            for line in git(repo, "for-each-ref", "--format=%(refname:short)\t%(objectname)", "refs/heads").splitlines():
                yield (repo, *line.split("\t"))
        elif what == "log":
            log = [x.split(" ") for x in git(repo, "log", "--reverse", *first, "--format=%H %P", self.o.get("revision", "HEAD")).splitlines()]
            order, parent = {h[0]: i for i, h in enumerate(log)}, {h[0]: (h[1] if len(h) > 1 and h[1] else None) for h in log}
            # one process for all commits; a merge is told against each parent, and its headers are folded into one commit
            now, seen = None, set()
            expand = ["--root", "-m"] if self.o.get("merges", "true").lower() == "true" else []
            for line in git(repo, "diff-tree", "--stdin", *expand, "-r", "--name-only", "--no-renames", text="\n".join(order) + "\n").splitlines():
                if line.split(" ")[0] in order:
                    now = line.split(" ")[0]
                elif now and (now, line) not in seen:
                    seen.add((now, line))
                    yield (repo, order[now], now, parent[now], line)
            for h in order.keys() - {c for c, _ in seen}:
                yield (repo, order[h], h, parent[h], None)
        elif what == "diff":
            base, commit = self.o.get("base", ""), self.o["commit"]
            yield (repo, base, commit, git(repo, "diff", base, commit, "--unified=0", "--no-renames") if base else "")
        elif what == "files":
            commit = self.o.get("commit", "HEAD")
            for path in git(repo, "ls-tree", "-r", "--name-only", commit).splitlines():
                if path.endswith((".py", ".pyw")):
                    yield (repo, commit, path, git(repo, "show", f"{commit}:{path}"))


class GitSource(DataSource):
    @classmethod
    def name(cls):
        return "commitlens_git"

    def schema(self):
        return _SCHEMAS[self.options.get("what", "log")]

    def reader(self, schema):
        return _Reader(self.options)


def _load(spark: SparkSession, repos: list[str], what: str, **options) -> DataFrame:
    spark.dataSource.register(GitSource)
    r = spark.read.format("commitlens_git").option("repos", "\n".join(repos)).option("what", what)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def commits(spark: SparkSession, repos: list[str], first_parent: bool = True, revision: str = "HEAD", most: int | None = None, merges: bool = True) -> DataFrame:
    """repo, ord, hash, parent_hash, is_useful (touches a Python file), base_hash: the useful commit before. Histories with more than `most` useful commits are left out.

    With neither first_parent nor merges the log is read in its older form: all commits of the revision, where merges and
    the first commit touch no file.
    """
    from pyspark.sql import Window

    log = _load(spark, repos, "log", first_parent=str(first_parent).lower(), merges=str(merges).lower(), revision=revision)
    rows = log.groupBy("repo", "ord", "hash", "parent_hash").agg(F.coalesce(F.bool_or(F.lower("path").endswith(".py")), F.lit(False)).alias("is_useful"))
    w = Window.partitionBy("repo").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("base_hash", F.last(F.when(F.col("is_useful"), F.col("hash")), ignorenulls=True).over(w))
    if most is None:
        return rows
    return rows.join(rows.groupBy("repo").agg(F.count_if("is_useful").alias("_n")).where(F.col("_n") <= most).select("repo"), "repo", "left_semi")


def branches(spark: SparkSession, repos: list[str]) -> DataFrame:
    """repo, tip, branch, names: one row per distinct tip, named main, else master, else the first name."""
    refs = _load(spark, repos, "refs")
    rank = F.when(F.col("name") == "main", 0).when(F.col("name") == "master", 1).otherwise(2)
    return refs.groupBy("repo", "tip").agg(F.min_by("name", F.struct(rank, "name")).alias("branch"), F.array_sort(F.collect_list("name")).alias("names"))


def diff(spark: SparkSession, repo: str, base: str, commit: str) -> DataFrame:
    return _load(spark, [repo], "diff", base=base, commit=commit)


def snapshot(spark: SparkSession, repos: list[str], commit: str = "HEAD") -> DataFrame:
    """The Python files of a commit."""
    return _load(spark, repos, "files", commit=commit)
