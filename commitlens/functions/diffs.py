"""Unified diffs: hunks, changed lines and how line numbers move."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
HUNK = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def files(diff) -> Column:
    """One element per file of a diff: its text from its header on."""
    c = F.col(diff) if isinstance(diff, str) else diff
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?m)^diff --git "), lambda x: x.startswith("a/"))


def file_name(part: Column) -> Column:
    return F.regexp_extract(part, r"^a/(.*?) b/(.*)", 2)


def hunks(diffs: DataFrame, keys: list[str], column: str = "diff") -> DataFrame:
    """keys, file, ord, old_start, old_count, new_start, new_count: the hunk headers of each file, counts 1 where left out."""
    parts = diffs.select(*keys, F.explode(files(column)).alias("part")).withColumn("file", file_name(F.col("part")))
    get = lambda g: F.regexp_extract_all("part", F.lit("(?m)^" + HUNK), F.lit(g))
    rows = parts.select(*keys, "file", F.posexplode(F.arrays_zip(get(1).alias("a"), get(2).alias("b"), get(3).alias("c"), get(4).alias("d"))).alias("ord", "h"))
    num = lambda x, y: F.when(F.col(f"h.{x}") == "", 1).otherwise(F.col(f"h.{x}").cast("int")).alias(y)
    return rows.select(*keys, "file", "ord", num("a", "old_start"), num("b", "old_count"), num("c", "new_start"), num("d", "new_count"))


def read_lines(diff: str, marks_hide: bool = True) -> list[tuple[str, str, int, str]]:
    """(file, side, line, text) of each changed line of a diff; a hunk's lines are those that its header counts.

    marks_hide: a changed line whose text itself starts with its mark reads like a file header (+++ or ---), so it is left
    out, and moves the numbers of both sides like a line of context.
    """
    out = []
    for part in re.split(r"(?m)^diff --git ", diff or "")[1:]:
        named = re.match(r"a/(.*?) b/(.*)", part)
        for head in re.finditer("(?m)" + _HUNK.pattern, part) if named else ():
            a, n, b, m = (int(x) if x else 1 for x in head.groups())
            at, left = {"-": a, "+": b}, {"-": n, "+": m}
            for line in part[head.end() :].split("\n")[1:]:
                if not any(left.values()):
                    break
                mark, text = line[:1], line[1:]
                if mark in ("", "\\"):
                    continue
                own = mark if mark in at else "-+"
                hidden = marks_hide and mark in at and text.startswith(mark)
                if len(own) == 1 and not hidden:
                    out.append((named[2], "added" if own == "+" else "deleted", at[own], text))
                for side in own:
                    left[side] -= 1
                for side in "-+" if hidden else own:
                    at[side] += 1
    return out


def changed_lines(diffs: DataFrame, keys: list[str], column: str = "diff") -> DataFrame:
    """keys, file, side, line and text of every changed line."""

    @F.pandas_udf("array<struct<file:string,side:string,line:int,text:string>>")
    def lines(s: pd.Series) -> pd.Series:
        return s.map(lambda d: [{"file": f, "side": k, "line": n, "text": t} for f, k, n, t in read_lines(d)])

    return diffs.select(*keys, F.inline(lines(F.col(column))))


def hunk_lines(hunks: DataFrame) -> DataFrame:
    """hunks' keys with side and line: the lines that the headers alone give."""
    keys = [c for c in hunks.columns if c not in ("ord", "old_start", "old_count", "new_start", "new_count")]
    rows = lambda side, start, n: hunks.where(F.col(n) > 0).select(*keys, F.lit(side).alias("side"), F.explode(F.sequence(F.col(start), F.col(start) + F.col(n) - 1)).alias("line"))
    return rows("added", "new_start", "new_count").unionByName(rows("deleted", "old_start", "old_count"))


def line_pairs(hunks: DataFrame) -> DataFrame:
    """hunks' keys with old and new: deleted lines paired by position with the added ones."""
    keys = [c for c in hunks.columns if c not in ("ord", "old_start", "old_count", "new_start", "new_count")]
    both = hunks.withColumn("_n", F.least("old_count", "new_count")).where("_n > 0")
    return both.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("i"), "old_start", "new_start").select(*keys, (F.col("old_start") + F.col("i")).alias("old"), (F.col("new_start") + F.col("i")).alias("new"))


def shifted(lines: DataFrame, hunks: DataFrame, keys: list[str]) -> DataFrame:
    """lines (keys, line) with new_line: plus what hunks before the line have added and taken.

    One sort per file serves all lines: hunks and lines are laid in one order and the growth is a running sum.
    """
    # a hunk that takes lines counts from its first line on; one that only adds, after its line
    h = hunks.select(*keys, F.col("old_start").alias("_at"), F.when(F.col("old_count") > 0, 0).otherwise(2).alias("_kind"), (F.col("new_count") - F.col("old_count")).alias("_grow"), F.lit(None).cast("struct<" + ",".join(f"`{c}`:{t}" for c, t in lines.dtypes) + ">").alias("_row"))
    own = lines.select(*keys, F.col("line").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_grow"), F.struct(*lines.columns).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = own.unionByName(h).withColumn("_sum", F.sum("_grow").over(w)).where("_kind = 1")
    return out.select("_row.*", (F.col("_at") + F.col("_sum")).cast("int").alias("new_line"))


def shift_through(line: Column, hunks: Column) -> Column:
    """The older mapping, hunk after hunk on the line as moved so far; hunks: an array of structs in order."""
    return F.aggregate(hunks, line, lambda at, h: F.when(at > h["old_start"], at + h["new_count"] - h["old_count"]).otherwise(at))
