"""Source text columns: signatures, likeness, names and lines."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def signature(c) -> Column:
    """Lines trimmed, inner white space as one space, blank lines left out."""
    lines = F.split(F.coalesce(_c(c), F.lit("")), r"\R")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"\s+", " ")), lambda x: x != ""), "\n")


@F.pandas_udf(StringType())
def snippet(code: pd.Series) -> pd.Series:
    """Line ends unified, dedented, blank edges stripped, one line end after it."""

    def one(s):
        s = textwrap.dedent((s or "").replace("\r\n", "\n").replace("\r", "\n"))
        return s.strip("\n") + "\n" if s.strip() else ""

    return code.map(one)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of a at a time (arbitrary-size integers)."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & at.get(ch, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """200 * LCS / (both lengths); 100 for two empty texts."""
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


def may_be_alike(a, b, least: float = 90.0) -> Column:
    """What lengths alone allow: a filter before indel."""
    n, m = F.length(F.coalesce(_c(a), F.lit(""))), F.length(F.coalesce(_c(b), F.lit("")))
    return (n + m == 0) | (200.0 * F.least(n, m) >= least * (n + m))


def alike(a, b, least: float = 90.0) -> Column:
    return F.when(may_be_alike(a, b, least), indel(_c(a), _c(b)) >= least).otherwise(False)


def expand_tabs(c) -> Column:
    return _expanded(_c(c))


@F.pandas_udf(StringType())
def _expanded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.expandtabs(4))


def top_symbols(c) -> Column:
    """Names of top-level classes and functions."""
    return F.regexp_extract_all(_c(c), F.lit(r"(?m)^(?:class|def|async def)\s+([A-Za-z_]\w*)"), F.lit(1))


def module_candidates(path) -> Column:
    """The names a file is imported by: its base name and its dotted path."""
    stem = F.regexp_replace(_c(path), r"\.[^./]*$", "")
    return F.array_distinct(F.array(F.substring_index(stem, "/", -1), F.replace(stem, F.lit("/"), F.lit("."))))


def one_decimal(c) -> Column:
    """A double from 0 to 2^31 with one decimal, as printf rounds it: by its exact binary value, ties to the even digit. format_string rounds its shortest decimal text, ties up."""
    x = _c(c)
    # 20x as a sum of two doubles, of which the second tells on which side of a tie the first has been rounded
    big, small = 16 * x, 4 * x
    twenty = big + small
    back = twenty - big
    rest = (big - (twenty - back)) + (small - back)
    low = F.floor(twenty / 2)
    over = twenty - 2 * low
    tenths = F.when((over > 1) | ((over == 1) & ((rest > 0) | ((rest == 0) & (low % 2 == 1)))), low + 1).otherwise(low)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def file_token(path) -> Column:
    return F.replace(_c(path), F.lit("/"), F.lit("_"))


def short_hash(c) -> Column:
    return F.left(_c(c), F.lit(5))


def dir_parts(c) -> Column:
    """ord, hash and base of a commit directory's name; null where it has fewer than three parts."""
    p = F.split(_c(c), "_")
    return F.when(F.size(p) >= 3, F.struct(F.get(p, 0).try_cast("int").alias("ord"), F.get(p, 1).alias("hash"), F.get(p, 2).alias("base")))


def slice_file(name, token, new) -> Column:
    return F.concat(F.when(_c(new), "NEW@").otherwise(""), _c(name), F.lit("@"), _c(token), F.lit("_slice.py"))


def slice_name(roots) -> Column:
    """The name of a slice from its roots, structs of name and is_outer."""
    r = _c(roots)
    outer = F.filter(r, lambda x: x["is_outer"])
    return (
        F.when(F.exists(outer, lambda x: x["name"] == "<module>"), "<module>")
        .when(F.size(outer) == 1, F.get(outer, 0)["name"])
        .when(F.size(r) == 1, F.get(r, 0)["name"])
        .otherwise("<file>")
    )


def companions(full_name) -> Column:
    """Names of the nodes that go with a method: its sibling <body> and the __init__ beside it."""
    own = F.regexp_replace(_c(full_name), r"\.[^.]*$", "")
    return F.array(F.concat(own, F.lit(".<body>")), F.concat(own, F.lit(".__init__")))


def source_line(content, n) -> Column:
    """The n-th line, from 1; empty where the file is missing, null beyond its end."""
    return F.when(_c(content).isNull(), "").otherwise(F.try_element_at(F.split(_c(content), "\n"), _c(n)))


def xml_escape(c) -> Column:
    x = _c(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def version_key(c) -> Column:
    """An orderable key of a version: parts between dots and dashes, numbers before text; a trailing _benign does not count."""
    parts = F.split(F.regexp_replace(_c(c), "_benign$", ""), r"[.\-]")
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike("^[0-9]+$"), 0).otherwise(1).alias("kind"), F.when(p.rlike("^[0-9]+$"), p.try_cast("long")).otherwise(0).alias("num"), F.when(p.rlike("^[0-9]+$"), "").otherwise(p).alias("txt")))


def is_source_path(c) -> Column:
    """Python files outside virtual environments and installed packages."""
    x = _c(c)
    return F.lower(x).endswith(".py") & ~x.contains("venv") & ~x.contains("site-packages")
