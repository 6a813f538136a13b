"""Pairs of rows whose texts are alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Parts that the texts of one group are dealt to, so that a large group is no single task.
PARTS = 8


def text_pairs(rows: DataFrame, keys: list[str], column: str, least: float = 90.0) -> DataFrame:
    """keys, one, two and ratio: the pairs of different texts of one group whose likeness is `least` or more, each once, one < two.

    The tests before the likeness are exact: a pair within the ratio has lengths that allow it, and no more edits than
    insertions and deletions.
    """
    texts = rows.select(*keys, F.coalesce(column, F.lit("")).alias("one")).distinct()
    dealt = texts.withColumn("_part", F.pmod(F.xxhash64("one"), F.lit(PARTS)).cast("int"))
    others = texts.select(*keys, F.col("one").alias("two"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    both = dealt.join(others, [*keys, "_part"]).where((F.col("one") < F.col("two")) & text.may_be_alike("one", "two", least))
    both = both.where(F.expr(f"levenshtein(one, two, CAST(ceil((length(one) + length(two)) * {100 - least}D / 100) AS INT)) >= 0"))
    # in an array, so that the filter does not ask for the likeness a second time
    return both.select(*keys, "one", "two", F.explode(F.array(text.indel("one", "two"))).alias("ratio")).where(F.col("ratio") >= least)


def row_pairs(rows: DataFrame, keys: list[str], name: str, column: str, least: float = 90.0) -> DataFrame:
    """name, other (the greater) and ratio: the pairs of rows of one group whose texts are alike. Texts are compared once, however many rows have them."""
    own = rows.select(*keys, F.col(name).alias("_id"), F.coalesce(column, F.lit("")).alias("one"))
    same = own.select(*keys, "one").distinct().select(*keys, "one", F.col("one").alias("two"), F.lit(100.0).alias("ratio"))
    pairs = same.unionByName(text_pairs(rows, keys, column, least))
    second = own.select(*keys, F.col("_id").alias("_other"), F.col("one").alias("two"))
    out = pairs.join(own, [*keys, "one"]).join(second, [*keys, "two"])
    # two rows of one text meet twice, those of different texts once
    out = out.where(((F.col("one") != F.col("two")) & (F.col("_id") != F.col("_other"))) | (F.col("_id") < F.col("_other")))
    return out.select(F.least("_id", "_other").alias(name), F.greatest("_id", "_other").alias("other"), "ratio")
