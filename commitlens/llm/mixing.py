"""Mixing sources to target weights, all in DataFrame and SQL functions.

Iterative proportional fitting rakes the tokens of every (source, language, topic) cell until their sums match the
target marginals of all three; a cell's factor over its own tokens, scaled so that the expected tokens meet a budget and
cut at 1, is the chance with which each of its documents is taken. A document's draw is a hash of its id.

The raked weights of a cell are its tokens times a factor per source, one per language and one per topic. Cells are
dealt by source, so that each round of fitting is one pass over them, and what goes between rounds is a row for each
(language, topic). The budget's scale is found by passes that try many scales at once. No value is pooled or left out.

Edge cases: a null source or language counts as "(none)"; a null or empty text has no tokens, and a cell without
tokens keeps factor 1; repeated rows (same id) are all taken or none; a null id is drawn by its text; an empty table
gives no rows; columns beyond those named are ignored, and sampled() carries all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut

WORDS = r"[^\x20\x09-\x0D]+"
#: A marginal's targets are its shares to this power: 1 leaves it, 0 makes it even.
FLATTEN = 0.7
ROUNDS = 20
#: Rounds in one plan, scales tried in one pass, and passes.
TOGETHER, SCALES, PASSES = 4, 64, 10
BUDGET = 0.5
#: Topics stand for the length class of a document where the table has none of its own.
TOPICS = "CASE WHEN n_tokens < 100 THEN 'brief' WHEN n_tokens < 1000 THEN 'article' ELSE 'treatise' END"


DIMS = ["_source", "_lang", "_topic"]


def prepared(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """_row, a struct of docs' columns, with _source, _lang, _topic, _tokens and _u, the draw."""
    text = F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    df = df.withColumn("_tokens", F.regexp_count(text, F.lit(WORDS)).cast("long"))
    own = F.expr((topic or TOPICS).replace("n_tokens", "_tokens"))
    key = F.coalesce(F.col("_row.doc_id").cast("string"), F.md5(text.cast("binary")))
    u = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), key).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    none = F.lit("(none)")
    return df.withColumns({"_source": F.coalesce(F.col("_row.source").cast("string"), none), "_lang": F.coalesce(F.col("_row.lang").cast("string"), none), "_topic": F.coalesce(own, none), "_u": u})


def _targets(cells: DataFrame, dim: str, flatten: float, named: dict[str, float] | None) -> DataFrame:
    """dim and its target in tokens (_want): named shares, or the marginal's own, flattened."""
    total = cells.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("_total"))
    sums = cells.groupBy(dim).agg(F.sum("w").alias("_sum")).crossJoin(F.broadcast(total))  # one row
    if named is not None:
        shares = F.create_map(*[F.lit(x) for k, v in (named or {"": 0.0}).items() for x in (k, float(v))])
        share = F.coalesce(shares[F.col(dim)], F.lit(0.0))
    else:
        share = F.when(F.col("_sum") > 0, F.pow(F.col("_sum") / F.col("_total"), F.lit(flatten))).otherwise(0.0)
    rows = sums.select(dim, share.alias("_share"), "_total")
    whole = rows.agg(F.sum("_share").alias("_whole"))
    return rows.crossJoin(F.broadcast(whole)).select(dim, F.coalesce(F.try_divide(F.col("_share") * F.col("_total"), F.nullif("_whole", F.lit(0.0))), F.lit(0.0)).alias("_want"))


def _to(weight: Column, dim: str) -> Column:
    """What takes the sum of weight over each value of dim to its target."""
    return F.coalesce(F.try_divide(F.col(f"_want{dim}"), F.nullif(F.sum(weight).over(Window.partitionBy(dim)), F.lit(0.0))), F.lit(0.0))


def fit(cells: DataFrame, flatten: float = FLATTEN, rounds: int = ROUNDS, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """_source, _lang, _topic, _factor and _p (the chance) of every cell (columns w and the three).

    targets: per dimension, shares by value (values left out: 0); a dimension left out is flattened.
    """
    want = {d: cut(_targets(cells, d, flatten, (targets or {}).get(d[1:]))).withColumnRenamed("_want", f"_want{d}") for d in DIMS}
    own = cut(cells.join(want["_source"], "_source").repartition("_source"))
    pair = ["_lang", "_topic", "_want_lang", "_want_topic"]
    between = cut(cells.select("_lang", "_topic").distinct().join(want["_lang"], "_lang").join(want["_topic"], "_topic").withColumn("_by", F.lit(1.0)))
    for k in range(max(1, rounds)):
        # the source's factor from what the others are now, then the languages' and the topics' from the sums over sources
        sourced = own.join(between, ["_lang", "_topic"]).withColumn("_v", F.col("w") * _to(F.col("w") * F.col("_by"), "_source"))
        if k == max(1, rounds) - 1:
            sourced = cut(sourced)
        # a row for each language and topic: few enough for one task
        sums = sourced.groupBy(*pair, "_by").agg(F.sum("_v").alias("_m")).coalesce(1)
        sums = sums.withColumn("_by", F.col("_by") * _to(F.col("_m") * F.col("_by"), "_lang"))
        between = sums.select(*pair, (F.col("_by") * _to(F.col("_m") * F.col("_by"), "_topic")).alias("_by"))
        if (k + 1) % TOGETHER == 0 or k == max(1, rounds) - 1:
            between = cut(between)
    raked = sourced.select(*DIMS, "w", "_v").join(between.select("_lang", "_topic", "_by"), ["_lang", "_topic"])
    raked = cut(raked.select(*DIMS, "w", F.when(F.col("w") > 0, F.col("_v") * F.col("_by") / F.col("w")).otherwise(1.0).alias("_factor")))
    return raked.crossJoin(F.broadcast(_scale(raked, budget))).select(*DIMS, "_factor", F.least(F.lit(1.0), F.col("_factor") * F.col("_scale")).alias("_p"))


def _scale(raked: DataFrame, budget: float) -> DataFrame:
    """One row: the least _scale of the factors with which the expected tokens meet the budget."""
    most = F.max(F.when(F.col("_factor") > 0, 1 / F.col("_factor")))
    at = raked.agg(F.lit(0.0).alias("lo"), F.coalesce(most, F.lit(0.0)).alias("hi"), F.coalesce(F.sum("w") * budget, F.lit(0.0)).alias("goal"))
    for k in range(PASSES):
        tried = at.withColumn("x", F.explode(F.transform(F.sequence(F.lit(1), F.lit(SCALES)), lambda j: F.col("lo") + (F.col("hi") - F.col("lo")) * (j / F.lit(float(SCALES))))))
        got = raked.select("w", "_factor").crossJoin(F.broadcast(tried)).groupBy("lo", "hi", "goal", "x").agg(F.sum(F.col("w") * F.least(F.lit(1.0), F.col("_factor") * F.col("x"))).alias("g"))
        low, high = F.max(F.when(F.col("g") < F.col("goal"), F.col("x"))), F.min(F.when(F.col("g") >= F.col("goal"), F.col("x")))
        at = got.groupBy("lo", "hi", "goal").agg(low.alias("_low"), high.alias("_high")).select(F.coalesce("_low", "lo").alias("lo"), F.coalesce("_high", "hi").alias("hi"), "goal")
        if (k + 1) % 5 == 0:
            at = cut(at)
    return at.select(F.col("hi").alias("_scale"))


def weighed(docs: DataFrame, topic: str | None = None, **how) -> DataFrame:
    """_row with _source, _lang, _topic, _tokens, _factor, _p (the chance) and _taken."""
    df = prepared(docs, topic)
    cells = cut(df.groupBy(*DIMS).agg(F.sum("_tokens").cast("double").alias("w")))
    # sent out whole where it is small by the session's own bound, else joined by shuffles
    return df.join(cut(fit(cells, **how)), DIMS).withColumn("_taken", F.col("_u") < F.col("_p"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, the dimensions, n_tokens, weight, probability and selected of every row."""
    return weighed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang"), **how).select(
        "_row.doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_factor", 6).alias("weight"), F.round("_p", 6).alias("probability"), F.col("_taken").alias("selected")
    )


def sampled(docs: DataFrame, **how) -> DataFrame:
    """The rows taken, with docs' columns."""
    return weighed(docs, **how).where("_taken").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def oracle(flatten: float = FLATTEN, rounds: int = ROUNDS, budget: float = BUDGET) -> str:
    """DuckDB SQL of mix()'s rows."""
    sql = [f"""WITH d0 AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS n_tokens,
  CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13))::BIGINT AS DOUBLE) / {float(16**13)} AS u FROM documents),
d AS (SELECT *, {TOPICS} AS topic FROM d0),
c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS w, CAST(sum(n_tokens) AS DOUBLE) AS x FROM d GROUP BY ALL),
tot AS (SELECT sum(w) AS total FROM c0)"""]  # fmt: skip
    for k in ("source", "lang", "topic"):
        sql.append(f"r_{k} AS (SELECT {k}, CASE WHEN sum(w) > 0 THEN pow(sum(w) / (SELECT total FROM tot), {flatten}) ELSE 0 END AS r FROM c0 GROUP BY {k})")
        sql.append(f"t_{k} AS MATERIALIZED (SELECT {k}, r / (SELECT sum(r) FROM r_{k}) * (SELECT total FROM tot) AS want FROM r_{k})")
    n = 0
    for _ in range(rounds):
        for k in ("source", "lang", "topic"):
            sql.append(f"c{n + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.w, CASE WHEN sum(c.x) OVER (PARTITION BY c.{k}) = 0 THEN 0 ELSE c.x * want / sum(c.x) OVER (PARTITION BY c.{k}) END AS x FROM c{n} c JOIN t_{k} USING ({k}))")
            n += 1
    sql.append(f"f AS MATERIALIZED (SELECT source, lang, topic, w, CASE WHEN w > 0 THEN x / w ELSE 1 END AS f FROM c{n})")
    # expected tokens grow piecewise linearly in the scale: between the cells' own limits it is solved exactly
    sql.append(f"""o AS (SELECT 1 / f AS cap, (SELECT sum(w * least(1, g.f / h.f)) FROM f g) AS got, (SELECT sum(w) FROM f g WHERE g.f >= h.f) AS full_w, (SELECT coalesce(sum(w * g.f), 0) FROM f g WHERE g.f < h.f) AS rest FROM f h WHERE f > 0),
s AS (SELECT ({budget} * (SELECT total FROM tot) - coalesce((SELECT max(full_w) FROM o WHERE got <= {budget} * (SELECT total FROM tot)), 0)) / (CASE WHEN EXISTS (SELECT 1 FROM o WHERE got <= {budget} * (SELECT total FROM tot)) THEN (SELECT min(rest) FROM o WHERE got <= {budget} * (SELECT total FROM tot)) ELSE (SELECT sum(w * f) FROM f) END) AS scale)
SELECT doc_id, source, lang, topic, n_tokens, round(f.f, 6) AS weight, round(least(1, f.f * scale), 6) AS probability, u < least(1, f.f * scale) AS selected
FROM d JOIN f USING (source, lang, topic), s""")  # fmt: skip
    return ",\n".join(sql)
