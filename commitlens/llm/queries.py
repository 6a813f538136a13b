"""Queries of the training-data operators, one for each, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import fertility, jaccard, langid, lm, media, mixing, quality, sampling, secrets, warc
from .frames import documents

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:  # no SQL, no entry
            ORACLES[name] = sql
        return fn

    return put


@query("op1_quality")
def op1(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op2_sampling")
def op2(spark, sf_dir):
    return sampling.encode(documents(spark, sf_dir))


@query("op3_secrets")
def op3(spark, sf_dir):
    return secrets.scan(documents(spark, sf_dir))


@query("op4_langid")
def op4(spark, sf_dir):
    return langid.predict(documents(spark, sf_dir))


@query("op5_jaccard")
def op5(spark, sf_dir):
    return jaccard.linked(documents(spark, sf_dir))


@query("op6_media")
def op6(spark, sf_dir):
    return media.text_media(documents(spark, sf_dir))


@query("op7_fertility")
def op7(spark, sf_dir):
    return fertility.rules(documents(spark, sf_dir))


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT hex, max(page_id) AS most, count(*) AS n FROM p GROUP BY hex),
g AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(hex, 5 * i + 1, 5))::BIGINT >> (15 - 5 * j)) & 31) + 1 AS INTEGER), 1), '' ORDER BY i, j) AS digest
      FROM m, range(8) a(i), range(4) b(j) GROUP BY hex)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, g.digest AS payload_digest,
       CASE WHEN m.n > 1 AND p.page_id < m.most THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.n > 1 AND p.page_id < m.most THEN m.most END AS refers_to
FROM p JOIN m USING (hex) JOIN g USING (hex)
"""


@query("op8_warc", _WARC_SQL)
def op8(spark, sf_dir):
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op9_lm")
def op9(spark, sf_dir):
    return lm.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op10_mixing", mixing.oracle())
def op10(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
