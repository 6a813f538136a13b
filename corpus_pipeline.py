"""A corpus from raw documents to sampled segmentations, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept, written as Parquet and read again.
All but the last give the columns of documents.

Edge cases: an empty table gives an empty one. A null or empty text has no language, so its row goes in the first stage.
A null id, source or lang is kept and counts as a value of its own; rows of one id and one text are near copies, of which
one stays. Other columns are carried whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commitlens.llm import jaccard, langid, mixing, sampling, secrets
from commitlens.llm.frames import documents, written

#: Words of a shingle and least similarity, in percent, of the near copies that go.
WIDTH, PERCENT = 5, 80
#: The share of tokens that the mixing stage keeps.
MIX_BUDGET = 0.9


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that can be told go: null, empty and letterless texts, and those below the least score."""
    return langid.identified(docs, langid.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id; texts without words are no copies of each other."""
    return jaccard.deduplicated(docs, width=WIDTH, percent=PERCENT)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark and n_chars is counted anew; every row stays, a null text null."""
    return secrets.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled with the chances that flatten the source, language and topic marginals; repeated ids are all taken or none."""
    return mixing.sampled(docs, budget=MIX_BUDGET)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document; an empty text has one, without pieces."""
    return sampling.encode(docs)


STAGES = [("language ID", known_language), ("n-gram Jaccard join", one_of_each), ("secret scans", without_secrets), ("mixing sources to target weights", mixed), ("SentencePiece encoding and decoding", segmented)]

#: The stages' models and searches are beyond SQL. The tests hold each operator against a brute-force version or a round
#: trip, and what every stage keeps against its operator's own rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
