"""A corpus pipeline made of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last return
the columns of documents, with only the rows that the stage keeps. Columns beyond those
of documents stay as they are, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracklore.llm import bpe, langid, mixing, quality, simhash
from tracklore.llm.common import staged, table

#: Powers that flatten the shares of sources, languages and topics, and the part of the tokens that is kept.
MIX, BUDGET = {"source": 0.7, "lang": 0.7, "topic": 0.7}, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those that are beyond every language's entropy limit.

    Null and empty texts have no letters and go. Rows with null or repeated ids are judged
    like others; null languages and ids are never learned from. Without a known language
    all rows go, as nothing can be told. Ties go to the first language in order.
    """
    return langid.languages(docs, keep=docs.columns).where("accepted").select("kept.*")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the quality classifier holds for bad.

    A score of 0.5 stays, so that without labels nothing goes; null and empty texts get
    the score of an average without words. Rows with null or repeated ids are judged by
    their texts like others.
    """
    return quality.quality_scores(docs, table(spark, sf_dir, "labels"), keep=docs.columns).where("predicted = 1").select("kept.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of exact and near copies.

    The first has the smallest id, nulls last; of rows with equal id and text one stays.
    Null and empty texts are copies of one another.
    """
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics meet their targets.

    Null sources and languages are a value like others; null and empty texts have no
    tokens and go. Rows with equal ids are sampled together, null ids like one id.
    """
    return mixing.mixed(docs, MIX, BUDGET, keep=docs.columns).select("kept.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded text, per document.

    Null and empty texts have no tokens; every row stays, whatever its id.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(docs, path, public_tokenizers.PATTERN), path)


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", filter_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: Trained models and an approximate search can't be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, applied to documents; each one's rows are staged, as the next reads them several times."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
