"""A corpus pipeline: stages over ``documents``, each written as Parquet before the next.

Each stage works on what the one before kept, and all but the last return the columns of
``documents``. Null and empty texts have no language and go in the first stage; a repeated
row is a near duplicate of itself and stays as often as it came with the kept id; an empty
table stays empty; columns beyond those of ``documents`` are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsieve.llm import bpe, jaccard, langid, mixing, pii
from seqsieve.llm.common import documents, written

#: Least posterior probability of the language a document is kept for.
LEAST_SCORE = 0.5
RANKS = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have letters and are clearly in one of the languages learned."""
    found = langid.language(docs, langid.learn(docs))
    judged = docs.withColumn("_language", found)
    keep = (F.col("_language.lang_pred") != langid.UNKNOWN) & (F.col("_language.score") >= LEAST_SCORE)
    return judged.where(keep).drop("_language")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose word 5-grams are similar by 0.8 or more."""
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and terms that give it away."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target share of the words asks for."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, checked by decoding: n_tokens and digests of ids and decoded bytes."""
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("byte_bpe", tokenize),
]
#: Byte-level BPE and the language model have no SQL counterpart; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents`` of ``sf_dir``; returns what the last one makes."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
