"""A training corpus from raw documents, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import bpe, langid, minhash, mixing, quality
from shelfline.llm.common import table
from shelfline.llm.queries import PATTERN, RANKS, domain, mix_weights
from shelfline.session import cut

#: Share of the tokens left that the mix takes, each document at most once.
SHARE, SEED = 0.9, 17


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a missing lang is filled in."""
    return langid.accepted(docs, F.col("lang").isNotNull())


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.passed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weights of domains, languages and sources let in."""
    choice = mixing.chosen(docs, mix_weights(), SHARE, 1, SEED, domain=domain())
    return mixing.drawn(docs, choice, domain=domain())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and their number."""
    found = bpe.encoded(docs.select("doc_id", "lang", "source", "text"), RANKS, PATTERN)
    return found.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("language", language),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("tokens", tokens),
]

#: The stages learn from texts and hash them, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
