"""A corpus from raw documents: stages that each read what the one before has written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from loanloom.llm import bpe, decontaminate, exact_dedup, language, simhash
from loanloom.llm.catalog import VOCABULARY
from loanloom.llm.common import table
from loanloom.session import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go."""
    return language.keep_known(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def distinct_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the smallest doc_id stays."""
    return simhash.keep_one(docs, width=3, max_bits=3)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark passage go."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, as counts and digests, and the digest of what they decode to."""
    return bpe.digests(docs, VOCABULARY)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("simhash_near_dedup", distinct_fingerprints),
    ("decontamination", uncontaminated),
    ("byte_bpe", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written before the next."""

    def step(docs: DataFrame, stage) -> DataFrame:
        name, apply = stage
        return materialize(apply(spark, docs, sf_dir), f"stage-{name}")

    *first, (_, last) = STAGES
    return last(spark, reduce(step, first, table(spark, sf_dir, "documents")), sf_dir)
