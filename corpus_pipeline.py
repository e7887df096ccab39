"""Corpus preparation: each stage takes the documents that the one before it kept.

The first three stages return the columns of ``documents``; the last returns one row per packed piece. Null,
empty, repeated and clashing rows are treated as each stage's operator says.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from portfolia.llm import minhash, packing, quality, toxicity
from portfolia.llm.common import read, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject."""
    return toxicity.accepted(docs, read(spark, sf_dir, "labels"))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by words in fives and a similarity of 0.8."""
    return minhash.one_of_each(docs, k=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces in sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces_of(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic), ("quality", of_quality), ("minhash_near_dedup", without_near_copies),
    ("best_fit_packing", packed)]

#: Networks, classifiers and packing cannot be said in SQL; the tests hold each stage, and run() on odd rows, against
#: plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
