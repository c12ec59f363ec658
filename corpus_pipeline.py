"""From raw documents to token ids: quality rules, line dedup, near-dedup, source mixing, BPE encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lanternfish.llm import bpe, line_dedup, mixing, near_dedup, quality_rules
from lanternfish.llm.common import table
from lanternfish.session import cut_lineage

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that any quality rule rejects go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Repeated line chunks go from all documents but the first that has them."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_one(docs)


def sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every row, and digests of them and of the text they decode to."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("source_mixing", sources),
    ("bpe", tokens),
]

#: The near-duplicate and encoding stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
