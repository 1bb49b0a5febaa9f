"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes the rows that the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylva.llm import decontaminate, langid, linededup, neardup, packing
from sylva.llm.common import materialize, small_batches
from sylva.llm.queries import table, tokenizer
from sylva.session import ship


def _ready(spark: SparkSession) -> None:
    ship(spark)
    small_batches(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language (null, empty or letterless text)."""
    _ready(spark)
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeats of runs of lines of 50 words or more; documents that lose all their words go."""
    _ready(spark)
    return linededup.dedupe(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, Jaccard 0.8 or more)."""
    _ready(spark)
    return neardup.dedupe(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item (0.8 or more of its five-word shingles)."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokenised documents into sequences of 2048 ids."""
    _ready(spark)
    return packing.pack(docs, tokenizer())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Tokenisation, components and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
