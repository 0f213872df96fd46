"""The corpus pipeline: language, quality, near-duplicates, packing. Each stage takes what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankpulse.llm import language, near_dup, quality
from rankpulse.llm.common import stored, table
from rankpulse.llm.queries import pack_documents


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of undetermined or ambiguous language, by a model of the labelled ones.

    Texts that are null, empty or without a letter are undetermined and go; null ids and repeated rows are judged like any; without labelled rows
    all documents are undetermined; an empty table gives none. All columns stay, whatever their names.
    """
    return language.keep_identified(docs, language.train(docs))


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail the base rules or that the weighed rules find bad.

    Texts that are null, empty or of few words fail the base rules; null ids and repeated rows are judged like any; an empty table gives none. All columns stay.
    """
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles and a similarity of 0.8 make.

    The least id stays, a null id last; of rows that repeat an id one stays. Texts that are null or without words are linked with nothing and stay; an empty table gives
    none. All columns stay.
    """
    return near_dup.keep_one(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 ids.

    A null or empty text is the end id alone; null ids and repeated rows are documents of their own; an empty table gives no pieces.
    """
    return pack_documents(docs)


STAGES = [("language", identify_language), ("quality", judge_quality), ("near_dup", drop_near_duplicates), ("packing", pack)]

#: SQL can't express the classifier, the estimated rule rates and the tokenizer; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
