"""The corpus pipeline: five stages, each applied to all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, whatever
these are called. docs has doc_id, text, lang and source. An empty table gives an empty table at every stage; very long texts are
read whole; repeated rows are treated alike, and near-duplicates keep one of them. What a stage does with nulls is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylva.llm import common, decontaminate, mixing, neardup, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language go.

    Null, empty and wordless texts have fewer than 20 words and go. A null lang is a language of its own.
    """
    return quality.good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Null, empty and wordless texts are like nothing and stay, as do rows of a null doc_id. Of rows with one doc_id one stays.
    """
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go: eight words or more are within its windows.

    Null texts hold none and stay; null items have no windows; an item's windows count whether or not it has an id.
    """
    return decontaminate.remove_documents(docs, common.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark. A null text stays null."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix takes words, with size, source_size, target and taken in place of columns of these
    names. Null and empty texts have no words to take and go. Null sources are one source. Of equal keys (repeated rows)
    the smaller doc_id and size comes first."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("source_mix", source_mix)]

#: The divergence rules, MinHash components and the forest are not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, common.written(docs, name) if k else docs, sf_dir)
    return docs
