"""The registered queries of the corpus operators, and SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, mixing, neardup, pii, quality, secrets, suffix, tokens, urls
from .common import table
from .oracles import oracle_sql

#: The setting of the session that has op5's key. Without it the query takes a key that is no secret, fit for made-up data alone.
KEY_SETTING, TEST_KEY = "spark.sylva.pseudonym.key", "not a secret"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.deduplicate(table(spark, sf_dir, "documents"), with_kept=False)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan(docs, table(spark, sf_dir, "benchmark")), ["doc_id"])


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, None) or TEST_KEY
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return done.select("doc_id", "text", "n_pii", *[f"n_{k}" for k in pii.KINDS])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("findings")
    secret = F.transform(F.filter(f, lambda x: x["secret"]), lambda x: x["match"])
    done = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.size(f).cast("long").alias("n_candidates"), F.size(secret).cast("long").alias("n_secrets"), secret.alias("secrets"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", "over_limit")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), columns=("doc_id",))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.clusters(table(spark, sf_dir, "documents"))


__all__ = ["oracle_sql", "queries"]
OPERATORS = (op1_substring_dedup, op2_decontaminate, op3_url_filter, op4_html_text, op5_pii_pseudonyms, op6_secret_scan, op7_token_counts,
    op8_quality_rules, op9_source_mix, op10_near_dedup)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}

