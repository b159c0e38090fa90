"""The queries opN_<name> and their SQL, one of each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import round_trip
from .common import documents
from .exact_dedup import exact_groups
from .language_id import languages
from .license_scan import license_scan, license_sql
from .lm_score import lm_scores
from .mixing import mixed_rates
from .near_dedup import near_components
from .quality_rules import quality_rules
from .rule_ensemble import quality_scores
from .toxicity import toxicity


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains are the languages that documents.lang names, told from the text; all get the same target weight."""
    docs = documents(spark, sf_dir)
    return mixed_rates(docs, docs.select("doc_id", F.col("lang").alias("domain")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


SQL_OP7 = r"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_mixing": op3_mixing,
        "op4_license_scan": op4_license_scan,
        "op5_language_id": op5_language_id,
        "op6_quality_rules": op6_quality_rules,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_lm_score": op8_lm_score,
        "op9_near_dedup": op9_near_dedup,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": license_sql(), "op7_exact_dedup": SQL_OP7}
