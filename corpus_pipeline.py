"""The corpus pipeline: stages over the table documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe import round_trip
from corpusloom.llm.common import documents, release, rested, saved, written
from corpusloom.llm.exact_dedup import exact_dedup
from corpusloom.llm.mixing import mix_documents
from corpusloom.llm.near_dedup import near_dedup
from corpusloom.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages are the domains; their targets are the square roots of their shares. Every document stays; rarer languages' documents are repeated."""
    return mix_documents(docs, docs.select("doc_id", F.col("lang").alias("domain")), power=0.5, low=1.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's text encoded, and its ids decoded again."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, lean=True)


def after_rest(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun when executors have handed back the heap that the stage before has left free: its Python workers need that memory."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rested(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", after_rest(quality)),
    ("exact_dedup", after_rest(exact)),
    ("near_dedup", after_rest(near)),
    ("mixing", after_rest(mix)),
    ("byte_bpe", after_rest(tokens)),
]

#: Learned rules, rates and recursive encoding aren't SQL over the tables; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's scratch tables, and its input, go when its rows are written."""
    docs, before = documents(spark, sf_dir), written()
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, before, docs)
    return docs
