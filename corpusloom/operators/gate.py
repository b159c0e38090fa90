"""Validation of records, metric thresholds, leak checks, source shift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import int_rate
from ..functions.text import contains_any, text_of, u_strip

#: What a review's fields may hold, as the review format lists them.
BOUNDARIES = ["complete", "needs_parent_context", "over_segmented", "under_segmented", "not_evidence"]
CONFIDENCES = ["high", "medium", "low"]
ABSTENTIONS = ["none", "insufficient_context", "multiple_mechanisms", "unclear_topic", "unclear_boundary", "other"]


def with_problems(reviews: DataFrame, required: list[str], topics: list[str], mechanisms: list[str], optional: list[str] = ("surface_topic", "evidence_phrase")) -> DataFrame:
    """reviews with problems, an array of codes, empty for a valid record. topics and mechanisms are the codebook's."""
    codes = [F.when(text_of(c) == "", F.lit(c)) for c in required if c not in optional]
    for column, allowed in (("mechanism_label", mechanisms), ("boundary_status", BOUNDARIES), ("confidence_band", CONFIDENCES), ("abstain_reason", ABSTENTIONS)):
        codes.append(F.when(~text_of(column).isin(allowed), F.lit(f"{column}:invalid")))
    codes.append(F.when((text_of("surface_topic") != "") & ~text_of("surface_topic").isin(topics), F.lit("surface_topic:invalid")))
    phrase = u_strip("evidence_phrase")
    codes.append(F.when((phrase != "") & ~F.contains(text_of("evidence_text"), phrase), F.lit("evidence_phrase:not_in_text")))
    codes.append(F.when((text_of("mechanism_label") == "uncertain") & (text_of("abstain_reason") == "none"), F.lit("abstain_reason:required_for_uncertain")))
    return reviews.withColumn("problems", F.array_compact(F.array(*codes)))


def threshold_gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, value, level, status): metrics (metric, value) against thresholds (metric, min, max, level). A metric that is missing or null fails closed."""
    rows = thresholds.join(metrics, "metric", "left")
    ok = F.coalesce((F.col("min").isNull() | (F.col("value") >= F.col("min"))) & (F.col("max").isNull() | (F.col("value") <= F.col("max"))), F.lit(False))
    return rows.select("metric", "value", "level", F.when(ok, "PASS").when(F.col("level") == "block", "BLOCKED").otherwise("WARN").alias("status"))


def gate_status(gated: DataFrame) -> DataFrame:
    """One row: checked, blocked, warned, status."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0))
    sums = gated.agg(F.count("*").alias("checked"), n("BLOCKED").alias("blocked"), n("WARN").alias("warned"))
    return sums.withColumn("status", F.when(F.col("blocked") > 0, "BLOCKED").otherwise("PASS"))


def header_leaks(rows: DataFrame, forbidden: list[str]) -> list[str]:
    """Forbidden words in the column names of what raters see."""
    names = ",".join(rows.columns).lower()
    return [w for w in forbidden if w.lower() in names]


def leak_report(rows: DataFrame, text: str, forbidden: list[str], tokens: list[str], result_type: str | None = None, expected: str = "") -> DataFrame:
    """(check, hits): words of `forbidden` in the header, rows whose text names one of `tokens`, and rows whose result type isn't the expected one."""
    named = F.count_if(contains_any(F.lower(text_of(text)), [t.lower() for t in tokens]))
    other = F.count_if(text_of(result_type) != expected) if result_type else F.lit(0).cast("long")
    sums = rows.agg(named.alias("text"), other.alias("result_type")).withColumn("header", F.lit(len(header_leaks(rows, forbidden))).cast("long"))
    pairs = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("hits")) for c in ("header", "text", "result_type")])
    return sums.select(F.explode(pairs).alias("p")).select("p.check", "p.hits")


def text_leaks(rows: DataFrame, text: str, tokens: list[str]) -> DataFrame:
    """Rows of what raters see whose text names a platform."""
    return rows.filter(contains_any(F.lower(text_of(text)), [t.lower() for t in tokens]))


def source_shift(rows: DataFrame, source: str, label: str) -> DataFrame:
    """(source, n, top_label, top_share): how far each label source has collapsed to one label."""
    counts = rows.groupBy(source, label).agg(F.count("*").alias("n"))
    top = counts.groupBy(source).agg(F.sum("n").alias("total"), F.max(F.struct("n", F.col(label).alias("l"))).alias("m"))
    return top.select(source, F.col("total").alias("n"), F.col("m.l").alias("top_label"), int_rate(F.col("m.n"), F.col("total"), 4).alias("top_share"))


def completion(rows: DataFrame, required: list[str]) -> DataFrame:
    """(metric, value): share of rows in which each required column is filled."""
    sums = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum((u_strip(F.col(c).cast("string")) != "").cast("long")), F.lit(0)).alias(f"r{i}") for i, c in enumerate(required)])
    pairs = F.array(*[F.struct(F.lit(f"{c}_completion").alias("metric"), int_rate(F.col(f"r{i}"), F.col("n"), 4, 1.0).alias("value")) for i, c in enumerate(required)])
    return sums.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")
