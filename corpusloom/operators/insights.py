"""Insights grouped from labelled units, testable hypotheses, and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import int_rate
from .distribution import assigned
from ..functions.text import text_of


def groupable(units: DataFrame) -> DataFrame:
    return units.filter(assigned("mechanism_label") & (text_of("surface_topic") != ""))


def insights(units: DataFrame, platform: str, order: list[str], min_support: int = 2, examples: int = 3) -> DataFrame:
    """One row per (topic, mechanism): insight_id in order of count, evidence_count, platforms, support_level, single_platform, first_ids.

    All ids of an insight are in insight_links; here are the first few, cut before they are gathered.
    """
    rows = groupable(units)
    groups = rows.groupBy("surface_topic", "mechanism_label").agg(F.count("*").alias("evidence_count"), F.array_join(F.array_sort(F.collect_set(platform)), ",").alias("platforms"), F.count_distinct(platform).alias("n_platforms"))
    near = Window.partitionBy("surface_topic", "mechanism_label").orderBy(*order)
    first = rows.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= examples)
    first = first.groupBy("surface_topic", "mechanism_label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "evidence_id"))), lambda s: s["evidence_id"]), ",").alias("first_ids"))
    rank = F.row_number().over(Window.orderBy(F.desc("evidence_count"), "surface_topic", "mechanism_label"))
    out = groups.join(first, ["surface_topic", "mechanism_label"]).withColumn("insight_id", F.format_string("INSIGHT_%03d", rank))
    return out.select(
        "insight_id",
        "surface_topic",
        "mechanism_label",
        "evidence_count",
        "platforms",
        F.when(F.col("evidence_count") >= min_support, "high_support").otherwise("low_support").alias("support_level"),
        (F.col("n_platforms") <= 1).alias("single_platform"),
        "first_ids",
    )


def insight_links(units: DataFrame, found: DataFrame) -> DataFrame:
    """(insight_id, evidence_id) of all units that an insight rests on."""
    keys = found.select("insight_id", "surface_topic", "mechanism_label")
    return groupable(units).join(keys, ["surface_topic", "mechanism_label"]).select("insight_id", "evidence_id")


def actions(found: DataFrame) -> DataFrame:
    """A hypothesis to test for each insight with high support."""
    high = found.filter("support_level = 'high_support'")
    place = F.regexp_extract("insight_id", "([0-9]+)$", 1).cast("long")  # by number: INSIGHT_1000 comes after INSIGHT_999
    number = F.row_number().over(Window.orderBy(place))
    return high.select(
        F.format_string("ACTION_%03d", number).alias("action_id"),
        "insight_id",
        F.concat_ws(" / ", "surface_topic", "mechanism_label").alias("title"),
        F.col("first_ids").alias("source_evidence_ids"),
        F.lit("share of such feedback falls").alias("expected_effect"),
        F.lit("compare shares before and after").alias("validation_method"),
    )


def evaluation(units: DataFrame, located: DataFrame, labels: list[str], found: DataFrame, todo: DataFrame, min_located: float = 0.98) -> DataFrame:
    """One row of six rates, blockers and status. located: match_report of the units. Without units the invalid rate is 1, which blocks."""
    ok = text_of("mechanism_label").isin("", "unassigned", *labels)
    one = units.agg(F.count("*").alias("n"), F.count_distinct("evidence_id").alias("ids"), F.coalesce(F.sum((~ok).cast("long")), F.lit(0)).alias("invalid"))
    links = insight_links(units, found)
    known = links.join(units.select("evidence_id").distinct(), "evidence_id", "left_anti").select("insight_id").distinct()
    resolved = found.join(known, "insight_id", "left_anti").agg(F.count("*").alias("resolved"))
    tied = todo.join(found.select("insight_id"), "insight_id", "left_semi").agg(F.count("*").alias("tied"))
    each = todo.select("action_id", F.explode(F.split("source_evidence_ids", ",")).alias("evidence_id"))
    loose = each.join(units.select("evidence_id").distinct(), "evidence_id", "left_anti").select("action_id").distinct()
    backed = todo.join(loose, "action_id", "left_anti").agg(F.count("*").alias("backed"))
    row = one.crossJoin(located.select("located")).crossJoin(found.agg(F.count("*").alias("n_insights"))).crossJoin(resolved).crossJoin(todo.agg(F.count("*").alias("n_actions"))).crossJoin(tied).crossJoin(backed)
    rate = lambda a, b: int_rate(F.col(a), F.col(b), 4, 1.0)
    rates = row.select(
        "n",
        rate("ids", "n").alias("evidence_id_unique_rate"),
        rate("located", "n").alias("evidence_text_match_rate"),
        rate("invalid", "n").alias("invalid_label_rate"),
        rate("resolved", "n_insights").alias("insight_support_resolution_rate"),
        rate("tied", "n_actions").alias("action_to_insight_linkage_rate"),
        rate("backed", "n_actions").alias("action_to_evidence_linkage_rate"),
    )
    blockers = F.array_compact(
        F.array(
            F.when(F.col("evidence_text_match_rate") < min_located, F.lit("text_match")),
            F.when(F.col("invalid_label_rate") > 0, F.lit("invalid_label")),
            F.when(F.col("insight_support_resolution_rate") < 1, F.lit("unresolved_insight")),
        )
    )
    return rates.withColumn("blockers", F.array_join(blockers, ",")).withColumn("status", F.when(F.size(blockers) > 0, "BLOCKED").otherwise("PASS"))
