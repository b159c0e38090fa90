"""Rule-based labelling: rules are data, compiled to CASE expressions that stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, digest_divisible_by_6, digest_mod3, text_of, u_strip

#: (label, words any of which gives it), in order of priority.
Rules = list[tuple[str, list[str]]]


def first_match(text: str | Column, rules: Rules, default: str) -> Column:
    """The label of the first rule with a word in the text."""
    out = None
    for label, words in rules:
        hit = contains_any(text, words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


def all_matches(text: str | Column, rules: Rules) -> Column:
    """Array of the labels of all rules that match, in order."""
    hits = F.array(*[F.when(contains_any(text, words), F.lit(label)) for label, words in rules]) if rules else F.array().cast("array<string>")
    return F.filter(hits, lambda x: x.isNotNull())


def rules_from_table(rows: Iterable[tuple[int, str, str]]) -> Rules:
    """(rule_no, word, label) rows as rules, in order of rule_no."""
    out: dict[tuple[int, str], list[str]] = {}
    for no, word, label in sorted(rows):
        out.setdefault((no, label), []).append(word)
    return [(label, words) for (_, label), words in sorted(out.items())]


def with_labels(units: DataFrame, topics: Rules, mechanisms: Rules, source: str = "rules", text: str = "unit_text") -> DataFrame:
    """units with surface_topic, mechanism_label and label_source: two axes, labelled apart."""
    low = F.lower(text_of(text))
    return units.withColumn("surface_topic", first_match(low, topics, "other_uncertain")).withColumn("mechanism_label", first_match(low, mechanisms, "uncertain")).withColumn("label_source", F.lit(source))


#: Providers of labels by name, made from topic and mechanism rules: units to labelled units. Services that label over a network register here.
PROVIDERS: dict[str, Callable[[Rules, Rules], Callable[[DataFrame], DataFrame]]] = {"rules": lambda topics, mechanisms: partial(with_labels, topics=topics, mechanisms=mechanisms)}


def provider(name: str, topics: Rules, mechanisms: Rules) -> Callable[[DataFrame], DataFrame]:
    if name not in PROVIDERS:
        raise ValueError(f"no label provider {name!r}; there are {sorted(PROVIDERS)}")
    return PROVIDERS[name](topics, mechanisms)


def named(key: str | Column, names: dict[str, str]) -> Column:
    """The name of a key, or the key itself where there is none."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key), key) if names else key


RATERS = ["a", "b", "c"]


def rater_reviews(items: DataFrame, topics: Rules, mechanisms: Rules, run_id: str = "rules", item: str = "blinded_item_id", text: str = "text", short: int = 12) -> DataFrame:
    """Three deterministic raters' reviews of each item, three rows an item.

    b takes the first mechanism that matches. a abstains if the text is short, nothing matches, or a digest of rater, item and text is
    divisible by six. c takes the second match, if there is one, when the digest is divisible by three.
    """
    rows = items.select(F.col(item).alias("blinded_item_id"), text_of(text).alias("evidence_text"))
    rows = rows.withColumn("_hits", all_matches(F.lower("evidence_text"), mechanisms)).withColumn("_topic", first_match(F.lower("evidence_text"), topics, "other_uncertain"))
    rows = rows.withColumn("_brief", F.length(u_strip("evidence_text")) < short)  # once an item, before there are three rows of it
    rows = rows.withColumn("reviewer_id", F.explode(F.array(*map(F.lit, RATERS))))
    rows = rows.withColumn("_digest", F.sha2(F.concat("reviewer_id", F.col("blinded_item_id").cast("string"), "evidence_text"), 256))
    brief = F.col("_brief")
    base = F.coalesce(F.get("_hits", F.lit(0)), F.lit("uncertain"))
    label = (
        F.when(F.col("reviewer_id") == "a", F.when(brief | digest_divisible_by_6(F.col("_digest")), "uncertain").otherwise(base))
        .when((F.col("reviewer_id") == "c") & (F.size("_hits") > 1) & (digest_mod3(F.col("_digest")) == 0), F.get("_hits", F.lit(1)))
        .otherwise(base)
    )
    rows = rows.withColumn("mechanism_label", label)
    unsure = F.col("mechanism_label") == "uncertain"
    return rows.select(
        F.lit(run_id).alias("run_id"),
        "reviewer_id",
        "blinded_item_id",
        "evidence_text",
        "mechanism_label",
        F.when(unsure, "other_uncertain").otherwise(F.col("_topic")).alias("surface_topic"),
        F.when(unsure & brief, "needs_parent_context").otherwise("complete").alias("boundary_status"),
        F.when(unsure, F.when(brief, "insufficient_context").otherwise("multiple_mechanisms")).otherwise("none").alias("abstain_reason"),
        F.when(unsure, "low").when(F.size("_hits") == 1, "high").otherwise("medium").alias("confidence_band"),
        F.substring("evidence_text", 1, 12).alias("evidence_phrase"),
    )
