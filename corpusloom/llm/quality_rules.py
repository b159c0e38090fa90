"""Quality rules: decision lists learned from labelled statistics, emitted as ordered CASE expressions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learned_rules as L
from .text_stats import FEATURES, with_base, with_features

#: Labelled rows that the list is learned from, at most: those with the smallest xxhash64(doc_id).
FIT_ROWS = 6000
MIN_WORDS = 50


def sample_labels(labels: DataFrame, label: str, most: int = FIT_ROWS) -> DataFrame:
    """(doc_id, label) of at most `most` labelled documents, one row each; rows with a null in either column don't count."""
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> list[L.Rule]:
    """The ordered rules that reject, from labels.quality of a bounded sample of documents that the base rules pass.

    The sample is broadcast (its bound is `most` rows), so only the labelled documents' statistics are computed.
    """
    names = [f for f in FEATURES if f != "n_words"]
    rows = docs.select("doc_id", "text").join(F.broadcast(sample_labels(labels, "quality", most)), "doc_id")
    stats = with_features(with_base(rows, ["doc_id", "_label"]), ["doc_id", "_label"])
    x, y = L.labelled(stats, "_label", [*names, "n_words", "n_repeat_words"])
    passed = (x["n_words"] >= MIN_WORDS) & (100 * x["n_repeat_words"] <= 50 * x["n_words"])
    return L.decision_list({k: x[k][passed] for k in names}, y[passed])


def judged(docs: DataFrame, rules: list[L.Rule], keep: list[str]) -> DataFrame:
    """`keep` and the counts, base_failed, rule_no (of the first rule that rejects, else 0), kept."""
    stats = with_features(with_base(docs, keep), keep)
    no = F.lit(0)
    for i, r in reversed(list(enumerate(rules, 1))):
        no = F.when(L.rule_column(r), F.lit(i)).otherwise(no)
    return stats.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        no.alias("rule_no"),
        F.when(base_failed(), F.lit(False)).otherwise(L.list_column(rules, F.lit(False), F.lit(True))).alias("kept"),
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, rule_no, kept.

    A null or empty text has no words and fails the base rules. Repeated rows and null ids are judged like any other. Without
    labels the list is empty and the base rules decide. Other columns are ignored.
    """
    return judged(docs, learn(docs, labels), ["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns.

    The condition also reads a row number, which the optimizer doesn't move: a filter that it pushed below the arrays of words
    would compute them anew for each word.
    """
    rules = learn(docs, labels)
    named = docs.select(F.col("text"), F.struct(*docs.columns).alias("_row"))
    verdicts = judged(named, rules, ["_row"]).withColumn("_no", F.monotonically_increasing_id())
    return verdicts.filter("kept and _no >= 0").select("_row.*")
