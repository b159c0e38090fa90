"""Distributions with shares, cross-tabulations, exact rank statistics, breakdowns and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import int_div, int_rate, nearest_rank
from ..functions.text import is_blank, text_of

EMPTY = "(empty)"
UNASSIGNED = ["", "uncertain", "unassigned"]
UNSPECIFIC = ["", "other_uncertain"]


def with_total(counts: DataFrame) -> DataFrame:
    """counts with `total`, the sum of n: a one-row aggregate is broadcast, so rows don't meet in one task."""
    return counts.crossJoin(F.broadcast(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))))


def rated_distribution(rows: DataFrame, column: str, denominator: int | None = None) -> DataFrame:
    """(key, n, total, rate): blanks count as `(empty)`. In order of count, largest first, then key, when sorted by `ranked`."""
    key = F.when(is_blank(F.col(column).cast("string")), F.lit(EMPTY)).otherwise(F.col(column).cast("string"))
    counts = rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    counts = with_total(counts) if denominator is None else counts.withColumn("total", F.lit(denominator).cast("long"))
    return counts.select("key", "n", "total", int_rate(F.col("n"), F.col("total")).alias("rate"))


def ranked(counts: DataFrame, *keys: str) -> DataFrame:
    """The total order of reports: count descending, then keys ascending."""
    return counts.orderBy(F.desc("n"), *keys)


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, total, rate): share of all rows; '' stays a key of its own."""
    counts = with_total(rows.groupBy(text_of(a).alias(a), text_of(b).alias(b)).agg(F.count("*").alias("n")))
    return counts.select(a, b, "n", "total", int_rate(F.col("n"), F.col("total")).alias("rate"))


def assigned(mechanism: str | Column) -> Column:
    return ~text_of(mechanism).isin(*UNASSIGNED)


def specific(topic: str | Column) -> Column:
    return ~text_of(topic).isin(*UNSPECIFIC)


def integer_stats(rows: DataFrame, column: str) -> DataFrame:
    """One row: n, min, median, mean (two digits), p90 (nearest rank), max of an integer column; zeros for no rows.

    Values are counted first; ranks come from the running counts of distinct values, so that no row is sorted.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("v")).agg(F.count("*").alias("k"))
    counts = counts.withColumn("upto", F.sum("k").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    size = counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("v") * F.col("k")), F.lit(0)).alias("s"))
    joined = counts.crossJoin(F.broadcast(size))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    n = F.col("n")
    got = joined.groupBy("n", "s").agg(
        F.min("v").alias("lo"),
        at(int_div(n + 1, F.lit(2))).alias("m1"),
        at(int_div(n + 2, F.lit(2))).alias("m2"),
        at(nearest_rank(n, 0.9)).alias("p90"),
        F.max("v").alias("hi"),
    )
    whole = size.join(got.drop("s"), "n", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return whole.select(
        n,
        zero(F.col("lo")).alias("min"),
        zero((F.col("m1") + F.col("m2")) / F.lit(2.0)).cast("double").alias("median"),
        int_rate(F.col("s"), n, 2).alias("mean"),
        zero(F.col("p90")).alias("p90"),
        zero(F.col("hi")).alias("max"),
    )


def top_per_group(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The k most frequent keys of each group: (group, key, n, rank). Ties by key. Counts are made before the window."""
    counts = rows.groupBy(group, key).agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), key)
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def breakdown(units: DataFrame, parents: DataFrame, group: str, labels: list[str]) -> DataFrame:
    """Per group of the parents: parents, units, units per parent (three digits), and for each label its counts as `key:n` in report order.

    One pass over the units with grouping sets, instead of one for each group and label. Units of groups
    that no parent has don't appear; `stray_units` counts them.
    """
    n_parents = parents.groupBy(text_of(group).alias(group)).agg(F.count("*").alias("samples"))
    named = units.select(text_of(group).alias(group), *[F.when(is_blank(x), F.lit(EMPTY)).otherwise(F.col(x)).alias(x) for x in labels])
    long = named.groupingSets([[F.col(group)], *[[F.col(group), F.col(x)] for x in labels]], group, *labels).agg(F.count("*").alias("n"), F.grouping_id().alias("_gid"))
    whole = (1 << len(labels)) - 1
    parts = []
    for i, x in enumerate(labels):
        mine = long.filter(F.col("_gid") == whole - (1 << (len(labels) - 1 - i)))
        listed = mine.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(x).alias("k")))).alias("a"))
        parts.append(listed.select(group, F.array_join(F.transform("a", lambda s: F.concat(s["k"], F.lit(":"), (-s["m"]).cast("string"))), ",").alias(f"{x}_counts")))
    out = n_parents.join(long.filter(F.col("_gid") == whole).select(group, F.col("n").alias("units")), group, "left").withColumn("units", F.coalesce("units", F.lit(0)))
    for p in parts:
        out = out.join(p, group, "left")
    return out.select(group, "samples", "units", int_rate(F.col("units"), F.col("samples"), 3).alias("units_per_sample"), *[F.coalesce(f"{x}_counts", F.lit("")).alias(f"{x}_counts") for x in labels])


def stray_units(units: DataFrame, parents: DataFrame, group: str) -> DataFrame:
    """Units of groups that no parent has: (group, n)."""
    return units.join(parents.select(group).distinct(), group, "left_anti").groupBy(group).agg(F.count("*").alias("n"))
