"""Reconciling three raters: pivot, agreement levels, entropy, kappa, alpha, confusion, transitions, retests, disputed pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import int_rate
from ..functions.text import text_of

RATERS = ["a", "b", "c"]


def latest(reviews: DataFrame, order: str | None = None) -> DataFrame:
    """One review for each rater and item: the last by `order`, if given."""
    if order is None or order not in reviews.columns:
        return reviews
    window = Window.partitionBy("reviewer_id", "blinded_item_id").orderBy(F.desc(order))
    return reviews.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def pivoted(reviews: DataFrame, order: str = "review_order") -> DataFrame:
    """A row per item with mech_a ... bound_c: one aggregation, no pivot job. Items without all three raters don't appear. Of a rater's reviews of
    one item the last by the column `order` counts, if there is one; without it there may be only one review."""
    last = F.col(order) if order in reviews.columns else F.lit(0)
    cols = []
    for r in RATERS:
        mine = F.col("reviewer_id") == r
        whole = F.max_by(F.struct("mechanism_label", "surface_topic", "boundary_status"), F.when(mine, last))
        for short, name in (("mech", "mechanism_label"), ("topic", "surface_topic"), ("bound", "boundary_status")):
            cols.append(whole[name].alias(f"{short}_{r}"))
    rows = reviews.filter(F.col("reviewer_id").isin(RATERS)).groupBy("blinded_item_id").agg(*cols)
    return rows.filter(" and ".join(f"mech_{r} is not null" for r in RATERS))


def level(a: Column, b: Column, c: Column) -> Column:
    return F.when((a == b) & (b == c), "unanimous").when((a == b) | (b == c) | (a == c), "majority").otherwise("disputed")


def majority(a: Column, b: Column, c: Column) -> Column:
    """The label of two raters or more, else ''."""
    return F.when((a == b) | (a == c), a).when(b == c, b).otherwise("")


def entropy3(a: Column, b: Column, c: Column) -> Column:
    """Shannon entropy of three labels in bits, to four digits."""
    kind = level(a, b, c)
    return F.when(kind == "unanimous", 0.0).when(kind == "majority", 0.9183).otherwise(1.585)


def consensus_rows(reviews: DataFrame, key: DataFrame) -> DataFrame:
    """A row per main item. key: blinded_item_id, source_id, is_retest. An item whose boundary is disputed may still have a majority label; all
    but unanimous items are queued for adjudication."""
    rows = pivoted(reviews).join(key.filter("not is_retest").select("blinded_item_id", "source_id"), "blinded_item_id")
    m, t, b = ([F.col(f"{x}_{r}") for r in RATERS] for x in ("mech", "topic", "bound"))
    conflict = F.greatest(*[(x == "not_evidence").cast("int") for x in b]) - F.least(*[(x == "not_evidence").cast("int") for x in b]) == 1
    agreement = F.when(conflict & (level(*m) != "unanimous"), "boundary_disputed").otherwise(level(*m))
    return rows.select(
        "blinded_item_id",
        "source_id",
        *[f"topic_{r}" for r in RATERS],
        *[f"mech_{r}" for r in RATERS],
        majority(*t).alias("consensus_topic"),
        majority(*m).alias("consensus_mechanism"),
        agreement.alias("agreement_level"),
        entropy3(*t).alias("topic_entropy"),
        entropy3(*m).alias("mechanism_entropy"),
        F.when((b[0] == b[1]) & (b[1] == b[2]), "agree").otherwise("disagree").alias("boundary_agreement"),
        (agreement != "unanimous").alias("needs_adjudication"),
    )


def _count(cond: Column | str) -> Column:
    cond = F.expr(cond) if isinstance(cond, str) else cond
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0))


def _long(row: DataFrame, names: list[str], whole: str = "n") -> DataFrame:
    """(metric, numerator, denominator, rate) rows of a one-row frame; the rate is null over nothing."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("numerator")) for m in names])
    rows = row.select(F.explode(pairs).alias("p"), F.col(whole).alias("denominator")).select("p.metric", "p.numerator", "denominator")
    return rows.withColumn("rate", int_rate(F.col("numerator"), F.col("denominator"), 4, None))


def source_of(items: DataFrame, private: DataFrame, public: DataFrame, key: str = "blinded_item_id") -> DataFrame:
    """items with what is known of them: the private row if there is one, else the public row, else '' in every column; whole rows, not single columns."""
    names = [c for c in dict.fromkeys([*private.columns, *public.columns]) if c != key]
    side = lambda rows: F.struct(*[(text_of(F.col(c).cast("string")) if c in rows.columns else F.lit("")).alias(c) for c in names])
    one, two = (rows.select(key, side(rows).alias(name)).dropDuplicates([key]) for rows, name in ((private, "_private"), (public, "_public")))
    got = items.join(one, key, "left").join(two, key, "left").withColumn("_row", F.coalesce("_private", "_public"))
    return got.select(*items.columns, *[F.coalesce(F.col(f"_row.{c}"), F.lit("")).alias(c) for c in names if c not in items.columns])


def source_texts(private: DataFrame, public: DataFrame, source: str = "source_id", text: str = "text", key: str = "blinded_item_id") -> DataFrame:
    """(source, text): from a source's id to its blinded id in the private table, and on to the text in the public one; '' where a hop fails."""
    named = private.filter(text_of(F.col(source).cast("string")) != "").select(source, key)
    return named.join(public.select(key, text), key, "left").groupBy(source).agg(F.max_by(text_of(text), F.col(key)).alias(text))


def agreement_summary(rows: DataFrame) -> DataFrame:
    sums = rows.agg(
        F.count("*").alias("n"),
        _count("agreement_level = 'unanimous'").alias("three_way_agreement"),
        _count("agreement_level in ('unanimous', 'majority')").alias("majority_agreement"),
        _count("agreement_level in ('disputed', 'boundary_disputed')").alias("mechanism_dispute"),
        _count("topic_a <> topic_b or topic_b <> topic_c").alias("topic_dispute"),
        _count("boundary_agreement = 'disagree'").alias("boundary_dispute"),
        _count("needs_adjudication").alias("needs_adjudication"),
    )
    return _long(sums, ["three_way_agreement", "majority_agreement", "mechanism_dispute", "topic_dispute", "boundary_dispute", "needs_adjudication"])


def pairwise_agreement(rows: DataFrame) -> DataFrame:
    sums = rows.agg(F.count("*").alias("n"), *[_count(f"mech_{x} = mech_{y}").alias(f"{x}_{y}") for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])
    return _long(sums, ["a_b", "a_c", "b_c"])


def fleiss_kappa(rows: DataFrame, categories: list[str]) -> DataFrame:
    """One row: n, kappa to four digits; null without items, 1 if all expected agreement is certain. Labels outside the categories don't count."""
    labels = F.array(*[F.col(f"mech_{r}") for r in RATERS])

    def of(c: str) -> Column:
        return F.size(F.filter(labels, lambda x: x == F.lit(c)))

    per = [of(c) for c in categories]
    square = sum((p * p for p in per[1:]), per[0] * per[0])
    sums = rows.agg(F.count("*").alias("n"), F.sum(square - 3).alias("s"), *[F.sum(p).alias(f"k{i}") for i, p in enumerate(per)])
    n = F.col("n")
    observed = F.col("s") / (n * 6.0)
    expected = sum((F.pow(F.col(f"k{i}") / (n * 3.0), F.lit(2.0)) for i in range(1, len(per))), F.pow(F.col("k0") / (n * 3.0), F.lit(2.0)))
    kappa = F.when(n == 0, F.lit(None)).when(F.abs(1 - expected) < 1e-12, F.lit(1.0)).otherwise(F.round((observed - expected) / (1 - expected), 4) + 0.0)
    return sums.select("n", kappa.cast("double").alias("kappa"))


def krippendorff_alpha(reviews: DataFrame) -> DataFrame:
    """One row: n (pairable labels), alpha (nominal) to four digits; items with one label don't count. Any number of raters."""
    counts = reviews.filter("mechanism_label is not null").groupBy("blinded_item_id", "mechanism_label").agg(F.count("*").alias("k"))
    items = counts.groupBy("blinded_item_id").agg(F.sum("k").alias("m"), F.sum(F.col("k") * (F.col("k") - 1)).alias("same")).filter("m > 1")
    pairable = counts.join(items.select("blinded_item_id"), "blinded_item_id")
    total = items.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.sum((F.col("m") * (F.col("m") - 1) - F.col("same")) / (F.col("m") - 1)).alias("differ"))
    labels = pairable.groupBy("mechanism_label").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
    n = F.col("n")
    expected = (n * n - F.col("squares")) / (n - 1)
    alpha = F.when(n < 2, F.lit(None)).when(expected == 0, 1.0).otherwise(F.round(1 - F.col("differ") / expected, 4) + 0.0)
    return total.crossJoin(labels).select("n", alpha.cast("double").alias("alpha"))


def per_label_unanimity(spark_rows: DataFrame, categories: list[str]) -> DataFrame:
    """(label, consensus_count, unanimous_rate) for all categories, also those that no item has."""
    dim = spark_rows.sparkSession.createDataFrame([(c,) for c in categories], "label string")
    counts = spark_rows.groupBy(F.col("consensus_mechanism").alias("label")).agg(F.count("*").alias("k"), _count("agreement_level = 'unanimous'").alias("u"))
    out = dim.join(counts, "label", "left")
    return out.select("label", F.coalesce("k", F.lit(0)).alias("consensus_count"), int_rate(F.col("u"), F.col("k"), 4, None).alias("unanimous_rate"))


def with_current(rows: DataFrame, current: DataFrame) -> DataFrame:
    """rows with the current label of their source: current has (source_id, current_label); sources without a label drop out."""
    named = rows.join(current, "source_id").filter("current_label is not null and current_label <> ''")
    return named.withColumn("consensus", F.when(F.col("consensus_mechanism") == "", "no_consensus").otherwise(F.col("consensus_mechanism")))


def confusion(rows: DataFrame, current: DataFrame) -> DataFrame:
    return with_current(rows, current).groupBy("current_label", "consensus").agg(F.count("*").alias("n"))


def transitions(rows: DataFrame, current: DataFrame) -> DataFrame:
    """One row. Items without consensus count as retained uncertain ones, and are shown apart too."""
    named = with_current(rows, current)
    unsure = F.col("current_label") == "uncertain"
    sums = named.agg(
        _count(unsure).alias("current_uncertain_count"),
        _count(unsure & ~F.col("consensus").isin("uncertain", "no_consensus")).alias("uncertain_to_concrete"),
        _count(unsure & (F.col("consensus") == "no_consensus")).alias("uncertain_no_consensus"),
        _count(~unsure).alias("current_concrete_count"),
        _count(~unsure & (F.col("consensus") == "uncertain")).alias("concrete_to_uncertain"),
    )
    u, c = F.col("current_uncertain_count"), F.col("current_concrete_count")
    return sums.select(
        "*",
        int_rate(u - F.col("uncertain_to_concrete"), u, 4, None).alias("uncertain_retained_rate"),
        int_rate(F.col("uncertain_to_concrete"), u, 4, None).alias("uncertain_to_concrete_rate"),
        int_rate(F.col("concrete_to_uncertain"), c, 4, None).alias("concrete_to_uncertain_rate"),
    )


def retest_consistency(reviews: DataFrame, key: DataFrame) -> DataFrame:
    """One row (numerator, denominator, rate): raters' labels on main item and retest, where both are there; of repeated reviews the last."""
    reviews = latest(reviews, "review_order")
    groups = key.filter("retest_group_id <> ''").select("blinded_item_id", "retest_group_id")
    pairs = reviews.join(groups, "blinded_item_id").groupBy("retest_group_id", "reviewer_id").agg(F.count("*").alias("k"), F.min("mechanism_label").alias("lo"), F.max("mechanism_label").alias("hi")).filter("k = 2")
    sums = pairs.agg(_count("lo = hi").alias("numerator"), F.count("*").alias("denominator"))
    return sums.withColumn("rate", int_rate(F.col("numerator"), F.col("denominator"), 4, None))


def label_pairs(rows: DataFrame) -> DataFrame:
    """(blinded_item_id, source_id, first, second): the different labels of an item, each pair once, in order."""
    labels = F.array_sort(F.array_distinct(F.array(*[F.col(f"mech_{r}") for r in RATERS])))
    named = rows.select("blinded_item_id", "source_id", labels.alias("l"))
    pairs = F.flatten(F.transform("l", lambda x: F.transform(F.filter("l", lambda y: y > x), lambda y: F.struct(x.alias("first"), y.alias("second")))))
    return named.select("blinded_item_id", "source_id", F.explode(pairs).alias("p")).select("blinded_item_id", "source_id", "p.first", "p.second")


def dispute_pairs(rows: DataFrame, k: int | None = 5) -> DataFrame:
    """(first, second, n): pairs of labels that raters gave one item, the most frequent first, ties by first item."""
    counts = label_pairs(rows).groupBy("first", "second").agg(F.count("*").alias("n"), F.min("blinded_item_id").alias("_seen"))
    ordered = counts.orderBy(F.desc("n"), "_seen", "first", "second")
    return (ordered.limit(k) if k else ordered).drop("_seen")


def boundary_proposals(rows: DataFrame, pairs: list[tuple[str, str]], high: int = 5, examples: int = 2) -> DataFrame:
    """(label_pair, sample_count, examples, review_priority) of pairs of labels; ("concrete_label", "uncertain") stands for any label beside uncertain."""
    found = label_pairs(rows)
    parts = []
    for a, b in pairs:
        x, y = sorted((a, b))
        if a == "concrete_label":
            mine = found.filter((F.col("first") == "uncertain") | (F.col("second") == "uncertain")).select("blinded_item_id", "source_id").distinct()
        else:
            mine = found.filter((F.col("first") == x) & (F.col("second") == y)).select("blinded_item_id", "source_id")
        first = F.slice(F.array_sort(F.collect_list("source_id")), 1, examples)
        top = mine.orderBy("source_id").limit(examples).agg(F.array_join(first.cast("array<string>"), ",").alias("examples"))
        parts.append(mine.agg(F.count("*").alias("sample_count")).crossJoin(top).select(F.lit(f"{a} vs {b}").alias("label_pair"), "sample_count", "examples"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("review_priority", F.when(F.col("sample_count") >= high, "high").otherwise("medium"))
