"""The query catalogue over the driver's tables: each entry takes (spark, sf_dir) and returns a frame of scalar columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import int_rate
from ..functions.text import digest_mod3, text_of, u_strip
from ..operators import consensus as C
from ..operators import distribution as D
from ..operators import gate as G
from ..operators import insights as N
from ..operators import integrity as I
from ..operators import labelling as L
from ..operators import lint as X
from ..operators import normalise as M
from ..operators import runs as R
from ..operators import sampling as S
from ..operators import units as U
from ..sources import readers

# Rules over the tables' invented vocabulary; rules are parameters of the operators.
TOPICS: L.Rules = [("noise", ["###", "%%%"]), ("relation", ["with", "for "]), ("craft", ["sch"]), ("action", ["ción"]), ("water", ["eau"]), ("reference", ["this"])]
MECHANISMS: L.Rules = [("safety", ["worthless", "idiot", "scum"]), ("trust", ["sch"]), ("fairness", ["ción"]), ("belonging", ["with", "for "]), ("competence", ["eau", "tion"])]
TOPIC_NAMES = [t for t, _ in TOPICS] + ["other_uncertain"]
CODEBOOK = [m for m, _ in MECHANISMS] + ["uncertain"]
FLAGGED = "included_flagged_uncertain"
DIMS = ["source", "lang", "surface_topic", "mechanism_label", "length_bucket"]
SAMPLE, RETESTS, QUOTA, SEED = 300, 30, 5, "20260720"
LINT = X.LintRules(banned=["worthless", "idiot"], discouraged=["trash", "clown"], internal=["token ="], status=["license", "License"], terms=["tion", "ing", "th"], not_but=("with", "for"))
THRESHOLDS = [
    ("sample_id_unique_rate", 1.0, None, "block"),
    ("evidence_id_unique_rate", 1.0, None, "block"),
    ("parent_reference_rate", 1.0, None, "block"),
    ("platform_match_rate", 1.0, None, "block"),
    ("public_url_hit_count", None, 0.0, "block"),
    ("sample_duplicate_group_count", None, 0.0, "warn"),
    ("explicit_topic_rate", 0.4, None, "warn"),
    ("assigned_mechanism_rate", 0.4, None, "warn"),
    ("samples_without_evidence_rate", None, 0.05, "warn"),
    ("insight_support_resolution_rate", 1.0, None, "block"),
    ("action_to_insight_linkage_rate", 1.0, None, "block"),
    ("action_to_evidence_linkage_rate", 1.0, None, "block"),
    ("evidence_text_match_rate", 1.0, None, "block"),
    ("invalid_label_rate", None, 0.0, "block"),
    ("uncertain_share", None, 0.5, "warn"),
    ("flagged_share", None, 0.2, "warn"),
    ("absent_metric", 0.5, None, "block"),
]


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.evidence_units(docs(spark, sf_dir), "doc_id", "text", ["source", "lang"])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.with_length_bucket(L.with_labels(units(spark, sf_dir), TOPICS, MECHANISMS))


def segment_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).select("evidence_id", "doc_id", "unit_index", "unit_text")


def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ranked(D.rated_distribution(U.with_length_bucket(units(spark, sf_dir)), "length_bucket"), "key")


def distribution_of(name: str, column: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ranked(D.rated_distribution(table(spark, sf_dir, name), column), "key")


def label_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ranked(D.crosstab(labelled(spark, sf_dir), "surface_topic", "mechanism_label"), "surface_topic", "mechanism_label")


def label_crosstab_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = D.crosstab(labelled(spark, sf_dir), "surface_topic", "mechanism_label")
    return cells.filter(D.specific("surface_topic") & D.assigned("mechanism_label"))


def top_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ranked(label_crosstab_specific(spark, sf_dir), "surface_topic", "mechanism_label").limit(10)


def text_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.integer_stats(docs(spark, sf_dir).select(F.length(text_of("text")).alias("v")), "v")


def unit_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.integer_stats(units(spark, sf_dir).select(F.length("unit_text").alias("v")), "v")


def unit_density_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.integer_stats(U.unit_counts(docs(spark, sf_dir), "doc_id", "text"), "n_units")


def order_line_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.integer_stats(U.child_counts(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey"), "n_children")


def platform_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.breakdown(labelled(spark, sf_dir), docs(spark, sf_dir), "source", ["surface_topic", "mechanism_label", "length_bucket"])


def platform_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    topics = D.top_per_group(rows.filter(D.specific("surface_topic")), "source", "surface_topic", 3).select("source", F.lit("topic").alias("axis"), F.col("surface_topic").alias("label"), "n", "rank")
    mechs = D.top_per_group(rows.filter(D.assigned("mechanism_label")), "source", "mechanism_label", 2).select("source", F.lit("mechanism").alias("axis"), F.col("mechanism_label").alias("label"), "n", "rank")
    return topics.unionByName(mechs)


def label_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of labels. Short units without a mechanism count as included with a flag."""
    one = lambda c: F.count_if(c)
    rows = labelled(spark, sf_dir)
    status = F.when((F.col("mechanism_label") == "uncertain") & (F.col("length_bucket") == "short"), F.lit(FLAGGED)).otherwise(F.lit("included"))
    sums = rows.withColumn("_status", status).agg(
        F.count("*").alias("n"),
        one(F.col("mechanism_label") == "uncertain").alias("uncertain"),
        one(F.col("surface_topic") == "other_uncertain").alias("other_uncertain"),
        one(F.col("_status") == FLAGGED).alias("flagged"),
        one(D.assigned("mechanism_label")).alias("assigned"),
        one(D.specific("surface_topic")).alias("specific"),
        one(D.assigned("mechanism_label") & D.specific("surface_topic")).alias("both"),
    )
    return sums.select("*", int_rate(F.col("uncertain"), F.col("n")).alias("uncertain_rate"), int_rate(F.col("flagged"), F.col("n")).alias("flagged_rate"))


def orphan_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines against the orders that aren't finished: the lines of finished orders are the orphans."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    kept = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey")
    return I.orphan_report(lines, kept, "l_orderkey", "o_orderkey", ["l_orderkey", "l_linenumber"])


def childless_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.childless(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select("l_orderkey"), "o_orderkey", "l_orderkey")


def locatable_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of every document against all documents: parent, platform, and whether the text is there."""
    parents = docs(spark, sf_dir)
    return I.match_report(I.linked(units(spark, sf_dir), parents, "doc_id", "unit_text", "text", "source", "source"))


def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.containments(docs(spark, sf_dir), table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item_text"), "doc_id", "text", "item_id", "item_text")


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.duplicate_groups(docs(spark, sf_dir), "doc_id", "text")


def duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.duplicate_summary(duplicate_groups(spark, sf_dir))


def dedup_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.canonical(docs(spark, sf_dir), "doc_id", "text")


def blank_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of every table but the vectors."""
    return reduce(DataFrame.unionByName, [I.blank_profile(table(spark, sf_dir, n), n) for n in TABLES if n != "embeddings"])


def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"documents": "doc_id", "orders": "o_orderkey", "labels": "doc_id", "lineitem": "l_orderkey", "conversations": "conv_id", "pages": "page_id", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "nation": "n_nationkey", "region": "r_regionkey"}
    return reduce(DataFrame.unionByName, [I.key_uniqueness(table(spark, sf_dir, n).select(k), k, n) for n, k in keys.items()])


def url_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.url_hits(table(spark, sf_dir, "pages"), "url", "pages").unionByName(I.url_hits(table(spark, sf_dir, "pages"), "html", "pages")).unionByName(I.url_hits(docs(spark, sf_dir), "text", "documents"))


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.insights(labelled(spark, sf_dir), "source", ["doc_id", "unit_index"], min_support=100)


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.actions(insights(spark, sf_dir))


def evaluation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    # the demonstration's rule: case doesn't count, and an empty unit isn't located
    located = I.match_report(I.linked(rows.select("doc_id", "unit_text"), docs(spark, sf_dir), "doc_id", "unit_text", "text", case_sensitive=False, empty_ok=False))
    found = insights(spark, sf_dir)
    return N.evaluation(rows, located, CODEBOOK, found, N.actions(found))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, value) of all groups of metrics that the tables carry: structure, cleaning, coding, analysis support."""
    rows, parents = labelled(spark, sf_dir), docs(spark, sf_dir)
    links = I.match_report(I.linked(rows.select("doc_id", "unit_text", "source"), parents, "doc_id", "unit_text", "text", "source", "source")).select("n", "orphans", "mismatches")
    shares = label_shares(spark, sf_dir)
    row = evaluation_status(spark, sf_dir).crossJoin(links.drop("n")).crossJoin(shares.drop("n"))
    row = row.crossJoin(I.key_uniqueness(parents, "doc_id").select(F.col("unique_rate").alias("sample_id_unique_rate")))
    row = row.crossJoin(I.url_hits(parents, "text").select("hits")).crossJoin(I.duplicate_summary(I.duplicate_groups(parents, "doc_id", "text")).select("groups"))
    empty = U.unit_counts(parents, "doc_id", "text").agg(F.count_if(F.col("n_units") == 0).alias("bare"), F.count("*").alias("samples"))
    row = row.crossJoin(empty)
    n, r = F.col("n"), lambda a, b: int_rate(a, b, 6, 1.0)
    values = {
        "sample_id_unique_rate": F.col("sample_id_unique_rate"),
        "evidence_id_unique_rate": F.col("evidence_id_unique_rate"),
        "parent_reference_rate": r(n - F.col("orphans"), n),
        "platform_match_rate": r(n - F.col("orphans") - F.col("mismatches"), n),
        "evidence_text_match_rate": F.col("evidence_text_match_rate"),
        "public_url_hit_count": F.col("hits").cast("double"),
        "sample_duplicate_group_count": F.col("groups").cast("double"),
        "invalid_label_rate": F.col("invalid_label_rate"),
        "explicit_topic_rate": r(F.col("specific"), n),
        "assigned_mechanism_rate": r(F.col("assigned"), n),
        "uncertain_share": F.col("uncertain_rate"),
        "flagged_share": F.col("flagged_rate"),
        "samples_without_evidence_rate": r(F.col("bare"), F.col("samples")),
        "insight_support_resolution_rate": F.col("insight_support_resolution_rate"),
        "action_to_insight_linkage_rate": F.col("action_to_insight_linkage_rate"),
        "action_to_evidence_linkage_rate": F.col("action_to_evidence_linkage_rate"),
    }
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()])).alias("m")).select("m.*")


def metric_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame(THRESHOLDS, "metric string, min double, max double, level string")
    return G.threshold_gate(metric_rows(spark, sf_dir), limits)


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn units with their labels and place: SAMPLE rows, read once."""
    rows = S.stratified_sample(labelled(spark, sf_dir), "evidence_id", DIMS, SAMPLE, 2, SEED)
    return spark.createDataFrame(rows.collect(), rows.schema)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratum_codes(drawn(spark, sf_dir), DIMS).select("evidence_id", "pick", "stratum_code", *DIMS)


def sample_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coverage(drawn(spark, sf_dir), DIMS)


def blind_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample and its retests under blinded ids: SAMPLE and RETESTS rows, read once."""
    rows = S.blinded(drawn(spark, sf_dir), "evidence_id", RETESTS, SEED)
    return spark.createDataFrame(rows.collect(), rows.schema)


def balanced_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.balanced_quota(docs(spark, sf_dir), "doc_id", "source", QUOTA, SEED)


def parents_of(spark: SparkSession, sf_dir: str, key: DataFrame) -> DataFrame:
    """The documents that the sample's units come from; the sample is small, so only these are segmented."""
    ids = key.select(F.regexp_extract("evidence_id", "^(.*)_U[0-9]+$", 1).alias("_id")).distinct()
    return docs(spark, sf_dir).join(F.broadcast(ids), F.col("doc_id").cast("string") == F.col("_id"), "left_semi")


def items_of(spark: SparkSession, sf_dir: str, key: DataFrame) -> DataFrame:
    texts = U.evidence_units(parents_of(spark, sf_dir, key), "doc_id", "text", ["source", "lang"])
    return texts.select("evidence_id", "doc_id", F.col("unit_text").alias("text"), "source").join(F.broadcast(key), "evidence_id")


def reviews_of(spark: SparkSession, sf_dir: str, key: DataFrame) -> DataFrame:
    return L.rater_reviews(items_of(spark, sf_dir, key), TOPICS, MECHANISMS)


def mock_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three raters over all units, under their own ids."""
    return L.rater_reviews(units(spark, sf_dir), TOPICS, MECHANISMS, item="evidence_id", text="unit_text").drop("evidence_text", "run_id")


def rows_of(spark: SparkSession, sf_dir: str, key: DataFrame | None = None) -> DataFrame:
    key = blind_sample(spark, sf_dir) if key is None else key
    return C.consensus_rows(reviews_of(spark, sf_dir, key), key.withColumnRenamed("evidence_id", "source_id"))


def consensus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sf_dir)


def over_consensus(f: Callable[[DataFrame], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return f(rows_of(spark, sf_dir))


def current(spark: SparkSession, sf_dir: str, key: DataFrame) -> DataFrame:
    """The label that a sampled unit has by the rules; units of src5 have none, so that some items lack one."""
    rows = L.with_labels(U.evidence_units(parents_of(spark, sf_dir, key), "doc_id", "text", ["source"]), TOPICS, MECHANISMS)
    return rows.filter("source <> 'src5'").select(F.col("evidence_id").alias("source_id"), F.col("mechanism_label").alias("current_label"))


def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = blind_sample(spark, sf_dir)
    return C.confusion(rows_of(spark, sf_dir, key), current(spark, sf_dir, key))


def label_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = blind_sample(spark, sf_dir)
    return C.transitions(rows_of(spark, sf_dir, key), current(spark, sf_dir, key))


def retest_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = blind_sample(spark, sf_dir)
    return C.retest_consistency(reviews_of(spark, sf_dir, key), key.withColumnRenamed("evidence_id", "source_id"))


def krippendorff_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.krippendorff_alpha(reviews_of(spark, sf_dir, blind_sample(spark, sf_dir)))


def spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units' reviews, some spoiled by the remainder of a digest."""
    rows = L.rater_reviews(units(spark, sf_dir), TOPICS, MECHANISMS, item="evidence_id", text="unit_text")
    k = F.ascii(F.sha2(F.concat("blinded_item_id", "reviewer_id"), 256))  # 0 to 9 and a to f
    rows = rows.withColumn("_k", k)
    return rows.select(
        *[c for c in rows.columns if c not in ("_k", "mechanism_label", "boundary_status", "confidence_band", "evidence_phrase", "surface_topic", "abstain_reason")],
        F.when(F.col("_k") == ord("0"), "bogus").otherwise(F.col("mechanism_label")).alias("mechanism_label"),
        F.when(F.col("_k") == ord("1"), "").otherwise(F.col("boundary_status")).alias("boundary_status"),
        F.when(F.col("_k") == ord("2"), "sure").otherwise(F.col("confidence_band")).alias("confidence_band"),
        F.when(F.col("_k") == ord("3"), "not in the text").otherwise(F.col("evidence_phrase")).alias("evidence_phrase"),
        F.when(F.col("_k") == ord("4"), "nowhere").otherwise(F.col("surface_topic")).alias("surface_topic"),
        F.when(F.col("_k") == ord("5"), "none").otherwise(F.col("abstain_reason")).alias("abstain_reason"),
    )


REQUIRED = ["run_id", "reviewer_id", "blinded_item_id", "evidence_text", "mechanism_label", "surface_topic", "boundary_status", "abstain_reason", "confidence_band", "evidence_phrase"]


def validation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.with_problems(spoiled(spark, sf_dir), REQUIRED, TOPIC_NAMES, CODEBOOK)
    return found.select("reviewer_id", F.array_join("problems", ",").alias("problems")).groupBy("reviewer_id", "problems").agg(F.count("*").alias("n"))


def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_report(G.with_problems(spoiled(spark, sf_dir), REQUIRED, TOPIC_NAMES, CODEBOOK))


def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the blind sample that a run which has done the first hundred still has to do."""
    key = blind_sample(spark, sf_dir).select("blinded_item_id")
    return R.remaining(key, key.filter("blinded_item_id <= 'CAL_0100'"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.text_lines(docs(spark, sf_dir), "doc_id", "text")


def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lint(lines(spark, sf_dir), LINT)


def lint_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rollup(lint_findings(spark, sf_dir))


def lint_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lint_findings(spark, sf_dir)
    return reduce(DataFrame.unionByName, [X.gate(found, level) for level in ("P0", "P1", "P2")])


def html_visible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = X.broken_at_tags(table(spark, sf_dir, "pages"), "html")
    return X.visible_lines(X.text_lines(pages, "page_id", "html")).select("file_path", "line_number", "raw")


def pii_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.privacy_masked(docs(spark, sf_dir), "doc_id", "text")
    return rows.select("doc_id", "n_url", "n_email", "n_phone", "n_messenger", "n_handle", F.sha2("masked_text", 256).alias("masked_sha256"))


def normalised_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank topics filled: units without a topic rule count as blank first."""
    rows = labelled(spark, sf_dir).withColumn("surface_topic", F.when(F.col("surface_topic") == "other_uncertain", F.lit(" ")).otherwise(F.col("surface_topic")))
    done = M.filled(rows, "surface_topic", "other_uncertain")
    return done.groupBy("surface_topic").agg(F.count("*").alias("n"), F.sum(F.col("_filled").cast("long")).alias("filled"))


def merged_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda name, column: table(spark, sf_dir, name).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
    history = count("documents", "source").withColumn("n", F.col("n") - F.length("key"))
    return M.max_merged(count("documents", "source"), history, spark.createDataFrame([("src0", 50), ("other", 7)], "key string, n long"))


def source_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.source_shift(labelled(spark, sf_dir), "source", "mechanism_label")


def field_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.completion(docs(spark, sf_dir), ["text", "lang", "source"])


def single_platform_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.groupable(labelled(spark, sf_dir))
    return rows.groupBy("surface_topic", "mechanism_label").agg(F.count_distinct("source").alias("platforms"), F.count_distinct("lang").alias("langs")).withColumn("single", F.col("platforms") == 1)


def audit_short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and those shorter than eight characters after cleaning, by source."""
    return M.pre_cleaned(docs(spark, sf_dir), "text", 0).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.length("text") < 8).alias("short"))


def digest_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a 256-bit digest mod 3, without big numbers."""
    return docs(spark, sf_dir).groupBy(digest_mod3(F.sha2(F.col("doc_id").cast("string"), 256)).alias("remainder")).agg(F.count("*").alias("n"))


def candidate_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.candidates(spark, ["alpha", "beta", "gamma"], ["price", "trust"])


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import content_digest

    return reduce(DataFrame.unionByName, [content_digest(table(spark, sf_dir, n)).withColumn("file", F.lit(n)) for n in TABLES])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        segment_units, length_buckets, label_crosstab, label_crosstab_specific, top_combinations, text_length_stats, unit_length_stats, unit_density_stats,
        order_line_density, platform_breakdown, platform_topk, label_shares, orphan_children, childless_parents, locatable_units, benchmark_containment,
        duplicate_groups, duplicate_summary, dedup_canonical, blank_profile, key_uniqueness, url_hits, insights, actions, evaluation_status, metric_gate,
        stratified_sample, sample_coverage, blind_sample, balanced_quota, mock_reviews, consensus_rows, label_confusion, label_transitions, retest_consistency,
        krippendorff_alpha, validation_problems, run_reports, resume_remaining, lint_findings, lint_rollup, lint_gate, html_visible_lines, pii_mask_counts,
        normalised_labels, merged_counters, source_shift, field_completion, single_platform_support, audit_short_texts, digest_classes, candidate_register, file_manifest,
    ]
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in plain}
    out |= {f"rated_distribution_{c}": partial(distribution_of, t, c) for t, c in (("documents", "source"), ("events", "event_type"), ("conversations", "role"))}
    from .more import more_queries

    out |= more_queries()
    mine = {
        "agreement_summary": C.agreement_summary,
        "pairwise_agreement": C.pairwise_agreement,
        "fleiss_kappa": lambda r: C.fleiss_kappa(r, CODEBOOK),
        "per_label_unanimity": lambda r: C.per_label_unanimity(r, CODEBOOK),
        "dispute_pairs": C.dispute_pairs,
        "dispute_pairs_top8": lambda r: C.dispute_pairs(r, 8),
        "boundary_proposals": lambda r: C.boundary_proposals(r, [("trust", "belonging"), ("belonging", "competence"), ("concrete_label", "uncertain")]),
    }
    return out | {k: partial(over_consensus, f) for k, f in mine.items()}
