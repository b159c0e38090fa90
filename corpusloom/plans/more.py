"""More queries of the catalogue: round trips through sinks and sources, lookups, checks of samples, parsing, report tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import entropy, int_rate
from ..functions.text import has_cjk, masked, text_of, without_fence
from ..operators import consensus as C
from ..operators import distribution as D
from ..operators import gate as G
from ..operators import insights as N
from ..operators import integrity as I
from ..operators import labelling as L
from ..operators import lint as X
from ..operators import normalise as M
from ..operators import runs as R
from ..operators import units as U
from ..sources import readers, sinks
from . import catalogue as Q


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or in local mode, where that is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    path = f"{root.rstrip('/')}/corpusloom-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows written as Parquet and read again: filters on columns that are dear to derive then don't derive them once more for each use."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as CSV and read again, line feeds, quotes and all; a missing file is empty."""
    rows, path = Q.docs(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")), scratch(spark, "csv")
    sinks.write_csv(rows, path, ["doc_id", "source", "text", "absent"])
    back = readers.read_csv(spark, path, readers.strings("doc_id", "source", "text", "absent"))
    none = readers.read_csv(spark, f"{path}-none", readers.strings("doc_id", "source", "text", "absent"), missing_ok=True)
    return back.unionByName(none).select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.sha2("text", 256).alias("text_sha256"), "absent")


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations written as JSON lines and read again."""
    path = scratch(spark, "jsonl")
    rows = Q.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sinks.write_jsonl(rows, path)
    back = readers.read_jsonl(spark, path, rows.schema)
    return back.filter("_corrupt_record is null").select("conv_id", "turn", "role", F.sha2(text_of("text"), 256).alias("text_sha256"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rater_reviews(Q.units(spark, sf_dir), Q.TOPICS, Q.MECHANISMS, item="evidence_id", text="unit_text")


def appended_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that is stopped after the units of half of the languages, then resumed over all: each review is there once, dead letters apart."""
    rows = G.with_problems(Q.spoiled(spark, sf_dir), Q.REQUIRED, Q.TOPIC_NAMES, Q.CODEBOOK)
    rows = written(rows.select("run_id", "reviewer_id", "blinded_item_id", "mechanism_label", "problems"), "checked")
    path, dead = scratch(spark, "run"), scratch(spark, "dead")
    first = rows.filter(F.col("mechanism_label").isin("uncertain", "trust"))
    sinks.append_run(first, path, "rules", dead)
    sinks.append_run(rows, path, "rules", dead, resume=True)
    back = readers.read_jsonl(spark, f"{path}/run=rules", rows.drop("problems").schema)
    return back.groupBy("reviewer_id", "mechanism_label").agg(F.count("*").alias("n"), F.count_distinct("blinded_item_id").alias("items"))


def parent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the text of the first turn of their conversation as context."""
    turns = Q.table(spark, sf_dir, "conversations")
    first = turns.filter("turn = 0").select("conv_id", "text")
    rows = U.with_parent_context(turns.select("conv_id", "turn"), first, "conv_id", "text")
    return rows.select("conv_id", "turn", F.length("parent_context").alias("context_length"), "context_available")


def public_private(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The blind sample as raters see it, with context, and its private key."""
    key = Q.blind_sample(spark, sf_dir)
    items = Q.items_of(spark, sf_dir, key)
    public = U.with_parent_context(items, Q.parents_of(spark, sf_dir, key), "doc_id", "text")
    public = public.select("blinded_item_id", F.col("text").alias("public_evidence_text"), "parent_context", "context_available")
    private = items.select("blinded_item_id", F.col("evidence_id").alias("source_id"), F.col("source").alias("platform_source"), F.col("is_retest").cast("string").alias("is_retest"), "retest_group_id", "original_main_blinded_id")
    return public, private


def public_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    public, _ = public_private(spark, sf_dir)
    return public.select("blinded_item_id", "public_evidence_text", F.sha2("parent_context", 256).alias("context_sha256"), "context_available")


def private_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return public_private(spark, sf_dir)[1]


def leak_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What raters see, looked through for headers and names that tell where it comes from."""
    public, _ = public_private(spark, sf_dir)
    rows = public.withColumn("result_type", F.lit("blind"))
    return G.leak_report(rows, "public_evidence_text", ["platform", "source", "stratum", "context"], ["src1", "idiot"], "result_type", "blind")


def item_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents' sources: the private row (documents of src0 and src1) before the public one, whole."""
    rows = Q.table(spark, sf_dir, "labels").select("doc_id")
    parents = Q.docs(spark, sf_dir).select("doc_id", "source", "lang")
    private = parents.filter(F.col("source").isin("src0", "src1")).select("doc_id", F.concat(F.lit("private-"), "source").alias("source"))
    return C.source_of(rows, private, parents.filter("source <> 'src2'"), "doc_id")


def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    public, private = public_private(spark, sf_dir)
    return C.source_texts(private, public.filter("context_available = 'yes'"), text="public_evidence_text")


def repeated_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus where rater a reviewed every item twice, the second time without a label: the last review counts."""
    key = Q.blind_sample(spark, sf_dir)
    once = Q.reviews_of(spark, sf_dir, key).withColumn("review_order", F.lit(1))
    again = once.filter("reviewer_id = 'a'").withColumn("mechanism_label", F.lit("uncertain")).withColumn("review_order", F.lit(2))
    rows = C.consensus_rows(once.unionByName(again), key.withColumnRenamed("evidence_id", "source_id"))
    return rows.select("blinded_item_id", "mech_a", "mech_b", "mech_c", "agreement_level", "consensus_mechanism")


def repeated_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against orders where each order stands twice, the second time of another customer: the last parent counts, and no line is counted twice."""
    lines = Q.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.lit("O").alias("part"))
    orders = Q.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("whole"), F.lit(1).alias("at"))
    return I.match_report(I.linked(lines, orders.unionByName(orders.withColumn("whole", F.lit("")).withColumn("at", F.lit(2))), "key", "part", "whole", order=["at"]))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews as a model might answer: fenced for rater b, without an abstain reason for c, cut off where a's digest begins with 0."""
    rows = reviews(spark, sf_dir)
    body = F.to_json(F.struct("mechanism_label", "surface_topic", F.when(F.col("reviewer_id") != "c", F.col("abstain_reason")).alias("abstain_reason")))
    cut = (F.col("reviewer_id") == "a") & F.startswith(F.sha2("blinded_item_id", 256), F.lit("0"))
    text = F.when(cut, F.substring(body, 1, 9)).when(F.col("reviewer_id") == "b", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return rows.select("reviewer_id", "blinded_item_id", text.alias("answer"))


def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = R.parsed_answers(answers(spark, sf_dir), "answer", {"run_id": F.lit("r1"), "reviewer_id": F.col("reviewer_id"), "blinded_item_id": F.col("blinded_item_id")}, "2024-01-01T00:00:00")
    one = good.groupBy("reviewer_id", "mechanism_label", "abstain_reason", "confidence_band", "created_at").agg(F.count("*").alias("n"))
    lost = bad.groupBy("reviewer_id").agg(F.count("*").alias("n")).select("reviewer_id", F.lit("(rejected)").alias("mechanism_label"), F.lit("").alias("abstain_reason"), F.lit("").alias("confidence_band"), F.lit("").alias("created_at"), "n")
    return one.unionByName(lost)


def fenced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark inside a code fence, bare again."""
    rows = Q.table(spark, sf_dir, "benchmark")
    return rows.select("item_id", without_fence(F.concat(F.lit("```text\n"), text_of("text"), F.lit("\n```"))).alias("text"))


def cjk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = Q.docs(spark, sf_dir).select("text").unionByName(spark.createDataFrame([("中文",), ("かな",), (None,)], "text string"))
    return both.groupBy(has_cjk("text").alias("has_cjk")).agg(F.count("*").alias("n"))


def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of texts read as programs, lines with CJK characters in a comment or string; every document gets one such comment first."""
    rows = Q.docs(spark, sf_dir).select("doc_id", F.concat(F.lit("# 注释\nplain 中\ns = \"中\"\n"), text_of("text")).alias("text"))
    return X.script_text_lines(X.text_lines(rows, "doc_id", "text")).select("file_path", "line_number", "raw")


def exempt_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by kind where even documents are exempt from all but internal terms."""
    rules = X.LintRules(banned=["worthless", "idiot"], internal=["token ="], exempt=[str(i) for i in range(0, 200, 2)])
    return X.lint(Q.lines(spark, sf_dir), rules).groupBy("issue_type").agg(F.count("*").alias("n"))


def lint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.file_rollup(Q.lint_findings(spark, sf_dir), 10)


def lint_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate with the marker counted."""
    found, n = Q.lint_findings(spark, sf_dir), X.marker_count(Q.lines(spark, sf_dir), "License").first()[0]
    return X.gate(found.filter("priority = 'P9'"), "P1", marker_count=n).withColumn("marker_count", F.lit(n))


def insight_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence of every insight."""
    rows = Q.labelled(spark, sf_dir)
    return N.insight_links(rows, N.insights(rows, "source", ["doc_id", "unit_index"], min_support=100))


def topic_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight bars of the topics, with names where there are any, and shares in percent."""
    rows = D.ranked(D.rated_distribution(Q.labelled(spark, sf_dir), "surface_topic"), "key").limit(8)
    tenths = F.floor((F.col("n") * 2000 + F.col("total")) / (F.col("total") * 2)).cast("long")
    share = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))
    return rows.select("key", L.named("key", {"noise": "Noise", "water": "Water"}).alias("name"), "n", share.alias("share"))


def capped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty items of rater b."""
    rows = reviews(spark, sf_dir).select("reviewer_id", "blinded_item_id")
    return R.capped(rows, 20, ["blinded_item_id"], ["b"])


def counter_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole numbers from 0 of JSON counters, one of them text, one negative, one a list."""
    rows = Q.table(spark, sf_dir, "nation").select("n_nationkey", F.format_string('{"a": %d, "b": "x%d", "c": -%d, "d": [1], "e": 1.5}', "n_nationkey", "n_nationkey", F.col("n_nationkey") + 1).alias("j"))
    return rows.select("n_nationkey", F.explode(M.count_entries(F.col("j"))).alias("key", "n"))


def label_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entropy of mechanisms in each source, from counts."""
    counts = Q.labelled(spark, sf_dir).groupBy("source", "mechanism_label").agg(F.count("*").alias("n"))
    listed = counts.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("mechanism_label", "n"))), lambda x: x["n"]).alias("ns"))
    return listed.select("source", F.round(entropy(F.col("ns")), 2).alias("entropy"))


def cleaned_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after cleaning: how many are left, and their characters."""
    rows = M.pre_cleaned(Q.docs(spark, sf_dir), "text", 1)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def inclusion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by two marks: quality says whether a document is relevant, toxic whether it is readable; none of either leaves it open."""
    say = lambda c, yes: F.when(F.col(c) == yes, "yes").when(F.col(c).isNotNull(), "no")
    rows = Q.docs(spark, sf_dir).select("doc_id").join(Q.table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", say("quality", 1).alias("relevant"), say("toxic", 0).alias("readable"))
    return M.inclusion_state(rows, "relevant", "readable").groupBy("inclusion").agg(F.count("*").alias("n"))


def rater_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to the columns that raters see, an absent one empty."""
    return M.whitelist(Q.docs(spark, sf_dir), ["doc_id", "lang", "window_tag"])


def empty_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank dates: those of orders of the status P count as unknown."""
    rows = Q.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("string")).alias("d"))
    sums = rows.agg(F.count("*").alias("n"), F.count_if(F.trim(text_of("d")) == "").alias("empty"))
    return sums.select("n", "empty", int_rate(F.col("empty"), F.col("n")).alias("empty_rate"))


def masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messenger ids are masked like the rest."""
    rows = Q.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("add WeChat: id_"), F.lpad(F.col("n_nationkey").cast("string"), 6, "0"), F.lit(" or @me_ok")).alias("t"))
    return rows.select("n_nationkey", masked("t").alias("masked"))


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", F.to_json(F.struct("n_name", "n_nationkey")).alias("json"))


def adjudication_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue written as CSV and read again."""
    path = scratch(spark, "queue")
    sinks.write_queue(Q.rows_of(spark, sf_dir), path)
    return readers.read_csv(spark, path).select("blinded_item_id", "source_id", "agreement_level")


def normalised_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and units cut to public columns, blank topics filled: what was counted on the way."""
    units = Q.labelled(spark, sf_dir).withColumn("surface_topic", F.when(F.col("surface_topic") != "other_uncertain", F.col("surface_topic")))
    _, _, n = M.normalised_dataset(Q.docs(spark, sf_dir), units, ["doc_id", "source"], ["evidence_id", "doc_id", "surface_topic"])
    return spark.createDataFrame(sorted(n.items()), "counter string, n long")


def more_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = [
        csv_round_trip, jsonl_round_trip, appended_run, parent_context, public_sample, private_key, leak_checks, item_sources, source_texts, repeated_reviews, repeated_parents,
        parsed_answers, fenced_texts, cjk_texts, script_lines, exempt_findings, lint_files, lint_markers, insight_links, topic_bars, capped_items, counter_entries, label_entropy,
        cleaned_lengths, inclusion_states, rater_view, empty_dates, masked_texts, json_rows, adjudication_queue, normalised_tables,
    ]
    return {f.__name__: f for f in listed}
