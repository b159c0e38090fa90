"""Commands over files: demo, summarise, normalise, sample, review, consensus, disagreements, verify, lint, candidates, brief.

Exit codes: 0 done, 1 a gate failed, 2 blocked.
"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numbers import int_rate
from .operators import consensus as C
from .operators import distribution as D
from .operators import gate as G
from .operators import insights as N
from .operators import integrity as I
from .operators import labelling as L
from .operators import lint as X
from .operators import normalise as M
from .operators import runs as R
from .operators import sampling as S
from .operators import units as U
from .sources import readers, sinks

PUBLIC = readers.strings("blinded_item_id", "public_evidence_text", "parent_context", "context_available", "length_bucket")
PRIVATE = readers.strings("blinded_item_id", "source_evidence_id", "platform_source", "sampling_stratum", "is_retest", "retest_group_id", "original_main_blinded_id")
REVIEW = readers.strings("run_id", "reviewer_id", "blinded_item_id", "evidence_text", "mechanism_label", "surface_topic", "boundary_status", "abstain_reason", "confidence_band", "evidence_phrase")
STRATA = ["platform_source", "surface_topic", "mechanism_label", "length_bucket"]


def rules_of(path: str | None) -> dict:
    return readers.simple_yaml(open(path, encoding="utf-8").read()) if path else {}


def keyword_rules(settings: dict, axis: str) -> L.Rules:
    """`topic_<label>: [words]` and `mechanism_<label>: [words]` settings as rules, in order."""
    return [(k.removeprefix(f"{axis}_"), v) for k, v in settings.items() if k.startswith(f"{axis}_") and isinstance(v, list)]


def demo(spark: SparkSession, source: str, out: str, settings: dict, min_support: int, provider: str = "rules", run: str = "", generated_at: str = "") -> int:
    """Feedback to units, labels, insights, hypotheses and their evaluation; eight artefacts."""
    feedback = readers.read_csv(spark, source, readers.FEEDBACK)
    label = L.provider(provider, keyword_rules(settings, "topic"), keyword_rules(settings, "mechanism"))
    rows = label(U.evidence_units(feedback, "feedback_id", "raw_text", ["platform"]))
    found = N.insights(rows, "platform", ["feedback_id", "unit_index"], min_support)
    todo = N.actions(found)
    located = I.match_report(I.linked(rows.select("feedback_id", "unit_text"), feedback, "feedback_id", "unit_text", "raw_text", case_sensitive=False, empty_ok=False))
    result = N.evaluation(rows, located, ["uncertain", *(m for m, _ in keyword_rules(settings, "mechanism"))], found, todo)
    sinks.write_csv(rows, f"{out}/evidence", rows.columns)
    sinks.write_jsonl(N.insight_links(rows, found), f"{out}/insight_links")
    tables = {"insights": found, "actions": todo, "evaluation": result}
    for name, frame in tables.items():
        sinks.write_text(out, f"{name}.json", sinks.json_document({name: frame}))
    sinks.write_text(out, "report.md", sinks.markdown_report("Feedback evidence", tables))
    sinks.write_text(out, "report.html", sinks.html_report("Feedback evidence", tables))
    sinks.write_text(out, "manifest.json", sinks.json_document({"run_id": run} | sinks.manifest({"evidence": rows, **tables}, generated_at, "1")))
    return 0 if result.first()["status"] == "PASS" else 2


def summarise(spark: SparkSession, samples_path: str, evidence_path: str, out: str) -> int:
    """The audit summary of a sample table and its evidence."""
    samples = readers.read_csv(spark, samples_path, readers.SAMPLES)
    units = readers.read_csv(spark, evidence_path, readers.EVIDENCE)
    links = I.linked(units, samples, "sample_id", "unit_text", "public_text", "platform_source", "platform_source")
    length = lambda rows, c: D.integer_stats(rows.selectExpr(f"length({c}) AS v"), "v")
    sections = {
        "integrity": I.match_report(links),
        "sample_keys": I.key_uniqueness(samples, "sample_id", "samples"),
        "evidence_keys": I.key_uniqueness(units, "evidence_id", "evidence"),
        "sample_text": length(samples, "public_text"),
        "unit_text": length(units, "unit_text"),
        "units_per_sample": D.integer_stats(U.child_counts(samples, units, "sample_id", "sample_id"), "n_children"),
        "topics": D.ranked(D.rated_distribution(units, "surface_topic"), "key"),
        "mechanisms": D.ranked(D.rated_distribution(units, "mechanism_label"), "key"),
        "crosstab": D.ranked(D.crosstab(units, "surface_topic", "mechanism_label"), "surface_topic", "mechanism_label"),
        "platforms": D.breakdown(units, samples, "platform_source", ["surface_topic", "mechanism_label", "label_source"]),
        "stray_units": D.stray_units(units, samples, "platform_source"),
        "sample_duplicates": I.duplicate_summary(I.duplicate_groups(samples, "sample_id", "public_text")),
        "evidence_duplicates": I.duplicate_summary(I.duplicate_groups(units, "evidence_id", "unit_text")),
        "blanks": I.blank_profile(samples, "samples"),
        "orphans": I.orphan_report(units, samples, "sample_id", "sample_id", ["evidence_id"]),
        "url_hits": I.url_hits(samples, "public_text", "samples").unionByName(I.url_hits(units, "unit_text", "evidence")),
        "shares": units.agg(F.count("*").alias("n"), F.count_if(F.col("mechanism_label") == "uncertain").alias("uncertain"), F.count_if(F.col("surface_topic") == "other_uncertain").alias("other_uncertain"), F.count_if(F.col("analysis_inclusion_status") == "included_flagged_uncertain").alias("flagged")).withColumn("uncertain_rate", int_rate(F.col("uncertain"), F.col("n"))).withColumn("flagged_rate", int_rate(F.col("flagged"), F.col("n"))),
    }
    sinks.write_text(out, "analysis_summary.json", sinks.json_document(sections))
    return 0


def normalise(spark: SparkSession, samples: str, evidence: str, out: str, generated_at: str) -> int:
    """Both public tables cut to their columns, blank topics filled; a manifest of what was written."""
    one, two, n = M.normalised_dataset(readers.read_csv(spark, samples), readers.read_csv(spark, evidence), readers.SAMPLES.names, readers.EVIDENCE.names)
    sinks.write_csv(one, f"{out}/samples", one.columns)
    sinks.write_csv(two, f"{out}/evidence", two.columns)
    sinks.write_text(out, "manifest.json", sinks.json_document(sinks.manifest({"samples": one, "evidence": two}, generated_at, "1") | {"counters": n}))
    return 0


def sample(spark: SparkSession, samples: str, evidence: str, out: str, size: int, retests: int, seed: str) -> int:
    """A stratified sample of units under blinded ids: what raters see, with their parents' texts, and the private key apart."""
    parents = readers.read_csv(spark, samples, readers.SAMPLES)
    units = U.with_length_bucket(readers.read_csv(spark, evidence, readers.EVIDENCE))
    drawn = S.stratum_codes(S.stratified_sample(units, "evidence_id", STRATA, size, 2, seed), STRATA)
    drawn = spark.createDataFrame(drawn.collect(), drawn.schema)  # `size` rows
    key = S.blinded(drawn, "evidence_id", retests, seed).join(drawn.select("evidence_id", "platform_source", F.col("stratum_code").alias("sampling_stratum"), "length_bucket"), "evidence_id")
    items = U.with_parent_context(units.drop("platform_source", "length_bucket").join(F.broadcast(key), "evidence_id"), parents, "sample_id", "public_text")
    sinks.write_csv(items.withColumn("public_evidence_text", F.col("unit_text")), f"{out}/public", PUBLIC.names)
    sinks.write_csv(items.withColumn("source_evidence_id", F.col("evidence_id")), f"{out}/private", PRIVATE.names)
    sinks.write_csv(S.coverage(drawn, STRATA), f"{out}/coverage", ["dim", "value", "n"], single=True)
    return 0


def review(spark: SparkSession, public: str, out: str, settings: dict, resume: bool, most: int | None, raters: list[str] | None) -> int:
    """The rule raters' reviews of a blind sample, appended to their run: valid rows and dead letters apart; a resumed run adds what is missing."""
    items = R.capped(readers.read_csv(spark, public, PUBLIC), most, ["blinded_item_id"])
    topics, mechanisms = keyword_rules(settings, "topic"), keyword_rules(settings, "mechanism")
    run = R.run_id("rules", "rules", "all", "1", 0.0, 0)
    rows = L.rater_reviews(items, topics, mechanisms, run, text="public_evidence_text")
    rows = rows.filter(F.col("reviewer_id").isin(raters)) if raters else rows
    rows = G.with_problems(rows, REVIEW.names, [t for t, _ in topics] + ["other_uncertain"], [m for m, _ in mechanisms] + ["uncertain"])
    sinks.append_run(rows, f"{out}/reviews", run, f"{out}/dead_letters", resume)
    sinks.write_text(out, "run_report.json", sinks.json_document({"runs": R.run_report(rows)}))
    return 0


def _consensus(spark: SparkSession, reviews: str, private: str, public: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = readers.read_jsonl(spark, reviews, REVIEW).filter("blinded_item_id is not null").drop("_corrupt_record")
    sides = readers.read_csv(spark, private, PRIVATE, missing_ok=True), (readers.read_csv(spark, public, PUBLIC, missing_ok=True) if public else spark.createDataFrame([], PUBLIC))
    known = C.source_of(found.select("blinded_item_id").distinct(), *sides)
    key = known.select("blinded_item_id", F.col("source_evidence_id").alias("source_id"), (F.col("is_retest") == "true").alias("is_retest"), "retest_group_id", "public_evidence_text")
    return found, key, C.consensus_rows(found, key)


def consensus(spark: SparkSession, reviews: str, private: str, public: str | None, out: str, labels: list[str]) -> int:
    """Three raters reconciled: a row for each main item, the queue of those to adjudicate, and the agreement statistics."""
    found, key, rows = _consensus(spark, reviews, private, public)
    sinks.write_csv(rows, f"{out}/consensus", rows.columns)
    sinks.write_queue(rows, f"{out}/adjudication_queue")
    tables = {"agreement": C.agreement_summary(rows), "pairwise": C.pairwise_agreement(rows), "kappa": C.fleiss_kappa(rows, labels), "labels": C.per_label_unanimity(rows, labels), "retest": C.retest_consistency(found, key), "disputed pairs": C.dispute_pairs(rows)}
    sinks.write_text(out, "consensus.json", sinks.json_document(tables))
    sinks.write_text(out, "consensus.md", sinks.markdown_report("Consensus of three raters", tables))
    return 0


def disagreements(spark: SparkSession, reviews: str, private: str, public: str, out: str) -> int:
    """What raters disagree on: the pairs of labels that meet most, and the items with their texts, found over both tables."""
    _, key, rows = _consensus(spark, reviews, private, public)
    texts = C.source_texts(readers.read_csv(spark, private, PRIVATE, missing_ok=True).withColumnRenamed("source_evidence_id", "source_id"), readers.read_csv(spark, public, PUBLIC), text="public_evidence_text")
    items = rows.filter("agreement_level <> 'unanimous'").join(texts, "source_id", "left").orderBy("blinded_item_id")
    shown = items.select("blinded_item_id", "mech_a", "mech_b", "mech_c", "agreement_level", F.coalesce("public_evidence_text", F.lit("")).alias("text"))
    sinks.write_csv(shown, f"{out}/disagreements", shown.columns)
    sinks.write_text(out, "disagreements.md", sinks.markdown_report("Disagreements", {"pairs of labels": C.dispute_pairs(rows, 8), "first items": shown.limit(20)}))
    return 0


def verify(spark: SparkSession, public: str, forbidden: list[str], names: list[str]) -> int:
    """Whether what raters see tells where it comes from."""
    rows = readers.read_csv(spark, public)
    report = G.leak_report(rows, "public_evidence_text", forbidden, names, "result_type" if "result_type" in rows.columns else None, "blind")
    print(sinks.markdown_report("Leaks", {"checks": report}))
    return 1 if report.filter("hits > 0").count() else 0


def brief(spark: SparkSession, samples_path: str, evidence_path: str, out: str) -> int:
    """The numbers of a brief: sizes, shares in percent, first labels and platforms."""
    samples, units = readers.read_csv(spark, samples_path, readers.SAMPLES), readers.read_csv(spark, evidence_path, readers.EVIDENCE)
    sums = units.agg(F.count("*").alias("evidence"), F.count_if(F.col("mechanism_label") == "uncertain").alias("uncertain"), F.count_if(D.specific("surface_topic")).alias("specific")).crossJoin(samples.agg(F.count("*").alias("samples"), F.count_distinct("platform_source").alias("platforms")))
    r = sums.first()
    shares = {k: sinks.percent(r[k] / r["evidence"] if r["evidence"] else 0.0) for k in ("uncertain", "specific")}
    tables = {k: D.ranked(D.rated_distribution(units, c), "key").limit(8) for k, c in (("topics", "surface_topic"), ("mechanisms", "mechanism_label"), ("platforms", "platform_source"))}
    sinks.write_text(out, "brief.json", sinks.json_document({"counts": r.asDict(), "shares": shares, **tables}))
    sinks.write_text(out, "brief.md", sinks.markdown_report("Brief", {"counts": sums, **tables}))
    return 0


def lint(spark: SparkSession, root: str, pattern: str, settings: dict, level: str, report: str | None = None, display: list[str] | None = None, marker: str | None = None, top: int = 10) -> int:
    """Findings in text files, by kind and by file, and the gate over them."""
    rules = X.LintRules(banned=settings.get("banned_phrases") or [], discouraged=settings.get("discouraged_phrases") or [], internal=settings.get("internal_process_terms") or [], status=settings.get("repeated_status_terms") or [], terms=settings.get("technical_terms") or [], max_sentence=settings.get("max_sentence_length") or 60, exempt=settings.get("allowed_files") or [], display=display)
    lines = X.text_lines(readers.text_files(spark, root, pattern.split(","), settings.get("excluded_paths")), "file_path", "text")
    found = X.lint(lines, rules).persist()
    gate = X.gate(found, level, display, marker_count=X.marker_count(lines, marker).first()[0] if marker else 0)
    text = sinks.markdown_report("Findings", {"by type": X.rollup(found), "by file": X.file_rollup(found, top), "gate": gate})
    passed = gate.first()["passed"]
    if report:
        sinks.write_text(report, "findings.md", text)
        sinks.write_csv(found, f"{report}/findings", found.columns)
    print(text)
    found.unpersist()
    return 0 if passed else 1


OPTIONS = {
    "demo": ["--input!", "--output!", "--rules", "--provider", "--run-id", "--generated-at", "--min-support"],
    "summarise": ["--samples!", "--evidence!", "--output!"],
    "normalise": ["--samples!", "--evidence!", "--output!", "--generated-at"],
    "sample": ["--samples!", "--evidence!", "--output!", "--size", "--retests", "--seed"],
    "review": ["--public!", "--output!", "--rules", "--max-items", "--raters"],
    "consensus": ["--reviews!", "--private!", "--public", "--output!", "--labels!"],
    "disagreements": ["--reviews!", "--private!", "--public!", "--output!"],
    "verify": ["--public!", "--forbidden", "--names"],
    "lint": ["--root!", "--pattern", "--rules", "--level", "--report", "--display", "--marker", "--top"],
    "candidates": ["--output!", "--config"],
    "brief": ["--samples!", "--evidence!", "--output!"],
}


def listed(text: str | None) -> list[str] | None:
    return [x.strip() for x in text.split(",") if x.strip()] if text else None


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusloom")
    commands = p.add_subparsers(dest="command", required=True)
    for name, options in OPTIONS.items():
        c = commands.add_parser(name)
        for o in options:
            c.add_argument(o.rstrip("!"), required=o.endswith("!"))
    commands.choices["review"].add_argument("--resume", action="store_true")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    match a.command:
        case "demo":
            return demo(spark, a.input, a.output, rules_of(a.rules), int(a.min_support or 2), a.provider or "rules", a.run_id or "", a.generated_at or "")
        case "summarise":
            return summarise(spark, a.samples, a.evidence, a.output)
        case "normalise":
            return normalise(spark, a.samples, a.evidence, a.output, a.generated_at or now)
        case "sample":
            return sample(spark, a.samples, a.evidence, a.output, int(a.size or 300), int(a.retests or 30), a.seed or "20260720")
        case "review":
            return review(spark, a.public, a.output, rules_of(a.rules), a.resume, int(a.max_items) if a.max_items else None, listed(a.raters))
        case "consensus":
            return consensus(spark, a.reviews, a.private, a.public, a.output, listed(a.labels) or [])
        case "disagreements":
            return disagreements(spark, a.reviews, a.private, a.public, a.output)
        case "verify":
            return verify(spark, a.public, listed(a.forbidden) or ["platform", "source", "stratum"], listed(a.names) or [])
        case "brief":
            return brief(spark, a.samples, a.evidence, a.output)
        case "lint":
            return lint(spark, a.root, a.pattern or "*", rules_of(a.rules), a.level or "P1", a.report, listed(a.display), a.marker, int(a.top or 10))
    config = rules_of(a.config)
    rows = readers.candidates(spark, config.get("platforms") or ["alpha", "beta"], config.get("keywords") or ["price", "trust"])
    sinks.write_csv(rows, a.output, rows.columns)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
