import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import consensus as C
from corpusloom.operators import distribution as D
from corpusloom.operators import gate as G
from corpusloom.operators import integrity as I
from corpusloom.operators import labelling as L
from corpusloom.operators import lint as X
from corpusloom.operators import normalise as M
from corpusloom.operators import runs as R
from corpusloom.operators import sampling as S
from corpusloom.operators import units as U


def tuples(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_units_are_numbered_after_the_filter(spark):
    docs = spark.createDataFrame([(1, "abc. long enough. x. another one"), (2, None), (3, "tiny")], "id long, text string")
    assert tuples(U.evidence_units(docs, "id", "text"), "id", "unit_index", "unit_text", "evidence_id") == [(1, 1, "long enough", "1_U01"), (1, 2, "another one", "1_U02")]
    assert tuples(U.unit_counts(docs, "id", "text"), "id", "n_units") == [(1, 2), (2, 0), (3, 0)]


def test_rated_distribution(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (" ",)], "k string")
    out = D.ranked(D.rated_distribution(rows, "k"), "key").collect()
    assert [tuple(r) for r in out] == [("(empty)", 2, 5, 0.4), ("a", 2, 5, 0.4), ("b", 1, 5, 0.2)]
    assert D.rated_distribution(rows.limit(0), "k").count() == 0


@pytest.mark.parametrize("values, want", [([], (0, 0, 0.0, 0.0, 0, 0)), ([7], (1, 7, 7.0, 7.0, 7, 7)), ([1, 2, 3, 4, 5, 6], (6, 1, 3.5, 3.5, 5, 6)), ([5, 1, 1], (3, 1, 1.0, 2.33, 5, 5))])
def test_integer_stats(spark, values, want):
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    assert tuple(D.integer_stats(rows, "v").first()) == want


def test_breakdown_and_strays(spark):
    units = spark.createDataFrame([("p", "x"), ("p", "x"), ("p", "y"), ("q", "z")], "g string, l string")
    parents = spark.createDataFrame([("p",), ("p",), ("r",)], "g string")
    assert tuples(D.breakdown(units, parents, "g", ["l"]), "g", "samples", "units", "units_per_sample", "l_counts") == [("p", 2, 3, 1.5, "x:2,y:1"), ("r", 1, 0, 0.0, "")]
    assert tuples(D.stray_units(units, parents, "g"), "g", "n") == [("q", 1)]


def test_links_and_report(spark):
    parents = spark.createDataFrame([(1, "Hello wide world", "p"), (2, "other", "q")], "id long, whole string, grp string")
    units = spark.createDataFrame([(1, "wide  world", "p"), (1, "absent", "p"), (2, "other", "p"), (3, "lost", "p"), (2, "", "q")], "id long, part string, pg string")
    out = I.match_report(I.linked(units, parents, "id", "part", "whole", "pg", "grp")).first()
    assert tuple(out) == (5, 1, 1, 2, 0.4)
    strict = I.match_report(I.linked(units, parents, "id", "part", "whole", "pg", "grp", empty_ok=False)).first()
    assert strict["located"] == 1


def test_last_parent_wins(spark):
    rows = spark.createDataFrame([(1, 1, "old"), (1, 2, "new")], "id long, ord long, t string")
    assert I.last_wins(rows, "id", ["ord"]).first()["t"] == "new"


def test_duplicates(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "a\xa0b"), (4, " "), (5, ""), (6, "c")], "id long, t string")
    groups = I.duplicate_groups(rows, "id", "t")
    assert tuples(groups, "first_id", "size", "ids") == [(1, 3, "1,2,3")]
    assert tuple(I.duplicate_summary(groups.limit(0)).first()) == (0, 0, 1)
    assert tuples(I.canonical(rows, "id", "t"), "id", "canonical_id") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)]


def test_containment_and_its_limit(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The Quick fox"), (2, "slow")], "d long, t string")
    items = spark.createDataFrame([(9, "quick FOX"), (8, " ")], "i long, s string")
    assert tuples(I.containments(docs, items, "d", "t", "i", "s"), "i", "d") == [(9, 1)]
    more = items.unionByName(spark.createDataFrame([(7, "a much longer passage"), (6, "slow"), (5, "SLOW")], "i long, s string"))
    docs = docs.unionByName(spark.createDataFrame([(3, "before a MUCH longer  passage after"), (4, "a much longer one")], "d long, t string"))
    for limit in (1 << 20, 0):  # items broadcast, then by their grams
        monkeypatch.setattr(I, "BROADCAST_BYTES", limit)
        assert tuples(I.containments(docs, more, "d", "t", "i", "s"), "i", "d") == [(5, 2), (6, 2), (7, 3), (9, 1)]
    monkeypatch.setattr(I, "BROADCAST_ROWS", 1)
    with pytest.raises(ValueError):
        I.containments(docs, more, "d", "t", "i", "s")


RULES = [("x", ["foo", "bar"]), ("y", ["baz"])]


def test_rules(spark):
    rows = spark.createDataFrame([("a baz and foo",), ("baz",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(L.first_match("t", RULES, "none")).collect()] == ["x", "y", "none", "none"]
    assert rows.select(L.all_matches("t", RULES)).first()[0] == ["x", "y"]
    assert L.rules_from_table([(2, "baz", "y"), (1, "foo", "x"), (1, "bar", "x")]) == [("x", ["bar", "foo"]), ("y", ["baz"])]
    with pytest.raises(ValueError):
        L.provider("unknown", RULES, RULES)
    units = spark.createDataFrame([("has foo",)], "unit_text string")
    assert L.provider("rules", RULES, RULES)(units).first()["surface_topic"] == "x"
    assert [r[0] for r in rows.select(L.named(F.lit("x"), {"x": "Ex"})).limit(1).collect()] == ["Ex"] and rows.select(L.named(F.lit("y"), {"x": "Ex"})).first()[0] == "y"


def test_raters(spark):
    items = spark.createDataFrame([("i1", "tiny"), ("i2", "foo and baz in a long text"), ("i3", "nothing of note in here")], "blinded_item_id string, text string")
    out = {(r["blinded_item_id"], r["reviewer_id"]): r for r in L.rater_reviews(items, RULES, RULES).collect()}
    assert len(out) == 9 and out["i1", "b"]["boundary_status"] == "needs_parent_context" and out["i1", "b"]["abstain_reason"] == "insufficient_context"
    assert out["i2", "b"]["mechanism_label"] == "x" and out["i2", "b"]["confidence_band"] == "medium"
    assert out["i3", "a"]["mechanism_label"] == "uncertain" and out["i3", "a"]["surface_topic"] == "other_uncertain"


def rows_for_sampling(spark, n=200):
    return spark.range(n).select(F.format_string("u%03d", "id").alias("id"), F.when(F.col("id") < 3, "rare").otherwise("often").alias("a"), (F.col("id") % 7).cast("string").alias("b"))


def test_sample_keeps_quotas_whatever_the_partitions(spark):
    rows = rows_for_sampling(spark)
    one, two = (tuples(S.stratified_sample(rows.repartition(k), "id", ["a", "b"], 40), "id", "pick") for k in (1, 7))
    assert one == two and len({i for i, _ in one}) == 40
    drawn = rows.join(spark.createDataFrame(one, "id string, pick int"), "id")
    assert all(n >= 2 for _, n in tuples(drawn.groupBy("a").count(), "a", "count") + tuples(drawn.groupBy("b").count(), "b", "count"))
    assert S.stratified_sample(rows, "id", ["a", "b"], 500).count() == 200
    assert S.stratified_sample(rows, "id", ["a", "b"], 5).count() == 5
    assert {d for d, _, _ in tuples(S.coverage(drawn, ["a", "b"]), "dim", "value", "n")} == {"a", "b"}


def test_blinding(spark):
    sample = S.stratified_sample(rows_for_sampling(spark), "id", ["a"], 30)
    out = S.blinded(sample, "id", 6).collect()
    names = sorted(r["blinded_item_id"] for r in out)
    assert names == [f"CAL_{i:04d}" for i in range(1, 37)]
    main = {r["retest_group_id"]: r["blinded_item_id"] for r in out if not r["is_retest"] and r["retest_group_id"]}
    again = [r for r in out if r["is_retest"]]
    assert len(main) == len(again) == 6 and all(main[r["retest_group_id"]] == r["original_main_blinded_id"] for r in again)


LABELS = ["trust", "fairness", "uncertain"]


def mini(spark):
    """Three items and a retest of the first: unanimous, majority, disputed."""
    labels = {"i1": "ttt", "i2": "ttf", "i3": "tfu", "i4": "ttt"}
    name = {"t": "trust", "f": "fairness", "u": "uncertain"}
    rows = [(r, i, name[x], "topic", "complete") for i, xs in labels.items() for r, x in zip("abc", xs, strict=True)]
    reviews = spark.createDataFrame(rows, "reviewer_id string, blinded_item_id string, mechanism_label string, surface_topic string, boundary_status string")
    key = spark.createDataFrame([("i1", "s1", False, "G1"), ("i2", "s2", False, ""), ("i3", "s3", False, ""), ("i4", "s1", True, "G1")], "blinded_item_id string, source_id string, is_retest boolean, retest_group_id string")
    return reviews, key


def test_consensus(spark):
    reviews, key = mini(spark)
    rows = C.consensus_rows(reviews, key)
    assert tuples(rows, "blinded_item_id", "agreement_level", "consensus_mechanism", "mechanism_entropy", "needs_adjudication") == [("i1", "unanimous", "trust", 0.0, False), ("i2", "majority", "trust", 0.9183, True), ("i3", "disputed", "", 1.585, True)]
    summary = {r["metric"]: (r["numerator"], r["rate"]) for r in C.agreement_summary(rows).collect()}
    assert summary["three_way_agreement"] == (1, 0.3333) and summary["majority_agreement"] == (2, 0.6667)
    assert tuple(C.retest_consistency(reviews, key).first()) == (3, 3, 1.0)
    assert tuples(C.dispute_pairs(rows), "first", "second", "n") == [("fairness", "trust", 2), ("fairness", "uncertain", 1), ("trust", "uncertain", 1)]
    current = spark.createDataFrame([("s1", "uncertain"), ("s2", "fairness"), ("s3", "uncertain")], "source_id string, current_label string")
    t = C.transitions(rows, current).first()
    assert (t["current_uncertain_count"], t["uncertain_to_concrete"], t["uncertain_no_consensus"], t["uncertain_retained_rate"]) == (2, 1, 1, 0.5)
    assert tuples(C.confusion(rows, current), "current_label", "consensus", "n") == [("fairness", "trust", 1), ("uncertain", "no_consensus", 1), ("uncertain", "trust", 1)]


def test_boundary_conflict_and_missing_rater(spark):
    reviews, key = mini(spark)
    odd = reviews.withColumn("boundary_status", F.when((F.col("blinded_item_id") == "i2") & (F.col("reviewer_id") == "a"), "not_evidence").otherwise(F.col("boundary_status"))).filter("not (blinded_item_id = 'i3' and reviewer_id = 'c')")
    assert tuples(C.consensus_rows(odd, key), "blinded_item_id", "agreement_level", "consensus_mechanism") == [("i1", "unanimous", "trust"), ("i2", "boundary_disputed", "trust")]


def test_kappa_and_alpha_at_their_ends(spark):
    reviews, key = mini(spark)
    rows = C.consensus_rows(reviews, key)
    assert C.fleiss_kappa(rows.limit(0), LABELS).first()["kappa"] is None
    assert C.fleiss_kappa(rows.filter("blinded_item_id = 'i1'"), LABELS).first()["kappa"] == 1.0
    assert C.krippendorff_alpha(reviews.filter("blinded_item_id = 'i1'")).first()["alpha"] == 1.0
    assert C.krippendorff_alpha(reviews.limit(0)).first()["alpha"] is None
    assert C.agreement_summary(rows.limit(0)).filter("rate is not null").count() == 0
    assert tuples(C.per_label_unanimity(rows, ["trust", "safety"]), "label", "consensus_count", "unanimous_rate") == [("safety", 0, None), ("trust", 2, 0.5)]


def lint_of(spark, text, **rules):
    files = spark.createDataFrame([("f", text)], "p string, t string")
    return [(r["line_number"], r["issue_type"], r["detail"]) for r in X.lint(X.text_lines(files, "p", "t"), X.LintRules(**rules)).collect()]


def test_lint_rules(spark):
    assert lint_of(spark, "fine\nan empty phrase here", banned=["empty phrase"]) == [(2, "template_phrase", "empty phrase")]
    assert lint_of(spark, "never good", discouraged=["never"]) == [(1, "negative_framing", "never")]
    assert lint_of(spark, "not red but blue", not_but=("not", "but")) == [(1, "not_this_but_that", "")]
    assert lint_of(spark, "not red, but blue", not_but=("not", "but")) == []
    assert lint_of(spark, "wip wip\nwip wip", status=["wip"]) == [(0, "repeated_status", "4")]
    assert lint_of(spark, "x" * 60) == [] and lint_of(spark, "x" * 61) == [(1, "long_sentence", "")]
    assert lint_of(spark, "aa bb cc", terms=["aa", "bb", "cc"]) == [(1, "technical_term_overload", "")] and lint_of(spark, "aa bb cc: so", terms=["aa", "bb", "cc"]) == []
    assert lint_of(spark, "todo empty", banned=["empty"], internal=["todo"], exempt=["f"]) == [(1, "internal_process_language", "todo")]


def test_lint_gate(spark):
    files = spark.createDataFrame([("f", "\n".join(["x" * 61] * 11))], "p string, t string")
    found = X.lint(X.text_lines(files, "p", "t"), X.LintRules())
    got = {lv: X.gate(found, lv).first()["reasons"] for lv in ("P0", "P1", "P2")}
    assert got == {"P0": "long_sentences", "P1": "long_sentences", "P2": "findings"}
    assert X.gate(found.limit(0), "P0", marker_count=2).first()["reasons"] == "marker_repeated"


@pytest.mark.parametrize("text, want", [("a\n<script>\nx\n</script>\nb", ["a", "b"]), ("<script>x</script>\nb", ["b"]), ("</style>\n<style>\n</style> y\nz", ["</style>", "z"]), ("a\n<script>\nb", ["a"])])
def test_visible_lines(spark, text, want):
    files = spark.createDataFrame([("f", text)], "p string, t string")
    assert [r["raw"] for r in X.visible_lines(X.text_lines(files, "p", "t")).orderBy("line_number").collect()] == want


def test_validation_codes(spark):
    base = dict(run_id="r", reviewer_id="a", blinded_item_id="i", evidence_text="some text", mechanism_label="trust", surface_topic="t", boundary_status="complete", abstain_reason="none", confidence_band="high", evidence_phrase="some")
    cases = [({}, []), ({"run_id": ""}, ["run_id"]), ({"mechanism_label": "x"}, ["mechanism_label:invalid"]), ({"evidence_phrase": "else"}, ["evidence_phrase:not_in_text"]), ({"mechanism_label": "uncertain"}, ["abstain_reason:required_for_uncertain"]), ({"surface_topic": "?"}, ["surface_topic:invalid"]), ({"surface_topic": ""}, [])]
    rows = spark.createDataFrame([base | c for c, _ in cases])
    assert [r["problems"] for r in G.with_problems(rows, list(base), ["t"], LABELS).collect()] == [w for _, w in cases]


def test_threshold_gate_fails_closed(spark):
    metrics = spark.createDataFrame([("m", 0.5), ("w", 0.9)], "metric string, value double")
    limits = spark.createDataFrame([("m", 0.4, None, "block"), ("w", None, 0.5, "warn"), ("gone", 0.1, None, "block")], "metric string, min double, max double, level string")
    gated = G.threshold_gate(metrics, limits)
    assert tuples(gated, "metric", "status") == [("gone", "BLOCKED"), ("m", "PASS"), ("w", "WARN")]
    assert G.gate_status(gated).first()["status"] == "BLOCKED"


def test_leaks(spark):
    rows = spark.createDataFrame([("seen on Alpha",), ("fine",)], "public_text string")
    assert G.header_leaks(rows, ["platform", "text"]) == ["text"]
    assert G.text_leaks(rows, "public_text", ["alpha"]).count() == 1


def test_resume(spark):
    run = R.run_id("mock", "m 1", "a", "v1", 0.0, 7)
    assert run.startswith("a-") and run == R.run_id("mock", "m 1", "a", "v1", 0, 7) != R.run_id("mock", "m 1", "a", "v1", 0.0, 8)
    done = spark.createDataFrame([(run, "i1", [])], "run_id string, blinded_item_id string, problems array<string>")
    assert R.resume_state(done, run) == 1 and R.resume_state(done.limit(0), run) == 0
    for rows, kind, kwargs in ((done, "output_not_empty", {"resume": False}), (done.unionByName(done.withColumn("run_id", F.lit("z"))), "mixed_runs", {}), (done.withColumn("problems", F.array(F.lit("x"))), "invalid_rows", {}), (done.withColumn("run_id", F.lit("z")), "other_run", {}), (done, "invalid_rows", {"corrupt": 1})):
        with pytest.raises(R.UnsafeOutput) as e:
            R.resume_state(rows, run, **kwargs)
        assert e.value.code == kind


def test_retries():
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        R.with_retries(fails, sleep=waits.append)
    assert len(calls) == 4 and waits == [1, 2, 4]

    class Answer(Exception):
        def __init__(self, code):
            self.code = code

    assert [R.retryable(Answer(c)) for c in (429, 500, 599, 400, 404)] == [True, True, True, False, False] and not R.retryable(ValueError())
    with pytest.raises(Answer):
        R.with_retries(lambda: (_ for _ in ()).throw(Answer(404)), sleep=lambda _: pytest.fail("waited"))


def test_json_answers(spark):
    raw = spark.createDataFrame([('```json\n{"a": "x"}\n```',), ('{"a": "y"}',), ("no",), ("[1]",)], "t string")
    assert [(r["a"], r["_corrupt"]) for r in R.parsed_json(raw, "t", "a string").collect()] == [("x", False), ("y", False), (None, True), (None, True)]


def test_normalisation(spark):
    rows = spark.createDataFrame([("",), (" ",), (None,), ("t",)], "topic string")
    out = M.filled(rows, "topic", "none")
    assert out.filter("_filled").count() == 3 and M.whitelist(rows, ["topic", "more"]).collect()[2] == ("", "")
    assert M.counts_of(json.dumps({"a": 1, "b": True, "c": -1, "d": "x"})) == {"a": 1} and M.counts_of("[]") == {}
    one, two = (spark.createDataFrame(x, "key string, n long") for x in ([("a", 3)], [("a", 5), ("b", 1)]))
    assert tuples(M.max_merged(one, two), "key", "n") == [("a", 5), ("b", 1)]


def test_last_review_and_last_parent_count(spark):
    reviews, key = mini(spark)
    rows = reviews.withColumn("review_order", F.lit(1))
    again = rows.filter("blinded_item_id = 'i1' and reviewer_id = 'a'").withColumn("mechanism_label", F.lit("fairness")).withColumn("review_order", F.lit(2))
    got = C.consensus_rows(rows.unionByName(again), key).filter("blinded_item_id = 'i1'").first()
    assert (got["mech_a"], got["agreement_level"]) == ("fairness", "majority")
    assert tuple(C.retest_consistency(rows.unionByName(again), key).first()) == (2, 3, 0.6667)
    parents = spark.createDataFrame([(1, "old", 1), (1, "new words", 2)], "id long, whole string, ord long")
    units = spark.createDataFrame([(1, "new"), (1, "old")], "id long, part string")
    assert tuple(I.match_report(I.linked(units, parents, "id", "part", "whole", order=["ord"])).first()) == (2, 0, 0, 1, 0.5)
    raw = parents.withColumn("raw", F.lit("old raw")).withColumn("whole", F.lit(""))
    assert I.match_report(I.linked(units, raw, "id", "part", "whole", fallback="raw", order=["ord"])).first()["located"] == 1


def test_lookups_take_whole_rows(spark):
    items = spark.createDataFrame([("i1",), ("i2",), ("i3",)], "blinded_item_id string")
    private = spark.createDataFrame([("i1", "s1", "")], "blinded_item_id string, source_id string, note string")
    public = spark.createDataFrame([("i1", "p1", "n1"), ("i2", "p2", "n2")], "blinded_item_id string, source_id string, note string")
    assert tuples(C.source_of(items, private, public), "blinded_item_id", "source_id", "note") == [("i1", "s1", ""), ("i2", "p2", "n2"), ("i3", "", "")]
    texts = spark.createDataFrame([("i1", "the text")], "blinded_item_id string, text string")
    two = private.unionByName(spark.createDataFrame([("i9", "s9", ""), ("i8", "", "")], private.schema))
    assert tuples(C.source_texts(two, texts), "source_id", "text") == [("s1", "the text"), ("s9", "")]
    units = spark.createDataFrame([(1,), (2,)], "id long")
    whole = spark.createDataFrame([(1, "ctx")], "id long, t string")
    assert tuples(U.with_parent_context(units, whole, "id", "t"), "id", "parent_context", "context_available") == [(1, "ctx", "yes"), (2, "", "no")]


def test_actions_go_by_number(spark):
    from corpusloom.operators import insights as N

    found = spark.createDataFrame([(f"INSIGHT_{i:03d}", "t", "m", "high_support", "e") for i in (999, 1000, 101)], "insight_id string, surface_topic string, mechanism_label string, support_level string, first_ids string")
    assert [r["insight_id"] for r in N.actions(found).orderBy("action_id").collect()] == ["INSIGHT_101", "INSIGHT_999", "INSIGHT_1000"]


def test_answers_have_defaults_and_facts(spark):
    raw = spark.createDataFrame([("i1", '{"mechanism_label": "trust", "run_id": "forged"}'), ("i2", '```json\n{"abstain_reason": "other"}\n```'), ("i3", "no"), ("i4", "[]")], "blinded_item_id string, answer string")
    good, bad = R.parsed_answers(raw, "answer", {"run_id": F.lit("r"), "blinded_item_id": F.col("blinded_item_id")}, "now")
    assert tuples(good, "run_id", "blinded_item_id", "mechanism_label", "abstain_reason", "created_at") == [("r", "i1", "trust", "none", "now"), ("r", "i2", "", "other", "now")]
    assert tuples(bad, "blinded_item_id") == [("i3",), ("i4",)]


def test_leak_report_and_files(spark):
    rows = spark.createDataFrame([("seen on Alpha", "blind"), ("fine", "open")], "public_text string, result_type string")
    assert tuples(G.leak_report(rows, "public_text", ["platform", "text"], ["alpha"], "result_type", "blind"), "check", "hits") == [("header", 1), ("result_type", 1), ("text", 1)]
    found = spark.createDataFrame([("b", "P0"), ("a", "P1"), ("b", "P2"), ("c", "P2")], "file_path string, priority string")
    assert [tuple(r) for r in X.file_rollup(found, 2).collect()] == [("b", 2, 1, 0, 1), ("a", 1, 0, 1, 0)]
    files = spark.createDataFrame([("f", "use `a # b` [x](http://y) <b>bold</b> 1 < 2 > 0\n# head")], "p string, t string")
    assert [r["clean"].split() for r in X.text_lines(files, "p", "t").collect()] == [["use", "bold", "1", "<", "2", "0"], ["head"]]
