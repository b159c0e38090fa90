import json

from corpusloom import cli


def test_demo_passes_and_repeats(spark, tmp_path):
    (tmp_path / "in.csv").write_text('feedback_id,platform,window_tag,raw_text\n1,p,w,"The fox is quick. The fox is not slow."\n2,q,w,A fox again here\n')
    (tmp_path / "rules.yaml").write_text("topic_animal:\n  - fox\nmechanism_trust:\n  - fox\n")
    for out in ("one", "two"):
        assert cli.main(["demo", "--input", str(tmp_path / "in.csv"), "--output", str(tmp_path / out), "--rules", str(tmp_path / "rules.yaml")], spark) == 0
    one, two = ((tmp_path / out / "manifest.json").read_text() for out in ("one", "two"))
    assert one == two
    found = json.loads((tmp_path / "one" / "insights.json").read_text())["insights"]
    assert [(i["surface_topic"], i["evidence_count"], i["platforms"]) for i in found] == [("animal", 3, "p,q")]


def test_summary(spark, tmp_path):
    (tmp_path / "s.csv").write_text("sample_id,platform_source,platform_sequence,window_tag,theme_bucket,reply_type,date,public_text,migration_status\ns1,p,1,w,t,r,,Some text here,m\ns2,p,2,w,t,r,,Other,m\n")
    (tmp_path / "e.csv").write_text("evidence_id,sample_id,platform_source,unit_index,unit_text,surface_topic,mechanism_label,label_source,review_status,analysis_inclusion_status\ne1,s1,p,1,text here,t,trust,x,y,z\ne2,s9,p,1,lost,t,,x,y,z\n")
    assert cli.main(["summarise", "--samples", str(tmp_path / "s.csv"), "--evidence", str(tmp_path / "e.csv"), "--output", str(tmp_path / "out")], spark) == 0
    out = json.loads((tmp_path / "out" / "analysis_summary.json").read_text())
    assert out["integrity"][0] == {"n": 2, "orphans": 1, "mismatches": 0, "located": 1, "match_rate": 0.5}
    assert out["blanks"][6] == {"table_name": "samples", "column": "date", "blanks": 2, "n": 2}


def test_lint_exit_codes(spark, tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "a.md").write_text("plain\nhollow words\n")
    (tmp_path / "rules.yaml").write_text("banned_phrases:\n  - hollow words\n")
    args = ["lint", "--root", str(tmp_path / "root")]
    assert cli.main(args, spark) == 0 and cli.main([*args, "--rules", str(tmp_path / "rules.yaml")], spark) == 1


def test_sample_to_consensus(spark, tmp_path):
    head = "evidence_id,sample_id,platform_source,unit_index,unit_text,surface_topic,mechanism_label,label_source,review_status,analysis_inclusion_status\n"
    (tmp_path / "e.csv").write_text(head + "".join(f"e{i},s{i % 3},p{i % 2},1,the fox number {i} and a {'crow' if i % 4 == 0 else 'cat'} here,,trust,x,y,z\n" for i in range(20)))
    (tmp_path / "s.csv").write_text("sample_id,platform_source,platform_sequence,window_tag,theme_bucket,reply_type,date,public_text,migration_status,extra\n" + "".join(f"s{i},p,1,w,t,r,,whole text {i},m,x\n" for i in range(2)))
    (tmp_path / "rules.yaml").write_text("topic_animal:\n  - fox\nmechanism_trust:\n  - cat\nmechanism_fairness:\n  - crow\n")
    at = lambda name: str(tmp_path / name)
    run = lambda *args: cli.main(list(args), spark)
    assert run("normalise", "--samples", at("s.csv"), "--evidence", at("e.csv"), "--output", at("norm"), "--generated-at", "2024") == 0
    manifest = json.loads((tmp_path / "norm" / "manifest.json").read_text())
    assert manifest["counters"] == {"samples": 2, "evidence": 20, "topics_filled": 20} and manifest["files"]["samples"]["columns"][-1] == "migration_status"
    assert run("sample", "--samples", at("s.csv"), "--evidence", at("e.csv"), "--output", at("smp"), "--size", "12", "--retests", "3") == 0
    public = at("smp/public")
    assert spark.read.csv(public, header=True).count() == 15 and run("verify", "--public", public, "--names", "zeta") == 0 and run("verify", "--public", public, "--names", "fox") == 1
    assert {r["context_available"] for r in spark.read.csv(public, header=True).collect()} == {"yes", "no"}
    review = ["review", "--public", public, "--output", at("rev"), "--rules", at("rules.yaml")]
    assert run(*review, "--max-items", "4") == 0
    assert spark.read.json(at("rev/reviews")).count() == 12
    assert run(*review, "--resume") == 0
    reviews = spark.read.json(at("rev/reviews"))
    assert reviews.count() == 45 == reviews.select("reviewer_id", "blinded_item_id").distinct().count()
    folder = next((tmp_path / "rev" / "reviews").glob("run=*"))
    args = ["--reviews", str(folder), "--private", at("smp/private"), "--public", public]
    assert run("consensus", *args, "--output", at("cons"), "--labels", "trust,fairness,uncertain") == 0
    out = json.loads((tmp_path / "cons" / "consensus.json").read_text())
    assert out["agreement"][0]["denominator"] == 12 and out["retest"][0]["denominator"] == 9 and "kappa" in (tmp_path / "cons" / "consensus.md").read_text()
    assert run("disagreements", *args, "--output", at("dis")) == 0
    assert run("brief", "--samples", at("s.csv"), "--evidence", at("e.csv"), "--output", at("brief")) == 0
    assert json.loads((tmp_path / "brief" / "brief.json").read_text())["counts"]["evidence"] == 20
