import json

import pytest

from corpusloom.operators import runs as R
from corpusloom.plans import more
from corpusloom.sources import readers, sinks
from corpusloom.streaming import streams

RULES = [("x", ["foo"])]


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿feedback_id,platform,window_tag,raw_text\n1,p,,\"two\nlines \"\"q\"\"\"\n".encode())
    rows = readers.read_csv(spark, str(path), readers.FEEDBACK)
    assert [tuple(r) for r in rows.collect()] == [("1", "p", "", 'two\nlines "q"')]
    sinks.write_csv(rows, str(tmp_path / "out"), ["raw_text", "absent"], single=True)
    assert readers.read_csv(spark, str(tmp_path / "out"), readers.strings("raw_text", "absent")).first() == ('two\nlines "q"', "")
    assert readers.read_csv(spark, str(tmp_path / "none"), readers.FEEDBACK, missing_ok=True).count() == 0


def test_json_and_yaml(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"feedback_id": "1"}\n\n{bad\n')
    rows = readers.read_jsonl(spark, str(path), readers.FEEDBACK).cache()
    assert rows.count() == 2 and rows.filter("_corrupt_record is not null").count() == 1
    assert readers.read_jsonl(spark, str(tmp_path / "none"), readers.FEEDBACK).count() == 0
    assert readers.json_object("[1]") == readers.json_object("bad") == {} and readers.json_object('{"a": 1}') == {"a": 1}
    text = "# c\nsize: 3\nname: 'x y'\nurl: http://a/b\nlist:\n  - a\n  # c\n  - 2\nlast: true\n"
    want = {"size": 3, "name": "x y", "url": "http://a/b", "list": ["a", 2], "last": True}
    assert readers._settings(text) == want == readers.simple_yaml(text)
    assert readers.simple_yaml("# c\nsize: 3\nname: 'x y'\nlist:\n  - a\n  - 2\n") == {"size": 3, "name": "x y", "list": ["a", 2]}
    assert readers.with_required_terms({"t": ["a"]}, "t", ["b", "a"]) == {"t": ["a", "b"]}


def test_text_files(spark, tmp_path):
    for name in ("a.md", "sub/b.md", "skip/c.md"):
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_text(name)
    rows = readers.text_files(spark, str(tmp_path / "root"), "*.md", ["skip"])
    assert sorted((r["file_path"], r["text"]) for r in rows.collect()) == [("a.md", "a.md"), ("sub/b.md", "sub/b.md")]
    for name in ("x y.md", "root/x y.md", "a+b.md"):
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_text(name)
    again = readers.text_files(spark, str(tmp_path / "root"), ["*.md", "*.txt"], ["skip", "sub"])
    assert sorted((r["file_path"], r["text"]) for r in again.collect()) == [(n, n) for n in ("a+b.md", "a.md", "root/x y.md", "x y.md")]
    assert readers.file_digests(spark, str(tmp_path / "root/a.md")).first()["bytes"] == 4


def test_candidates(spark):
    assert readers.candidates(spark, ["p"], ["k", "l"], 1).count() == 2
    with pytest.raises(NotImplementedError):
        readers.candidates(spark, ["p"], ["k"], dry_run=False)


def test_append_is_guarded(spark, tmp_path):
    rows = spark.createDataFrame([("r", "i1", []), ("r", "i2", ["bad"])], "run_id string, blinded_item_id string, problems array<string>")
    out, dead = str(tmp_path / "out"), str(tmp_path / "dead")
    sinks.append_run(rows, out, "r", dead)
    assert spark.read.json(out).count() == 1 and spark.read.json(dead).first()["problems"] == "bad"
    with pytest.raises(R.UnsafeOutput):
        sinks.append_run(rows, out, "r", dead)
    sinks.append_run(rows, out, "r", dead, resume=True)
    assert spark.read.json(out).count() == 1
    more = spark.createDataFrame([("r", "i1", []), ("r", "i3", []), ("r", "i3", [])], rows.schema)
    sinks.append_run(more, out, "r", dead, resume=True)
    assert sorted(r["blinded_item_id"] for r in spark.read.json(out).collect()) == ["i1", "i3"]
    (tmp_path / "out" / "run=r" / "more.json").write_text("{cut off\n")
    with pytest.raises(R.UnsafeOutput) as e:
        sinks.append_run(more, out, "r", dead, resume=True)
    assert e.value.code == "invalid_rows"


def test_appended_run_derives_its_reviews_once(spark, monkeypatch):
    given = []
    append = sinks.append_run
    monkeypatch.setattr(more.sinks, "append_run", lambda rows, *a, **k: (given.append(rows), append(rows, *a, **k)))
    assert more.appended_run(spark, "/root/testdata/sf0.001").count()
    assert len(given) == 2
    for rows in given:
        for part in R.split_valid(rows):
            assert "sha2" not in part._jdf.queryExecution().optimizedPlan().toString()


def test_reports_and_manifest(spark):
    rows = spark.createDataFrame([("a|<b>", 1)], "k string, n long")
    assert "a\\|<b>" in sinks.markdown_report("T", {"s": rows}) and "a|&lt;b&gt;" in sinks.html_report("T", {"s": rows})
    assert json.loads(sinks.json_document({"s": rows, "v": 1})) == {"s": [{"k": "a|<b>", "n": 1}], "v": 1}
    many = spark.range(50).selectExpr("id", "cast(id as string) as s")
    one, two = (sinks.manifest({"t": many.repartition(k)}, "2020", "1") for k in (1, 5))
    assert one == two and one["files"]["t"]["rows"] == 50
    assert sinks.percent(0.1234) == "12.3%"
    with pytest.raises(ValueError):
        sinks.small_rows(many, 10)


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    docs = spark.createDataFrame([(1, "foo in the first unit. plain second unit"), (2, " ")], "id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = streams.feedback_stream(spark, str(tmp_path / "in"), docs.schema)
    streams.write_units(stream, "id", "text", RULES, RULES, str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("evidence_id", "surface_topic")
    want = streams.labelled_units(docs, "id", "text", RULES, RULES).select("evidence_id", "surface_topic")
    assert sorted(got.collect()) == sorted(want.collect()) and spark.read.parquet(str(tmp_path / "dead")).count() == 1
