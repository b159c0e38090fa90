"""The ten operators on small tables: against brute force, exact round trips, held-out accuracy, and odd inputs."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common, exact_dedup, gru, language_id, learned_rules, license_scan, lm_java, lm_score, mixing, near_dedup, quality_rules, rule_ensemble, toxicity
from corpusloom.llm.components import components

SF = "/root/testdata/sf0.001"
VOCAB, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
#: Nulls in every column, empty and blank texts, repeated rows, ties, a long text, a long word; columns that operators use names of.
ODD = [(1, "same text here", "en"), (1, "same text here", "en"), (2, "same text here", None), (3, "", "de"), (4, None, "fr"), (None, "no id", "en"), (None, None, None), (5, " \n\t ", "es"), (6, "wort " * 30_000, "de"), (7, "x" * 5_000, "en"), (8, "é中😀 \x1c end", "fr")]


def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    clash = ["rep", "band", "key", "kept", "score", "_id", "_text", "n_words", "token", "row", "source", "word"]
    return rows.select("*", *[F.lit("x").alias(c) for c in clash])


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_odd_and_empty_tables_go_through_every_operator(spark):
    docs, none, no_labels = odd(spark), empty(spark), labels_of(spark)
    some = labels_of(spark, [(1, 1, 0), (2, None, 1), (None, 0, 0), (6, 0, 1)])
    lang = lambda d: d.select("doc_id", F.col("lang").alias("domain"))
    runs = [
        lambda d, lb: rule_ensemble.quality_scores(d, lb),
        lambda d, lb: bpe.round_trip(d, VOCAB, PATTERN),
        lambda d, lb: mixing.mixed_rates(d, lang(d)),
        lambda d, lb: license_scan.license_scan(d),
        lambda d, lb: language_id.languages(d),
        lambda d, lb: quality_rules.quality_rules(d, lb),
        lambda d, lb: exact_dedup.exact_groups(d),
        lambda d, lb: lm_score.lm_scores(d),
        lambda d, lb: near_dedup.near_components(d),
        lambda d, lb: toxicity.toxicity(d, lb),
    ]
    for i, run in enumerate(runs, 1):
        out = run(docs, some).collect()
        assert len(out) == len(ODD), i
        assert sum(r["doc_id"] is None for r in out) == 2, i
        assert run(none, no_labels).count() == 0, i


# Exact duplicates


def by_hand(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i is None or i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("first, limit", [(1, 1 << 20), (64, 1 << 20), (2, 0)])
def test_exact_groups(spark, first, limit):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "ab", "abc" * 40, "abc" * 40 + "d", "é", "", None]) if i % 3 else "q" * rng.randrange(300)) for i in range(120)]
    frame = spark.createDataFrame([*rows, *((i, t) for i, t, _ in ODD)], "doc_id long, text string")
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(frame, first, limit).collect()), key=repr)
    assert got == by_hand([*rows, *ODD])


def test_exact_dedup_keeps_rows_whole(spark):
    out = exact_dedup.exact_dedup(odd(spark)).select("doc_id", "text", "source").collect()
    assert sorted(r["doc_id"] or 0 for r in out) == [0, 0, 2, 4, 5, 6, 7, 8]


# BPE


def test_bpe_equals_the_library(spark):
    own = bpe.Bpe(VOCAB, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", "a", "  x  y\n\n z\t\t", "ab" * 500, "a" * 301, "aaab" * 70, "日本語" * 60, "\x1c a\x85b\xa0c", "don't I'LL", "é" * 99, "x" * 96, "y" * 97]
    texts += ["".join(chr(rng.randrange(32, 1200)) for _ in range(200)) for _ in range(20)]
    texts += [r["text"] for r in documents(spark).collect()]
    for most in (bpe.KEPT, 10):
        own.most = most
        ids = own.encode(texts)
        assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [library.encode_ordinary(t) for t in texts]
        assert own.decode(ids) == [t.encode() for t in texts]


def test_bpe_frames(spark):
    docs = documents(spark)
    ids = bpe.encoded(docs, VOCAB, PATTERN)
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decoded(ids, VOCAB, PATTERN).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}
    lean, full = (sorted(map(tuple, bpe.round_trip(docs, VOCAB, PATTERN, lean).collect())) for lean in (True, False))
    assert lean == full


# Near duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_by_hand(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            s = len(sets[a] & sets[b])
            if s and 100 * s >= 75 * (len(sets[a]) + len(sets[b]) - s):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows():
    rng, words, rows = random.Random(5), [f"w{i}" for i in range(400)], []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 30, 120]))]
        for _ in range(rng.choice([1, 2, 8, 25])):
            copy = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            rows.append((len(rows) * 7 % 997, " ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    return rows


def test_near_components_equal_brute_force(spark):
    rows = near_rows() + [(2000, ""), (2001, None), (2002, "one two"), (2003, "ONE two"), (2004, " ")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_by_hand(rows)


def test_repeated_ids_keep_their_own_texts(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    rows = spark.createDataFrame([(2, a), (2, b), (1, a)], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_components(rows).collect())) == [(1, 2, 1, True), (2, 2, 1, False), (2, 3, 2, True)]
    assert sorted(map(tuple, near_dedup.near_dedup(rows).collect())) == [(1, a), (2, b)]
    assert sorted(map(tuple, exact_dedup.exact_dedup(rows).collect())) == [(2, a), (2, b)]
    rows = spark.createDataFrame([(1, a), (1, b), (2, a), (1, a)], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.exact_dedup(rows).collect())) == [(1, b), (2, a)]
    assert sorted(map(tuple, near_dedup.near_dedup(rows).collect())) == [(1, a), (1, b)]


def test_stages_take_odd_and_empty_tables(spark):
    some = labels_of(spark, [(1, 1, 0), (2, 0, 1), (6, 0, 1)])
    clash = odd(spark).select("*", *[F.lit("x").alias(c) for c in ("_tokens", "_p", "_n", "_row", "_text_sha256", "node", "n", "_no")])
    docs = clash.select("doc_id", "text", "lang", *clash.columns[3:])
    lang = lambda d: d.select("doc_id", F.col("lang").alias("domain"))
    stages = {
        "rules": (lambda d: quality_rules.keep_good(d, some), 0),
        "exact": (exact_dedup.exact_dedup, 8),
        "near": (near_dedup.near_dedup, 10),  # ids 3 to 5 and the second 1 have no equal; 2 is near 1
        "mix": (lambda d: mixing.mix_documents(d, lang(d), low=0.0), None),
    }
    for name, (stage, n) in stages.items():
        out = stage(docs)
        got = out.collect()
        assert out.columns == docs.columns, name
        assert n is None or len(got) <= n, name
        assert {r["doc_id"] for r in got} <= {r[0] for r in ODD}, name
        assert stage(docs.limit(0)).count() == 0, name


def test_near_components_equal_brute_force_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(docs).collect()}
    assert got == components_by_hand([tuple(r) for r in docs.collect()])


def test_template_copies_with_words_of_their_own(spark):
    """Members of one bucket that aren't linked, though each is near the limit."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(40), 5):
            words[k * 5] = f"own{i}x{k}"
        rows.append((i, " ".join(words[: rng.choice([150, 180, 200])])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_by_hand(rows)


def test_near_dedup_keeps_one_of_each(spark):
    rows = near_rows()
    out = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in out) == sorted({c for _, c in components_by_hand(rows).values()})


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    for n in (9, 100, 3000):
        same = []
        for _ in range(60):
            both, x, y = (np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64) * np.uint64(2)) for k in (3 * n, n, n))
            same.append((near_dedup.sketch(np.union1d(both, x)) == near_dedup.sketch(np.union1d(both, y))).mean())
        assert abs(np.mean(same) - 0.6) < 0.05


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


# Quality


def counts_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = list(zip(w, w[1:], w[2:], strict=False))
    often, inside, seen, dups = Counter(tri), set(), set(), 0
    for i, t in enumerate(tri):
        if often[t] > 1:
            inside |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(inside)


def test_quality_counts(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()] + [(9000 + i, t) for i, t in enumerate(["", None, "a b a b a b", "x x x x", "l\n\nl\nl \nl", "#*$ %&|<>", "a b \x1c"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(frame, labels(spark)).collect()}
    for i, t in rows:
        want = counts_by_hand(t)
        assert tuple(out[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert out[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (out[i]["base_failed"] and out[i]["kept"])
    kept = quality_rules.keep_good(frame, labels(spark)).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == sorted(i for i, r in out.items() if r["kept"])


def test_verdicts_and_scores_by_hand(spark):
    """The CASE of the list, and the score's expression, against the same rules in numpy."""
    docs, marks = documents(spark), labels(spark)
    names = quality_rules.FEATURES
    stats = {r["doc_id"]: r for r in quality_rules.with_features(quality_rules.with_base(docs, ["doc_id"]), ["doc_id"]).collect()}
    x = {k: np.array([stats[i][k] or 0.0 for i in sorted(stats)], float) for k in [*names, "n_words", "n_repeat_words"]}
    failed = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
    rules = quality_rules.learn(docs, marks)
    first = np.zeros(len(stats), int)
    for k, r in reversed(list(enumerate(rules, 1))):
        first[learned_rules.met(r, x, len(stats))] = k
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, marks).collect()}
    assert [out[i]["rule_no"] for i in sorted(stats)] == first.tolist()
    assert [out[i]["kept"] for i in sorted(stats)] == (~failed & (first == 0)).tolist()
    weighted, b = rule_ensemble.fit(docs, marks)
    want = b + sum(w * learned_rules.met(r, x, len(stats)) for r, w in weighted)
    got = {r["doc_id"]: r["score"] for r in rule_ensemble.quality_scores(docs, marks).collect()}
    assert np.allclose([got[i] for i in sorted(stats)], 1 / (1 + np.exp(-want)), atol=1e-9) and weighted


def test_quality_rules_have_no_python_on_executors(spark):
    plan = quality_rules.quality_rules(documents(spark), labels(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rules_are_learned():
    rng = np.random.default_rng(4)
    x = {"a": rng.random(900), "b": rng.random(900)}
    y = (~((x["a"] > 0.7) & (x["b"] <= 0.4))).astype(int)
    rules = learned_rules.decision_list(x, y)
    verdict = np.ones(900, int)
    for r in reversed(rules):
        verdict[learned_rules.met(r, x, 900)] = 0
    assert (verdict == y).mean() > 0.97
    weighted, b = learned_rules.ensemble(x, y)
    score = b + sum(w * learned_rules.met(r, x, 900) for r, w in weighted)
    assert ((score > 0) == y).mean() > 0.95
    assert learned_rules.ensemble(x, np.ones(900, int))[0] == [] and learned_rules.decision_list(x, np.ones(900, int)) == []


def test_quality_scores_on_held_out_rows(spark):
    docs, marks = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = rule_ensemble.quality_scores(docs, marks).join(marks, "doc_id").filter("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9


# Languages, toxicity


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(8)
    k, steps, n = 3, 5, 4
    lengths = np.array([5, 3, 1, 4])
    x, y = (rng.normal(size=(steps, n, 3 * k)).astype(np.float32) for _ in range(2))
    uf, ub = (rng.normal(size=(k, 3 * k)).astype(np.float32) * 0.5 for _ in range(2))
    d = rng.normal(size=(steps, n, 2 * k)).astype(np.float32) * gru.padded(lengths, steps)[:, :, None]

    def loss():
        return float((gru.both_ways(x, y, lengths, uf, ub).astype(np.float64) * d).sum())

    tapes = ([], [])
    gru.both_ways(x, y, lengths, uf, ub, tapes)
    for what, grad in zip((x, y, uf, ub), gru.both_ways_back(d, lengths, uf, ub, tapes), strict=True):
        for at in [tuple(rng.integers(s) for s in what.shape) for _ in range(6)]:
            old, e = what[at], np.float32(1e-2)
            what[at] = old + e
            up = loss()
            what[at] = old - e
            down = loss()
            what[at] = old
            assert abs((up - down) / (2 * e) - grad[at]) < 2e-2


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.95
    odd_rows = spark.createDataFrame([(1, None), (2, "12 34 !?"), (3, "")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.languages(odd_rows).collect()} == {"und"}


def test_language_of_positions():
    net = language_id.Net(["a", "b"])
    net.train([[b"xyx yyx xxy "], [b"pqp qqp ppq "]], steps=60, batch=16)
    out = net.positions("xyx yxy pqp ppq qpq")
    assert len(out) == 19 and [p[0] for p in out[:6]] == ["a"] * 6 and [p[0] for p in out[-6:]] == ["b"] * 6


def test_positions_read_across_words_and_segments():
    rng = np.random.default_rng(4)
    net = language_id.Net(["a", "b", "c"], seed=9)
    for v in net.w.values():
        v *= 3
    for n in (1, 5, 191, 192, 193, 208, 209, 900):
        data = bytes(rng.integers(32, 120, n).astype(np.uint8))
        text, first, size, lo, hi = language_id.segments(np.array([n]))
        assert (hi - lo).sum() == n and (first + lo == np.arange(len(lo)) * language_id.SPAN).all()
        # a text of one segment equals the network of the gru module
        if len(lo) == 1:
            d = np.frombuffer(data, np.uint8)[:, None]
            h = gru.both_ways(net.w["xf"][d], net.w["xb"][d], np.array([n]), net.w["uf"], net.w["ub"])
            y = (h @ net.w["o"] + net.w["b"])[:, 0].astype(float)
            y -= np.log(np.exp(y).sum(1, keepdims=True))
            assert np.allclose(net.sums([data])[0], y.sum(0), rtol=1e-3, atol=1e-2)
    # another word nearby changes a position
    probs = [net.positions(t)[4][1] for t in ("word alpha", "xqzw alpha")]
    assert abs(probs[0] - probs[1]) > 1e-6
    # texts together come out as texts alone
    texts = [bytes(rng.integers(32, 120, n).astype(np.uint8)) for n in (3, 400, 0, 1000, 20)]
    assert np.allclose(net.sums(texts), [net.sums([t])[0] for t in texts], rtol=1e-4, atol=1e-2)


def test_rare_languages_are_learned(spark):
    rows = [(i, "plain words of the common kind here", "en") for i in range(3000)] + [(9000 + i, f"zwrk{i} brzt qwvx mrzk", "zz") for i in range(4)]
    out = language_id.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("doc_id >= 9000").collect()
    assert {r["lang_pred"] for r in out} == {"zz"}


def test_windows_cover_every_word():
    for n in (1, 31, 32, 33, 48, 49, 500):
        at = toxicity.windows(n)
        assert at[0] == 0 and at[-1] + toxicity.WINDOW >= n and all(b - a == toxicity.STRIDE for a, b in zip(at, at[1:], strict=False))
    assert toxicity.windows(0) == []


def test_toxicity_past_byte_64_of_unspaced_text():
    word = "\u4f60\u597d" * 30 + "\u00a0kretin,\u3000" + "z" * 70
    assert toxicity.split("a b") == [b"a", b"b"]
    got = b"".join(toxicity.split(word))
    assert all(len(w) <= 64 for w in toxicity.split(word)) and b"kretin," in toxicity.split(word)
    assert all(word.encode()[i : i + 3] in got for i in range(170)) and got.endswith(b"z" * 8)
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(40)]
    filler = lambda n: [str(w) for w in rng.choice(plain, n)]
    docs = [(filler(20), 0) for _ in range(60)] + [([*filler(12), "kretin", *filler(7)], 1) for _ in range(60)]
    net = toxicity.Net()
    net.train([toxicity.split(" ".join(w)) for w, _ in docs], np.array([y for _, y in docs]), steps=150)
    bad, good = [*filler(30), "kretin", *filler(10)], filler(41)
    scorer = toxicity._Scorer(net)
    for mark in ("\u00a0", "\u3000", ","):
        scores = scorer.score([mark.join(bad), mark.join(good)])
        assert scores[0] > toxicity.THRESHOLD > scores[1]
    # without any break, pieces carry the passage: text before it is far over 64 bytes
    joined = scorer.score(["".join(bad), "".join(good)])
    assert joined[0] > joined[1]


def test_toxicity_on_held_out_rows(spark):
    docs, marks = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.toxicity(docs, marks).join(marks, "doc_id").filter("held_out").collect()
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    alarms = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(caught) / len(caught) > 0.8 and sum(alarms) / len(alarms) < 0.03


def test_training_is_the_same_on_any_number_of_threads():
    code = """
import numpy as np
from corpusloom.llm import gru, toxicity
rng = np.random.default_rng(3)
words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(60)]
docs = [[w.encode() for w in rng.choice(words, 60)] + ([b"kretin"] if i % 2 else []) for i in range(80)]
net = toxicity.Net()
net.train(docs, np.arange(80) % 2, steps=20)
print(sum(float(np.abs(v).sum()) for v in net.w.values()).hex())
"""
    out = {subprocess.run([sys.executable, "-c", code], env={**os.environ, "OPENBLAS_NUM_THREADS": n, "OMP_NUM_THREADS": n}, capture_output=True, text=True, check=True).stdout for n in ("1", "4")}
    assert len(out) == 1 and out != {""}


def test_long_texts_are_sampled_from_end_to_end(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    rows = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["t"] for r in rows.select("doc_id", common.stretches(F.col("text"), 120, 6).alias("t")).collect()}
    assert got[2] == "short" and got[3] is None
    parts = got[1].split("\n")
    assert len(parts) == 6 and all(len(p) == 20 and p in text for p in parts) and parts[0] == text[:20] and parts[-1] == text[-20:]


# Language model


def test_base_scores_and_the_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9001, None), (9002, "zzz unseen-word")], "doc_id long, text string"))
    out = {r["doc_id"]: r for r in lm_score.lm_scores(docs).collect()}
    words = {r["doc_id"]: lm_score.tokens(r["text"]) for r in docs.collect()}
    c = Counter(w for i, t in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in words.items():
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert abs(out[i]["base_score"] - want) < 1e-6 * abs(want) and out[i]["n_known"] == sum(c[w] > 0 for w in t) and out[i]["n_tokens"] == len(t) and out[i]["train_tokens"] == n
    held = [r for r in out.values() if r["held_out"]]
    assert all(r["score"] < 0 for r in held)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_beats_the_base_and_ignores_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    one, two = ({r["doc_id"]: r["score"] for r in lm_score.lm_scores(docs.repartition(n)).collect()} for n in (3, 13))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert all(abs(one[i] - two[i]) < 1e-6 * abs(one[i]) for i in one)


def small_code():
    words = sorted([b"", b"a", b"bb", b"ccc", b"dd", b"e"])
    tree = lm_score.Tree(words, np.array([4.0, 9, 2, 5, 1, 3, 2]), 0.0)
    rng = np.random.default_rng(7)
    tables = [lm_score.packed(rng.integers(0, 9, (1 << b, 2))) for b in lm_score.CODE_BITS]
    mixer = lm_score.Mixer(lm_score.CODE_GATES, lm_score.CODE_START)
    mixer.weights += rng.normal(size=mixer.weights.shape).astype(np.float32) * 0.1
    return lm_score.Code(tree, tables, mixer)


def test_code_is_a_distribution_over_next_words():
    """Over all symbols of the dictionary, the escape with them, the probabilities of the next one add up to one."""
    code = small_code()
    for before in ([], [b"a"], [b"bb", b"unknown", b"a"], [b"a", b"a"] * 30):
        symbols = [*code.tree.words, b"another"]
        logs = code.log10([[*before, w] for w in symbols])
        base = code.log10([before])[0] if before else 0.0
        assert abs((10 ** (logs - base)).sum() - 1) < 1e-3


def test_history_counts_by_hand():
    code = small_code()
    texts = [[b"a", b"bb", b"a", b"x", b"a", b""] * 20, [b"ccc"], [b"dd", b"a"]]
    e = lm_score.events(code.tree, texts)
    seen = Counter()
    order = sorted(range(len(e.bit)), key=lambda i: i)  # each text's events are in the order of the text
    for i in order:
        key = (int(e.text[i]), int(e.node[i]))
        assert (e.before[0][i], e.before[1][i]) == (seen[key, 0], seen[key, 1])
        seen[key, int(e.bit[i])] += 1
    tokens = sum(len(t) for t in texts)
    assert tokens <= len(e.bit) and e.ends[-1] == len(e.bit)


def test_tails_below_small_nodes():
    words = [bytes([97 + i]) for i in range(20)]
    weights = np.arange(1.0, 22)
    for share in (0.0, 0.1, 1.1):
        tree = lm_score.Tree(words, weights, share)
        p = []
        for i in range(21):
            path = tree.path[tree.at[i] : tree.at[i + 1]]
            n = [(tree.n0[s >> 1], tree.n1[s >> 1]) for s in path]
            p.append(float(np.prod([x[s & 1] / sum(x) for x, s in zip(n, path, strict=True)])) * 10 ** tree.tail[i])
        assert np.allclose(p, weights / weights.sum(), rtol=1e-5)


def test_mixer_by_hand():
    """A round's sums and step against plain loops."""
    rng = np.random.default_rng(5)
    m = lm_score.Mixer(3, (0.5, 0.5))
    x, bit, gate = rng.normal(size=(2, 500)).astype(np.float32), (rng.random(500) < 0.5).astype(np.float32), rng.integers(0, 3, 500).astype(np.uint8)
    sums = lm_score.Sums.none(3, 2)
    m.study(sums, x, bit, gate)
    slope, curve = np.zeros((3, 2)), np.zeros((3, 2, 2))
    for i in range(500):
        z = 0.5 * x[:, i].sum()
        p = 1 / (1 + math.exp(-z))
        slope[gate[i]] += (bit[i] - p) * x[:, i]
        curve[gate[i]] += p * (1 - p) * np.outer(x[:, i], x[:, i])
    assert np.allclose(sums.slope, slope, atol=1e-3) and np.allclose(sums.curve, curve, atol=1e-3)
    again = lm_score.Sums.none(3, 2)
    again.add(sums.flat()), again.add(sums.flat())
    assert np.allclose(again.slope, 2 * slope, atol=1e-3) and again.ones.sum() == 2 * bit.sum() and (again.ones + again.zeros).sum() == 1000
    before = sum(np.log(np.where(bit, q, 1 - q)).sum() for q in [1 / (1 + np.exp(-m.mixed(x, gate)))])
    m.learn(sums)
    after = sum(np.log(np.where(bit, q, 1 - q)).sum() for q in [1 / (1 + np.exp(-m.mixed(x, gate)))])
    assert after > before


def test_spelling_is_a_distribution_over_words():
    """Probabilities of all words of one byte, and of longer ones by their first byte's, add up to one at most."""
    words = [b"ab", b"abc", b"b", b""]
    table = np.zeros((lm_score.SPELL_FIRST[-1], 2), np.int64)
    for slots, bit in lm_score._letters(words):
        np.add.at(table.reshape(-1), (slots * 2 + bit).ravel(), 1)
    s = lm_score.Spelling(lm_score.packed(table), lm_score.Mixer(lm_score.SPELL_GATES, (0.2,) * 6))
    first = 10 ** s.log10([bytes([i]) for i in range(256) if i != 32] + [b""])
    assert first.sum() <= 1.0 + 1e-4
    # whatever follows "a", the next byte's probabilities add up
    nxt = np.array([10 ** s.log10([b"a" + bytes([i])])[0] / 10 ** s.log10([b"a" + bytes([i]) + b"z"])[0] for i in (98, 99)])
    assert (nxt > 0).all()
    assert s.log10([b"ab"])[0] > s.log10([b"qz"])[0]


def test_packed_counts_keep_their_share():
    got = lm_score.unpacked(lm_score.packed(np.array([[0, 0], [3, 65535], [1_000_000, 250_000]])))
    assert got[0][1] == 3 and got[1][1] == 65535 and abs(got[0][2] / got[1][2] - 4) < 1e-3


# Mixing, licences


def test_rates_meet_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = docs.select("doc_id", F.col("lang").alias("domain"))
    model = mixing.learn(docs, known)
    rows = mixing.with_posteriors(docs.select("doc_id", "text"), model)
    for weights, kwargs in (({"en": 1, "de": 1, "fr": 1, "es": 1}, {}), (None, {"power": 0.5, "low": 1.0, "whole": True})):
        mix = mixing.solve(rows, model.domains, weights, **kwargs)
        for d, want in mix.targets.items():
            assert abs(mix.totals[d] - want) < 0.01 * sum(mix.targets.values())
    rates = mixing.mixed_rates(docs, known, {"en": 1, "de": 1, "fr": 1, "es": 1}).agg(F.min("rate"), F.sum(F.col("rate") * F.col("n_tokens")), F.sum("n_tokens")).first()
    assert rates[0] >= 0 and abs(rates[1] / rates[2] - 1) < 0.02
    more = mixing.mix_documents(docs, known)
    assert more.select("doc_id").distinct().count() == docs.count() < more.count() and more.columns == docs.columns


def test_rates_meet_targets_of_rare_domains(spark):
    for rare in (5, 1):  # thousandths of the tokens
        counts = [500, 300, 200 - rare, rare]
        rows = [(100, [float(i == k) for i in range(4)]) for k, n in enumerate(counts) for _ in range(n)]
        table = spark.createDataFrame(rows, "_tokens long, _p array<double>")
        for kwargs in ({}, {"low": 1.0, "whole": True}):
            mix = mixing.solve(table, list("abcd"), dict.fromkeys("abcd", 1.0), **kwargs)
            assert mix.error < mixing.CLOSE and all(abs(mix.totals[d] / t - 1) < 1e-3 for d, t in mix.targets.items())
    soft = spark.createDataFrame([(100, [0.9, 0.1]), (100, [0.6, 0.4]), (100, [0.99, 0.01])] * 20 + [(3, [0.05, 0.95])], "_tokens long, _p array<double>")
    mix = mixing.solve(soft, ["a", "b"], {"a": 1.0, "b": 1.0})
    assert mix.error < mixing.CLOSE and soft.select(F.min(mix.rate(F.col("_p")))).first()[0] >= 0
    few = spark.createDataFrame([(100, [0.6, 0.4]), (100, [0.9, 0.1])], "_tokens long, _p array<double>")
    with pytest.warns(UserWarning, match="miss their targets"):
        assert mixing.solve(few, ["a", "b"], {"a": 0.0, "b": 1.0}).error > 0.01


def test_domains_are_those_of_the_whole_table(spark):
    rows = [(i, "plain words of the common kind", "common") for i in range(3000)]
    rows += [(5000, " ".join(f"selten{i} worte{i}" for i in range(300)), "rare"), (5001, "lange " * 6000, "long"), (5002, "", "empty"), (5003, None, "none"), (5004, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    model = mixing.learn(docs, docs.select("doc_id", "domain"), 50)
    assert model.domains == ["common", "long", "rare"]
    rows = mixing.with_posteriors(docs.filter("doc_id >= 5000").select("doc_id", "text"), model).collect()
    best = {r["doc_id"]: model.domains[int(np.argmax(r["_p"]))] for r in rows}
    assert best[5000] == "rare" and best[5001] == "long"


def test_rates_equal_the_nearest_point_by_hand(spark):
    """The rates are the point of all nonnegative rates with the targets' totals that is nearest to 1, which alternating projections find too."""
    rng = np.random.default_rng(11)
    p = rng.dirichlet([0.3, 0.3, 0.3], 60)
    n = rng.integers(5, 200, 60).astype(float)
    table = spark.createDataFrame([(int(k), q.tolist()) for k, q in zip(n, p, strict=True)], "_tokens long, _p array<double>")
    mix = mixing.solve(table, list("abc"), {"a": 6.0, "b": 1.0, "c": 1.0})
    assert mix.error < mixing.CLOSE
    target = np.array([6, 1, 1]) / 8 * n.sum()
    a, r, more = (p * n[:, None]).T, np.ones(60), np.zeros(60)
    w = (p / 1.0).T  # in the norm weighted by tokens, steps go along posteriors
    for _ in range(20_000):
        r = r + w.T @ np.linalg.lstsq(a @ w.T, target - a @ r, rcond=None)[0]
        cut = np.maximum(r + more, 0)
        more, r = r + more - cut, cut
    got = [x["rate"] for x in table.select(mix.rate(F.col("_p")).alias("rate")).collect()]
    assert np.allclose(got, r, atol=5e-3) and min(got) == 0.0


def test_licences():
    s = license_scan.Scanner(license_scan.TEMPLATES, 0.8)
    assert s.hits("Released under the MIT License.") == [(1.0, "mit")]
    assert s.hits("Some header. released under the mit license, and the rest of the line")[0] == (1.0, "mit")
    assert s.hits("Quite another line about the weather today") == [] and s.hits("") == [] and s.hits("one") == []
    text = "Intro.\n\nTHE above copyright notice and this permission notice\nshall be included in all copies or substantial portions of the Software.\n\nEnd."
    assert [name for _, name in s.hits(text)] == ["mit"]
    whole = dict(license_scan.TEMPLATES[:7])
    for name, body in whole.items():
        commented = "\n".join("// " + " ".join(body.split()[i : i + 9]) for i in range(0, len(body.split()), 9))
        hits = s.hits("package main\n// Copyright 2020 Somebody\n//\n" + commented + "\nfunc main() {}")
        assert (1.0, name) in hits, name
    notices = "This work is licensed under the GNU General Public License, version 3."
    assert s.hits(notices) == [(1.0, "gpl-3.0")]
    assert license_scan.Scanner([("x", "a b"), ("y", "z")], 0.8).hits("q a b c") == [(1.0, "x")]


def test_spans_and_bounds_lose_nothing():
    rng = random.Random(9)
    s = license_scan.Scanner(license_scan.TEMPLATES, 0.6)
    for _, t in license_scan.TEMPLATES[7:]:
        w = license_scan.words_of(" ".join(["some", "prose"] + t.split()[: rng.randrange(2, len(t.split()) + 1)] + ["extra"] * rng.randrange(3)))
        text = b" ".join(w).decode()
        best = 0.0
        for _, size, bag in s.templates:
            for i in range(max(1, len(w) - size + 1)):
                mine = license_scan.bigrams(w[i : i + size])
                best = max(best, 2 * len(mine & bag) / max(1, len(mine) + len(bag)))
        got = max((d for d, _ in s.hits(text)), default=0)
        assert got == (best if best >= 0.6 else 0)


def test_lean_workers_hand_memory_back_and_hold_fewer_words(monkeypatch):
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    words = [str(i).encode() * 9 for i in range(1_500_000)]
    last, full = words[-1], held()
    words.clear()
    common.slim()
    assert held() < full - 80_000_000 and last
    b = bpe.Bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    sizes, rows = [], b._rows
    monkeypatch.setattr(b, "_rows", lambda name, part: (sizes.append(len(part)), rows(name, part)))
    texts = [" ".join(f"w{i}x{i * 7}" for i in range(900))]
    whole = b.encode(texts)
    b.young, b.old, b.at_once = {}, {}, 100
    assert b.encode(texts) == whole and max(sizes[1:]) <= 100


def test_lm_weights_are_learned_from_all_training_texts_and_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the {'cat' if i % 3 else 'dog'} sat on w{i} mat") for i in range(60)], "doc_id long, text string")
    train = [lm_score.tokens(r["text"]) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1]
    seen, mixer_of, learned = {"words": []}, lm_score.mixer_of, lm_score.learned
    monkeypatch.setattr(lm_score, "mixer_of", lambda counts: (seen.update(events=int(counts.sum())), mixer_of(counts))[1])
    monkeypatch.setattr(lm_score, "learned", lambda mixer, rows, study: (seen["words"].append(rows.count()), learned(mixer, rows, study))[1])
    code = []
    fit = lm_score.fit_code
    monkeypatch.setattr(lm_score, "fit_code", lambda *a: code.append(fit(*a)) or code[-1])
    assert lm_score.lm_scores(docs).count() == 60
    assert seen["events"] == len(lm_score.events(code[0].tree, train).bit) > 0
    assert set(seen["words"]) == {len({w for t in train for w in t})}


def test_lm_mixer_from_counts_is_that_from_the_events():
    rng = np.random.default_rng(5)
    x = (rng.integers(-lm_score.LEVELS, lm_score.LEVELS + 1, (lm_score.CODE_INPUTS, 3000)) * lm_score.LEVEL).astype(np.float32)
    gate, bit = rng.integers(0, lm_score.CODE_GATES, 3000).astype(np.uint8), rng.integers(0, 2, 3000).astype(np.float32)
    counts = np.zeros((lm_score.CODE_CELLS, 2), np.int64)
    np.add.at(counts, (lm_score.cells(x, gate), bit.astype(int)), 1)
    want = lm_score.Mixer(lm_score.CODE_GATES, lm_score.CODE_START)
    for _ in range(lm_score.CODE_ROUNDS):
        sums = lm_score.Sums.none(lm_score.CODE_GATES, lm_score.CODE_INPUTS)
        want.study(sums, x, bit, gate)
        want.learn(sums)
    got = lm_score.mixer_of(counts)
    assert np.allclose(got.weights, want.weights, atol=1e-3) and np.allclose(got.map, want.map, atol=1e-3)


def test_lm_tasks_in_the_jvm_count_and_score_as_the_arrays_do(spark):
    """Slots, rounded inputs, code and spelling of odd texts, against the arrays of whole batches."""
    texts = ["The CAT\x0bsat\ton the mat " * 40, None, "", "\u00dcber\u3000a \U0001f600 b\u00a0c naïve", "x" * 5000 + " cat cat", "sat on\x1cthe \x00 mat", *[f"the {'cat' if i % 3 else 'dog'} sat on w{i} mat" for i in range(40)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lists = [lm_score.tokens(t) for t in texts]
    counts = Counter(w for t in lists for w in t)
    words = sorted(w for w, k in counts.items() if k >= 2)
    code = lm_score.fit_code(docs, words, np.array([counts[w] for w in words]), sum(k for k in counts.values() if k == 1))
    e = lm_score.events(code.tree, lists)
    for table, slots, bits in zip(code.tables, e.slots, lm_score.CODE_BITS, strict=True):
        want = np.zeros((1 << bits, 2), np.int64)
        np.add.at(want, (slots, e.bit.astype(int)), 1)
        assert (lm_score.packed(want) == table).all()
    want = np.zeros((lm_score.CODE_CELLS, 2), np.int64)
    np.add.at(want, (lm_score.cells(*lm_score.code_inputs(code.tree, code.tables, e, True)), e.bit.astype(int)), 1)
    assert np.allclose(code.mixer.weights, lm_score.mixer_of(want).weights, atol=0.02)

    table = spark.createDataFrame([(w.decode(), k) for w, k in counts.items()], "token string, c long")
    spelling, every = lm_score.fit_spelling(table), list(counts)
    want, mixer = np.zeros((lm_score.SPELL_FIRST[-1], 2), np.int64), lm_score.Mixer(lm_score.SPELL_GATES, (0.2,) * 6)
    for slots, bit in lm_score._letters(every):
        np.add.at(want, (slots, np.tile(bit.astype(int), (6, 1))), 1)
    assert (lm_score.packed(want) == spelling.table).all()
    for _ in range(lm_score.SPELL_ROUNDS):
        sums = lm_score.Sums.none(lm_score.SPELL_GATES, 6)
        for step, (slots, bit) in enumerate(lm_score._letters(every)):
            x, gate = lm_score.spell_inputs(spelling.table, slots, bit, step, True)
            mixer.study(sums, x, bit.astype(np.float32), gate)
        mixer.learn(sums)
    assert np.allclose(spelling.mixer.weights, mixer.weights, atol=0.02)

    base = np.log10([counts[w] for w in words])
    sent = lm_java.shared(spark, lm_java.sent(spark, {"weights": code.mixer.weights, "map": code.mixer.map, "base": base}, code.sent))
    kind = "row long, doc_id long, token binary, k long, n_tokens long, size long, n_known long, base double, log double"
    rows = lm_java.rows(docs.select("doc_id", F.col("text").cast("binary")), "look", sent, kind).collect()
    logs = code.log10(lists)
    for r in [r for r in rows if r["token"] is None]:
        mine = lists[r["doc_id"]]
        assert (r["n_tokens"], r["size"], r["n_known"]) == (len(mine), sum(len(w) + 1 for w in mine), sum(w in words for w in mine))
        assert abs(r["log"] - logs[r["doc_id"]]) < 1e-4 * abs(logs[r["doc_id"]]) + 1e-6 and abs(r["base"] - sum(math.log10(counts[w]) for w in mine if w in words)) < 1e-6
    assert sum((Counter({bytes(r["token"]): r["k"]}) for r in rows if r["token"] is not None), Counter()) == Counter(w for t in lists for w in t if w not in words)
    sent = lm_java.shared(spark, lm_java.sent(spark, {"weights": spelling.mixer.weights, "map": spelling.mixer.map}, spelling.sent))
    spelled = lm_java.rows(table.select(F.col("token").cast("binary"), "c"), "spell", sent, "token binary, c long, log double").collect()
    want = dict(zip(every, spelling.log10(every), strict=True))
    assert all(abs(r["log"] - want[bytes(r["token"])]) < 1e-4 * abs(want[bytes(r["token"])]) for r in spelled) and len(spelled) == len(want)
