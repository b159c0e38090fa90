"""run() over the smallest tables against the stages by hand."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

import corpus_pipeline
from corpusloom.llm import bpe, common, near_dedup, quality_rules

from .test_llm import SF, components_by_hand


def test_pipeline_equals_the_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs, labels).collect() if r["kept"]}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    last = {t: i for i, t in sorted(rows.items())}
    rows = {i: t for t, i in last.items()}
    rows = {i: rows[i] for i in {c for _, c in components_by_hand(list(rows.items())).values()}}
    ranks = bpe.Bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == set(rows)
    for r in out:
        ids = library.encode_ordinary(rows[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_each_stage_begins_with_free_heap_handed_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "rested", lambda _: calls.append("rested"))
    for operator in ("keep_good", "exact_dedup", "near_dedup", "mix_documents", "round_trip"):
        monkeypatch.setattr(corpus_pipeline, operator, lambda *_, operator=operator, **__: calls.append(operator))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert calls == ["rested", "keep_good", "rested", "exact_dedup", "rested", "near_dedup", "rested", "mix_documents", "rested", "round_trip"]


def test_executors_hand_free_heap_back(spark):
    """In local mode the driver's JVM is the executor: 200 MB that nothing refers to are collected."""
    gateway, heap = spark.sparkContext._gateway, spark._jvm.java.lang.Runtime.getRuntime()
    gateway.detach(gateway.new_array(spark._jvm.long, 25 << 20))
    before = heap.totalMemory() - heap.freeMemory()
    common.rested(spark)
    assert heap.totalMemory() - heap.freeMemory() < before - (150 << 20)


def test_near_dedup_leaves_no_hashes_in_workers_and_the_session_as_it_was(spark):
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    was = spark.conf.get(key)
    near_dedup.near_components(spark.read.parquet(f"{SF}/documents.parquet")).count()
    assert spark.conf.get(key) == was

    def kept(batches):
        from corpusloom.llm import near_dedup as there

        for b in batches:
            yield pa.record_batch({"n": pa.array([len(there._WORD_HASHES)] * b.num_rows, pa.int64())})

    workers = spark.range(0, 64, 1, 16).mapInArrow(kept, "n long").collect()
    assert {r["n"] for r in workers} == {0}
