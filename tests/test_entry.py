"""Each catalogue query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.plans import catalogue, oracle

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) - set(oracle.oracle_sql()) == {"file_manifest"}


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(oracle.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", ["label_crosstab", "stratified_sample", "blind_sample", "fleiss_kappa"])
def test_same_under_any_partitioning(spark, name, monkeypatch):
    whole = catalogue.table
    out = []
    for k in (1, 7):
        monkeypatch.setattr(catalogue, "table", lambda s, d, n, k=k: whole(s, d, n).repartition(k))
        out.append(canonical(catalogue.queries()[name](spark, SF).toPandas()))
    assert out[0] == out[1]


def test_manifest(spark):
    assert catalogue.file_manifest(spark, SF).count() == 14
