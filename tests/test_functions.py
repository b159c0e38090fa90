import pytest
from pyspark.sql import functions as F

from corpusloom.functions import numbers as N
from corpusloom.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0] if values else spark.range(1).select(column.alias("x")).first()[0]


def test_unicode_white_space(spark):
    assert one(spark, T.u_strip("t"), t="　 a\xa0b\x1c\n") == "a\xa0b"
    assert one(spark, T.u_squash("t"), t=" a\xa0 b　\x1cc") == "abc"
    assert one(spark, T.normalized("t", False), t="A b") == "ab"


def test_segments(spark):
    text = "First unit here. Second one!! short; 第一个句子很长。第二个句子也长！\nlast piece without end"
    assert one(spark, T.segments("t"), t=text) == ["First unit here", "Second one", "第一个句子很长", "第二个句子也长", "last piece without end"]


def test_length_is_in_code_points(spark):
    assert one(spark, F.length("t"), t="a😀中") == 3


@pytest.mark.parametrize("text, bucket", [("x" * 15, "short"), ("x" * 16, "medium"), ("x" * 40, "medium"), ("x" * 41, "long"), (" ", "short")])
def test_length_bucket(spark, text, bucket):
    assert one(spark, T.length_bucket("t"), t=text) == bucket


def test_fence(spark):
    assert one(spark, T.without_fence("t"), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.without_fence("t"), t=' {"a": 1} ') == '{"a": 1}'


def test_digest_remainders(spark):
    rows = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    for r in rows.select("d", T.digest_mod3(F.col("d")).alias("m"), T.digest_divisible_by_6(F.col("d")).alias("s")).collect():
        assert r["m"] == int(r["d"], 16) % 3 and r["s"] == (int(r["d"], 16) % 6 == 0)


def test_masks(spark):
    out = one(spark, T.masked("t"), t="see https://x.y/z or a.b@c.org, call +1 (168) 555-5254 @someone")
    assert out == "see [URL] or [EMAIL], call [PHONE] [HANDLE]"


def test_cleaned(spark):
    assert one(spark, T.cleaned("t"), t="> quoted\nRe: old\nkept  text [image] end") == "kept text end"


@pytest.mark.parametrize("a, b, digits, want", [(1, 3, 6, 0.333333), (2, 3, 4, 0.6667), (1, 8, 2, 0.13), (0, 5, 6, 0.0), (5, 0, 4, 0.0)])
def test_int_rate(spark, a, b, digits, want):
    assert one(spark, N.int_rate(F.lit(a), F.lit(b), digits)) == want


@pytest.mark.parametrize("n, rank", [(1, 1), (6, 5), (10, 9), (11, 10)])
def test_nearest_rank(spark, n, rank):
    assert one(spark, N.nearest_rank(F.lit(n), 0.9)) == rank


def test_entropy(spark):
    for counts, want in (([3], 0.0), ([2, 1], 0.9183), ([1, 1, 1], 1.585), ([], 0.0)):
        assert one(spark, N.entropy(F.array(*map(F.lit, counts)).cast("array<bigint>"))) == want


def test_count_terms_does_not_overlap(spark):
    assert one(spark, T.count_terms("t", ["aa", "b"]), t="aaaab") == 3
