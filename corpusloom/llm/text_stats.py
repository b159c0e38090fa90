"""Statistics of whole texts as Spark columns only: counts of words, symbols, lines and repeats, and ratios of them.

Words are maximal runs of characters other than the six ASCII white-space characters. Null texts count as empty.
No row is exploded, so nothing is shuffled; every intermediate array is as long as its text's words or lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

SYMBOLS = "[#*$%&|<>]"
WORD_GAP = "[\\x20\\x09-\\x0D]+"
#: Ratios and counts that classifiers may use.
FEATURES = ["n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "mark_ratio", "bar_ratio", "digit_ratio", "words_per_line", "top_line_ratio", "stop_ratio"]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _repeat_words(windows: str, ordered: str) -> Column:
    """Words inside windows that occur twice or more, from windows sorted with their positions.

    A window at position x adds the words x..x+2 that the repeated window before it, at y, doesn't cover: min(3, x - y).
    """
    hit = f"transform({ordered}, (w, k) -> if(get({ordered}, k - 1).w = w.w or get({ordered}, k + 1).w = w.w, w.i, -1))"
    total = f"aggregate(sort_array(filter({hit}, i -> i >= 0)), named_struct('n', 0L, 'y', -9), (a, x) -> named_struct('n', a.n + least(3, x - a.y), 'y', x), a -> a.n)"
    return F.expr(f"if({ordered} is null, 0L, {total})")


def with_base(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    Also the arrays _words and _lines and _text, for with_features.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], text.alias("_text"))
    rows = rows.withColumn("_words", F.array_remove(F.split("_text", WORD_GAP), ""))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    rows = rows.withColumn("_win", F.expr("if(n_words < 3, cast(array() as array<string>), transform(slice(_words, 1, cast(n_words as int) - 2), (w, i) -> concat_ws(' ', w, get(_words, i + 1), get(_words, i + 2))))"))
    rows = rows.withColumn("_ord", F.expr("if(size(array_distinct(_win)) = size(_win), null, sort_array(transform(_win, (w, i) -> named_struct('w', w, 'i', i))))"))
    return rows.select(
        *[F.col(f"k_{c}").alias(c) for c in keep],
        "_text",
        "_words",
        "_lines",
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words("_win", "_ord").alias("n_repeat_words"),
    )


def with_features(base: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, the base counts and FEATURES (doubles) of a table that with_base made."""
    n, chars, text = F.col("n_words"), F.col("word_chars"), F.col("_text")
    lines = F.size("_lines")
    rows = base.withColumn("_kinds", F.size(F.array_distinct("_words")))
    return rows.select(
        *keep,
        n,
        chars,
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        _share(chars, n).alias("mean_word"),
        _share(F.col("n_symbols"), n).alias("symbol_ratio"),
        _share(F.col("n_dup_lines"), lines).alias("dup_line_ratio"),
        _share(F.col("n_repeat_words"), n).alias("repeat_ratio"),
        _share(F.col("_kinds"), n).alias("distinct_ratio"),
        _share(F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}+", "")), chars).alias("upper_ratio"),
        _share(F.regexp_count(text, F.lit("[!?]")), n).alias("mark_ratio"),
        _share(F.regexp_count(text, F.lit("[|]")), n).alias("bar_ratio"),
        _share(F.regexp_count(text, F.lit("[0-9]")), chars).alias("digit_ratio"),
        _share(n, lines).alias("words_per_line"),
        _share(F.length(F.array_max(F.transform("_lines", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]), F.length(text)).alias("top_line_ratio"),
        _share(F.size(F.filter("_words", lambda x: F.length(x) <= 3)), n).alias("stop_ratio"),
    )
