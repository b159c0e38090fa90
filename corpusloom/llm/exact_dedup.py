"""Exact duplicates by distributed MSD radix partitioning.

The key of a text is its length in bytes followed by its UTF-8 bytes. A round takes the next digit of the
key (a run of bytes; each round's run is sixteen times as long as the one before) of all rows that are still in play, and
splits every group by it. A row leaves when its group has no other row (it is unique) or when the
text has ended (the group's texts are equal). Bytes themselves decide, no digest.

What moves: a round shuffles digits after map-side counting, so that a group of copies sends one row per
task. The table of groups with two or more rows is written, then joined to the rows: broadcast if
its counted bytes are few, else by a sort-merge join whose skewed keys AQE splits.
Only rows of such groups keep the rest of their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, fresh, joined, repeated_ids, saved

FIRST_DIGIT = 64
DIGIT_GROWTH = 16


def exact_groups(docs: DataFrame, first_digit: int = FIRST_DIGIT, limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, and empty texts equal each other. keep_id is the largest
    doc_id of the group. Rows that repeat a doc_id and a text count each in group_size, and all rows
    with the group's largest id are kept. A row without doc_id counts, and is kept, as no keep_id
    can name it. Other columns are ignored. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("_id"),
        F.octet_length(text).alias("_len"),
        F.lit(0).cast("bigint").alias("_gid"),
        text.cast("binary").alias("_rest"),
        F.sha2(text, 256).alias("_sha"),
    )
    done, width, seen, keys = [], first_digit, first_digit, ["_len", "_gid", "_digit"]
    while True:
        rows = rows.withColumn("_digit", F.expr(f"substring(_rest, 1, {width})"))
        groups = saved(
            rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_id").alias("_keep")).filter("_n > 1").withColumn("_next", F.monotonically_increasing_id()),
            "radix-groups",
        )
        size = groups.agg(F.sum(F.octet_length("_digit") + 48)).first()[0] or 0
        ended = F.col("_n").isNull() | (F.col("_len") <= seen)
        split = rows.join(F.broadcast(groups) if size <= limit else groups, keys, "left").select(
            "_id",
            "_len",
            F.col("_next").alias("_gid"),
            F.when(~ended, F.expr(f"substring(_rest, {width + 1})")).alias("_rest"),
            "_sha",
            F.coalesce("_n", F.lit(1)).alias("_n"),
            F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"),
            ended.alias("_ended"),
        )
        split = saved(split, "radix-rows")
        done.append(split.filter("_ended"))
        rows = split.filter("not _ended").select("_id", "_len", "_gid", "_rest", "_sha")
        if rows.isEmpty():
            break
        width *= DIGIT_GROWTH
        seen += width
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_id").isNull() | F.col("_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts: the one with the largest doc_id.

    All columns stay. Rows without doc_id stay. Rows that repeat both doc_id and text are brought down to one; a doc_id that several texts have
    loses only those rows whose text another id has too. A null text counts as empty. Where ids repeat, the digest names a row of its id; which
    texts are equal was decided by bytes.
    """
    sha = fresh(docs, "_text_sha256")
    dropped = saved(exact_groups(docs).filter("not kept").select("doc_id", F.col("text_sha256").alias(sha)).distinct(), "radix-dropped")
    again = saved(repeated_ids(docs), "repeated-ids")
    if again.isEmpty():
        return joined(docs, dropped.select("doc_id"), ["doc_id"], "left_anti", 24)
    named = docs.withColumn(sha, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    kept = joined(named, dropped, ["doc_id", sha], "left_anti", 120)
    rest = joined(kept, again, ["doc_id"], "left_anti", 24)
    once = joined(kept, again, ["doc_id"], "left_semi", 24).dropDuplicates(["doc_id", sha])
    return rest.unionByName(once).drop(sha)
