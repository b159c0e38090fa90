"""Evidence units: segmentation of parents, numbering, ids, density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import length_bucket, segments, text_of


def evidence_units(parents: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, min_length: int = 6) -> DataFrame:
    """One row per unit: `keep`, the id, unit_index from 1, unit_text, evidence_id. Parents without units give no rows. No shuffle."""
    rows = parents.select(id_col, *(keep or []), F.posexplode(segments(text_col, min_length)).alias("_pos", "unit_text"))
    return rows.select(
        id_col,
        *(keep or []),
        (F.col("_pos") + 1).alias("unit_index"),
        "unit_text",
        F.format_string("%s_U%02d", F.col(id_col).cast("string"), F.col("_pos") + 1).alias("evidence_id"),
    )


def with_length_bucket(units: DataFrame, short_max: int = 15, medium_max: int = 40) -> DataFrame:
    return units.withColumn("length_bucket", length_bucket("unit_text", short_max, medium_max))


def unit_counts(parents: DataFrame, id_col: str, text_col: str, min_length: int = 6) -> DataFrame:
    """(id, n_units) of every parent, those without units too: counted in the row, without exploding or joining."""
    return parents.select(id_col, F.size(segments(text_col, min_length)).cast("long").alias("n_units"))


def child_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """(key, n_children) of every parent, 0 for those without: children are counted before the join."""
    counts = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias("n_children"))
    return parents.select(key).join(counts, key, "left").select(key, F.coalesce("n_children", F.lit(0)).alias("n_children"))


def with_parent_context(units: DataFrame, parents: DataFrame, key: str, text: str) -> DataFrame:
    """units with parent_context, '' without a parent, and context_available (yes or no)."""
    whole = parents.select(F.col(key), text_of(text).alias("parent_context")).groupBy(key).agg(F.max("parent_context").alias("parent_context"))
    out = units.join(whole, key, "left").withColumn("parent_context", text_of("parent_context"))
    return out.withColumn("context_available", F.when(F.col("parent_context") != "", "yes").otherwise("no"))
