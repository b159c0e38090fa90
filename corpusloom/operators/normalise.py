"""Dataset normalisation: whitelist projection, blank fill, counters that never fall, cleaning and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PRIVATE_PATTERNS, cleaned, is_blank, masked, text_of


def whitelist(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns as text; absent ones and nulls are ''."""
    return rows.select(*[(text_of(F.col(c).cast("string")) if c in rows.columns else F.lit("")).alias(c) for c in columns])


def filled(rows: DataFrame, column: str, sentinel: str) -> DataFrame:
    """rows with blanks of the column replaced, and _filled that says where."""
    blank = is_blank(column)
    return rows.withColumn("_filled", blank).withColumn(column, F.when(blank, F.lit(sentinel)).otherwise(F.col(column)))


def max_merged(*counters: DataFrame) -> DataFrame:
    """(key, n): the largest count of each key in any of the tables."""
    out = counters[0].select("key", "n")
    for c in counters[1:]:
        out = out.unionByName(c.select("key", "n"))
    return out.groupBy("key").agg(F.max("n").alias("n"))


def counts_of(json_text: str) -> dict[str, int]:
    """The entries of a JSON object whose values are whole numbers from 0; true and false aren't numbers. {} for anything else."""
    import json

    try:
        found = json.loads(json_text)
    except ValueError:
        return {}
    return {k: v for k, v in found.items() if type(v) is int and v >= 0} if isinstance(found, dict) else {}


def count_entries(json_text: str | Column) -> Column:
    """The same on a column: a map of the entries whose values are whole numbers from 0."""
    raw = F.coalesce(F.from_json(json_text, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.transform_values(F.map_filter(raw, lambda k, v: F.rlike(v, F.lit("^[0-9]{1,18}$"))), lambda k, v: v.cast("long"))


def pre_cleaned(rows: DataFrame, text: str, min_length: int = 1) -> DataFrame:
    """rows with the text cleaned of reply headers, quotes and placeholders; texts shorter than min_length go."""
    return rows.withColumn(text, cleaned(text)).filter(F.length(text) >= min_length)


def privacy_masked(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, n_url, n_email, n_phone, n_messenger, n_handle, masked_text): hits are counted in the text that the masks before have left."""
    out, left = rows.select(id_col, text_of(text).alias("_t")), F.col("_t")
    cols = []
    for kind, pattern in PRIVATE_PATTERNS.items():
        cols.append(F.regexp_count(left, F.lit(pattern)).cast("long").alias(f"n_{kind.lower()}"))
        left = F.regexp_replace(left, pattern, f"[{kind}]")
    return out.select(id_col, *cols, masked("_t").alias("masked_text"))


def inclusion_state(rows: DataFrame, relevant: str, readable: str) -> DataFrame:
    """Candidates with inclusion yes, no or uncertain, from two columns of yes or no; anything else leaves it uncertain."""
    r, t = text_of(relevant), text_of(readable)
    return rows.withColumn("inclusion", F.when((r == "no") | (t == "no"), "no").when((r == "yes") & (t == "yes"), "yes").otherwise("uncertain"))


def normalised_dataset(samples: DataFrame, evidence: DataFrame, sample_columns: list[str], evidence_columns: list[str], topic: str = "surface_topic", sentinel: str = "other_uncertain") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(samples, evidence, counters): both tables cut to their columns, blank topics filled, and how many rows and fills there were."""
    one, two = whitelist(samples, sample_columns), filled(whitelist(evidence, evidence_columns), topic, sentinel)
    n, fills = two.agg(F.count("*"), F.count_if("_filled")).first()
    return one, two.drop("_filled"), {"samples": one.count(), "evidence": n, "topics_filled": fills}
