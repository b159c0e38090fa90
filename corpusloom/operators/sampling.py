"""Deterministic stratified samples, retests and blinding. Random order is a digest of seed and values, so it doesn't depend on partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import joined_key, seeded, text_of


def stratified_sample(rows: DataFrame, id_col: str, dims: list[str], size: int, per_value: int = 2, seed: str = "20260720") -> DataFrame:
    """(id, dims, pick): `size` ids, at least `per_value` of each value of each dimension if there are as many and the quotas fit; then filled in seeded order.

    One pass: each row stands once for each of its values and once for the filling, all with the row's dimensions. Row numbers up to a limit
    let Spark cut each value's rows in the tasks, before the shuffle.
    """
    named = rows.select(F.col(id_col).alias("id"), *[text_of(d).alias(d) for d in dims])
    draws = [F.struct(F.lit(0).alias("phase"), F.lit(i).alias("dim"), F.col(d).alias("v"), seeded(f"{seed}|{d}", "id").alias("h")) for i, d in enumerate(dims)]
    draws.append(F.struct(F.lit(1).alias("phase"), F.lit(0).alias("dim"), F.lit("").alias("v"), seeded(f"{seed}|fill", "id").alias("h")))
    each = named.withColumn("_d", F.explode(F.array(*draws))).select("id", *dims, "_d.*")
    place = F.row_number().over(Window.partitionBy("phase", "dim", "v").orderBy("h", "id"))
    near = each.withColumn("n", place).filter(F.col("n") <= max(size, per_value)).filter((F.col("phase") == 1) | (F.col("n") <= per_value))
    # picks come by dimension, value and place; fillings after them, by their digest
    order = F.struct("phase", "dim", F.when(F.col("phase") == 0, F.col("v")).otherwise(F.col("h")).alias("v"), F.lpad("n", 9, "0").alias("n"))
    first = near.groupBy("id", *dims).agg(F.min(order).alias("ord")).orderBy("ord", "id").limit(size)
    return first.select(F.col("id").alias(id_col), *dims, F.row_number().over(Window.orderBy("ord", "id")).alias("pick"))


def blinded(sample: DataFrame, id_col: str, retests: int, seed: str = "20260720") -> DataFrame:
    """The sample and retests of some of it under uniform ids in a fresh order: blinded_item_id, id, is_retest, retest_group_id, original_main_blinded_id."""
    again = sample.select(id_col).withColumn("h", seeded(f"{seed}|retest", id_col)).orderBy("h", id_col).limit(retests)
    groups = again.select(id_col, F.format_string("G%03d", F.row_number().over(Window.orderBy(id_col))).alias("retest_group_id"))
    main = sample.select(id_col).join(groups, id_col, "left").withColumn("is_retest", F.lit(False))
    both = main.unionByName(groups.withColumn("is_retest", F.lit(True)))
    order = Window.orderBy(seeded(f"{seed}|blind", id_col, F.col("is_retest").cast("string")), id_col, "is_retest")
    named = both.withColumn("blinded_item_id", F.format_string("CAL_%04d", F.row_number().over(order)))
    mains = named.filter("not is_retest and retest_group_id is not null").select("retest_group_id", F.col("blinded_item_id").alias("_main"))
    out = named.join(mains, "retest_group_id", "left")
    return out.select("blinded_item_id", id_col, "is_retest", text_of("retest_group_id").alias("retest_group_id"), F.when(F.col("is_retest"), F.col("_main")).otherwise("").alias("original_main_blinded_id"))


def stratum_codes(sample: DataFrame, dims: list[str], order: str = "pick") -> DataFrame:
    """sample with stratum_code: S001, S002, ... by first appearance of each combination."""
    keyed = sample.withColumn("_key", joined_key(dims))
    first = keyed.groupBy("_key").agg(F.min(order).alias("_first"))
    codes = first.select("_key", F.format_string("S%03d", F.row_number().over(Window.orderBy("_first"))).alias("stratum_code"))
    return keyed.join(codes, "_key").drop("_key")


def coverage(sample: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, value, n) of the drawn sample, by grouping sets: one pass for all dimensions."""
    named = sample.select(*[text_of(d).alias(d) for d in dims])
    sets = named.groupingSets([[F.col(d)] for d in dims], *dims).agg(F.count("*").alias("n"), F.grouping_id().alias("_gid"))
    whole = (1 << len(dims)) - 1
    dim = reduce(lambda acc, i: acc.when(F.col("_gid") == whole - (1 << (len(dims) - 1 - i)), dims[i]), range(1, len(dims)), F.when(F.col("_gid") == whole - (1 << (len(dims) - 1)), dims[0]))
    return sets.select(dim.alias("dim"), F.coalesce(*dims).alias("value"), "n")


def balanced_quota(rows: DataFrame, id_col: str, group: str, quota: int, seed: str = "20260720") -> DataFrame:
    """Up to `quota` rows of each group in seeded order: (id, group, place)."""
    order = Window.partitionBy(group).orderBy(seeded(f"{seed}|quota", id_col), id_col)
    return rows.select(id_col, group).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= quota)
