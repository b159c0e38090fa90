"""Structural integrity: orphans, mismatches, containment in the parent, duplicates, blanks, unique keys, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import int_rate
from ..functions.text import has_url, is_blank, normalized, text_of, u_squash

#: Items that are tested against each text, at most, and their bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def orphan_report(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, order: list[str], examples: int = 10) -> DataFrame:
    """One row: n_children, n_orphans, orphan_rate, and the first examples' keys."""
    lost = orphans(children, parents, child_key, parent_key)
    first = lost.orderBy(*order).limit(examples).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(child_key).cast("string").alias("_k")))), lambda s: s["_k"]), ",").alias("examples"))
    sizes = children.agg(F.count("*").alias("n_children")).crossJoin(lost.agg(F.count("*").alias("n_orphans"))).crossJoin(first)
    return sizes.select("n_children", "n_orphans", int_rate(F.col("n_orphans"), F.col("n_children")).alias("orphan_rate"), "examples")


def childless(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    return parents.join(children.select(F.col(child_key).alias(parent_key)).distinct(), parent_key, "left_anti")


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the last in order."""
    window = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def linked(children: DataFrame, parents: DataFrame, key: str, child_text: str, parent_text: str, child_group: str | None = None, parent_group: str | None = None, case_sensitive: bool = True, empty_ok: bool = True, fallback: str | None = None, order: list[str] | None = None) -> DataFrame:
    """children with _orphan, _mismatch, _located: a left join, then three checks of which the first that fails counts.

    Parents are normalised once, before the join; the join stays an equi-join and containment is a projection on its rows. A parent whose text
    is blank is read from the column `fallback`. Of parents that repeat a key the last by `order` counts, any one without it.
    """
    parents = last_wins(parents, key, order) if order else parents.dropDuplicates([key])
    whole = F.when(text_of(parent_text) != "", F.col(parent_text)).otherwise(F.col(fallback)) if fallback else F.col(parent_text)
    p = parents.select(F.col(key), normalized(whole, case_sensitive).alias("_whole"), (text_of(parent_group) if parent_group else F.lit("")).alias("_group"), F.lit(True).alias("_there"))
    rows = children.join(p, key, "left")
    part = normalized(child_text, case_sensitive)
    inside = F.contains(F.col("_whole"), part) & (F.lit(empty_ok) | (part != ""))
    orphan = F.col("_there").isNull()
    mismatch = ~orphan & (text_of(child_group) != F.col("_group")) if child_group else F.lit(False)
    return rows.withColumn("_orphan", orphan).withColumn("_mismatch", mismatch).withColumn("_located", ~orphan & ~mismatch & F.coalesce(inside, F.lit(False))).drop("_whole", "_group", "_there")


def match_report(links: DataFrame) -> DataFrame:
    """One row: n, orphans, mismatches, located, match_rate. Orphans and mismatches count against the rate."""
    one = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    sums = links.agg(F.count("*").alias("n"), one("_orphan").alias("orphans"), one("_mismatch").alias("mismatches"), one("_located").alias("located"))
    return sums.withColumn("match_rate", int_rate(F.col("located"), F.col("n"), default=1.0))


def containments(texts: DataFrame, items: DataFrame, text_id: str, text: str, item_id: str, item: str, case_sensitive: bool = False, gram: int = 12) -> DataFrame:
    """(item_id, text_id) where the normalised item is inside the normalised text.

    Items of BROADCAST_BYTES and BROADCAST_ROWS at most, both counted, are broadcast and tested against each text. Beyond that,
    items of `gram` characters or more are found by an equi-join: each has the one of its grams that fewest items have as key, and a text
    meets those items whose key is among its grams; containment is then tested on these pairs only. Shorter items are tested against each text, as many
    as there are: they are distinct strings of fewer than `gram` characters.
    """
    small = items.select(item_id, normalized(item, case_sensitive).alias("_item")).filter("_item <> ''")
    rows = texts.select(text_id, normalized(text, case_sensitive).alias("_text"))
    n, size = small.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_item")), F.lit(0))).first()
    if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), F.contains(F.col("_text"), F.col("_item"))).select(item_id, text_id)
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - gram + 1), lambda i: F.substring(F.col(c), i, F.lit(gram)))
    long = small.filter(F.length("_item") >= gram)
    each = long.select(item_id, "_item", F.explode(F.array_distinct(grams("_item"))).alias("_gram"))
    often = each.groupBy("_gram").agg(F.count("*").alias("_n"))
    keys = each.join(often, "_gram").groupBy(item_id, "_item").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    wanted = keys.select("_gram").distinct()
    met = rows.filter(F.length("_text") >= gram).select(text_id, F.explode(F.array_distinct(grams("_text"))).alias("_gram")).join(wanted, "_gram", "left_semi")
    pairs = met.join(keys, "_gram").select(text_id, item_id, "_item")
    found = pairs.join(rows, text_id).filter(F.contains("_text", F.col("_item"))).select(item_id, text_id)
    short = small.filter(F.length("_item") < gram)
    if short.isEmpty():
        return found
    names = short.groupBy("_item").agg(F.collect_set(item_id).alias("_ids"))
    listed = [r["_item"] for r in names.select("_item").limit(BROADCAST_ROWS + 1).collect()]
    if len(listed) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} different items of fewer than {gram} characters")
    hit = rows.select(text_id, F.explode(F.filter(F.array(*map(F.lit, listed)), lambda x: F.contains(F.col("_text"), x))).alias("_item"))
    return found.unionByName(hit.join(names, "_item").select(F.explode("_ids").alias(item_id), text_id))


def duplicate_groups(rows: DataFrame, id_col: str, text_col: str, examples: int = 5) -> DataFrame:
    """(first_id, size, ids): texts that are equal without white space, two or more; blanks don't count. ids are the first few, in order.

    Sizes come from map-side counts; ids are cut before they are gathered, so a large group stays small in memory.
    """
    keyed = rows.select(F.col(id_col).alias("_id"), F.sha2(u_squash(text_col), 256).alias("_key"), is_blank(text_col).alias("_blank")).filter("not _blank").drop("_blank")
    sizes = keyed.groupBy("_key").agg(F.count("*").alias("size"), F.min("_id").alias("first_id")).filter("size > 1")
    ranked = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("_id"))).filter(F.col("_n") <= examples)
    listed = ranked.groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return sizes.join(listed, "_key").select("first_id", "size", "ids")


def duplicate_summary(groups: DataFrame) -> DataFrame:
    """One row: groups, rows, largest (1 without groups)."""
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("rows"), F.coalesce(F.max("size"), F.lit(1)).alias("largest"))


def blank_profile(rows: DataFrame, name: str = "") -> DataFrame:
    """(table_name, column, blanks, n) for every column, in one pass."""
    sums = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(is_blank(F.col(f"`{c}`").cast("string")).cast("long")), F.lit(0)).alias(f"b{i}") for i, c in enumerate(rows.columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("blanks")) for i, c in enumerate(rows.columns)])
    return sums.select(F.lit(name).alias("table_name"), F.explode(pairs).alias("p"), "n").select("table_name", "p.column", "p.blanks", "n")


def key_uniqueness(rows: DataFrame, key: str, name: str = "") -> DataFrame:
    """(table_name, n, distinct_keys, is_unique, unique_rate): exact."""
    sums = rows.agg(F.count("*").alias("n"), F.count_distinct(F.col(key)).alias("distinct_keys"))
    return sums.select(F.lit(name).alias("table_name"), "n", "distinct_keys", (F.col("n") == F.col("distinct_keys")).alias("is_unique"), int_rate(F.col("distinct_keys"), F.col("n"), 4, 1.0).alias("unique_rate"))


def url_hits(rows: DataFrame, column: str, name: str = "") -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(has_url(column).cast("long")), F.lit(0)).alias("hits")).select(F.lit(name).alias("table_name"), F.lit(column).alias("column"), "n", "hits")


def canonical(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, canonical_id, is_canonical): the smallest id among texts equal without white space; a blank text stands for itself."""
    key = F.when(is_blank(text_col), F.concat(F.lit("#"), F.col(id_col).cast("string"))).otherwise(F.sha2(u_squash(text_col), 256))
    keyed = rows.select(F.col(id_col), key.alias("_key"))
    least = keyed.groupBy("_key").agg(F.min(id_col).alias("canonical_id"))
    return keyed.join(least, "_key").select(id_col, "canonical_id", (F.col(id_col) == F.col("canonical_id")).alias("is_canonical"))
