"""Near duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates, exact links.

1. A pass over the texts makes each one's set of 5-word shingles (64-bit hashes), a digest of the set, and a sketch: the smallest
   hash in each of 128 ranges; an empty range takes the value of the first filled range in a random order of its own (optimal
   densification). 32 bands of 4 values are the text's buckets. A pair at 0.75 meets in no bucket in 1 of 190,000 cases.
2. Rows with equal sets are a class, which has a number of its own and one copy of the set. Only classes go on.
3. In each bucket, the class that meets most others is the hub. Pairs are hub and member: as many as members, not
   their square. Links are confirmed on full sets, and linked classes form components.
4. What the star left out is finished exactly: pairs in a bucket in different components that haven't been
   compared. For these the shingles that occur elsewhere are counted. If x has n shingles, p of them elsewhere, a smaller y can only be
   linked if it has 0.75 n to (1.75 p - 0.75 n) / 0.75 of them; members meet by bucket and step of size, so that the many copies of a
   template that each have words of their own don't meet at all. If x and y share s and t with their bucket's hub, they share min(s, t) in
   the hub and min(p - s, q - t) outside it at most. What is left is compared on full sets, and components are made again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, joined, python_ready, repeated_ids, rested, saved, settings, slim
from .components import components, with_component

WORDS, BINS, ROWS = 5, 128, 4
BANDS = BINS // ROWS
PERCENT = 75
#: Word hashes that a worker keeps.
KEPT = 300_000

_WORD_HASHES: dict[bytes, int] = {}
_PROBES = np.random.default_rng(20).integers(0, BINS, (BINS, 1024))
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(57)).astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles. bytes.lower() lowers A-Z only, bytes.split() splits at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    kept = _WORD_HASHES
    if len(kept) > KEPT:
        kept.clear()
    for w in set(words).difference(kept):
        kept[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(ids))
    n = len(ids) - width + 1
    x = np.full(n, width, np.uint64)
    for k in range(width):
        x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n])
    return np.unique(x)


def forget() -> None:
    """Give the kept word hashes back at a task's end; other work's tasks share this process."""
    _WORD_HASHES.clear()
    slim()


def sketch(h: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of sorted hashes; h has one at least."""
    first = np.minimum(np.searchsorted(h, _EDGES), len(h) - 1)
    out = h[first]
    filled = (out >> np.uint64(57)) == np.arange(BINS, dtype=np.uint64)
    for lo, hi in ((0, 16), (16, 1024)):
        empty = np.flatnonzero(~filled) if lo == 0 else rest
        if not len(empty):
            return out
        tries = filled[_PROBES[empty, lo:hi]]
        at = tries.argmax(1)
        ok = tries[np.arange(len(empty)), at]
        out[empty[ok]] = out[_PROBES[empty[ok], lo + at[ok]]]
        rest = empty[~ok]
    full = np.flatnonzero(filled)
    for e in rest:  # no filled range in 1024 tries
        out[e] = out[full[np.argmin((full - e) % BINS)]]
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS)
    x = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return x.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (shingles), key (16 bytes that stand for the set), bands (array; null if n is 0) of every row."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, bands = [], [], []
            for text in b.column("text"):
                h = shingle_hashes(text.as_py())
                n.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                bands.append(band_keys(sketch(h)) if len(h) else None)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n": pa.array(n, pa.int64()), "key": pa.array(keys, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64()))})
        forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, bands array<long>")


def full_sets(docs: DataFrame, cand: DataFrame) -> DataFrame:
    """node, n, hashes of classes: cand has (node, key, doc_id), the doc_id of one of the class's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_hashes(t.as_py()) for t in b.column("text")]
            keys = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "key": pa.array(keys, pa.binary()), "n": pa.array([len(h) for h in sets], pa.int64()), "hashes": pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))})
        forget()

    texts = joined(docs.select("doc_id", "text").filter("doc_id is not null"), cand.select("doc_id"), ["doc_id"], "left_semi", 24)
    sets = saved(joined(texts.mapInArrow(run, "doc_id long, key binary, n long, hashes array<long>"), cand, ["doc_id", "key"], "inner", 64).select("node", "n", "hashes"), "sets")
    if sets.count() > cand.count():  # rows that repeat a doc_id and a set
        sets = saved(sets.groupBy("node").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes")), "sets")
    return sets


def _possible(shared: str, n: str, m: str) -> str:
    return f"100 * {shared} >= {PERCENT} * ({n} + {m} - {shared})"


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, s): sizes and common shingles of the pairs' full sets, for pairs of nodes whose sizes allow a link."""
    sizes = sets.select("node", "n")
    fit = joined(joined(pairs, sizes.toDF("a", "na"), ["a"], "inner", 24), sizes.toDF("b", "nb"), ["b"], "inner", 24).filter(_possible("least(na, nb)", "na", "nb"))
    rows = fit.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    rows = rows.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    return rows.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).cast("long").alias("s"))


def _step(n: str) -> Column:
    """The step of a size on a ladder of 4 %."""
    return F.floor(F.log(F.expr(n).cast("double")) / F.lit(float(np.log(1.04)))).cast("int")


def linked_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes that are linked to another; component is a node. classes: (node, key, rep, bands)."""
    banded = classes.select("node", F.explode("bands").alias("band"))
    full = saved(banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    meets = saved(joined(banded, full, ["band"], "inner", 32), "meetings")
    fame = saved(meets.groupBy("node").agg(F.sum("size").alias("fame")), "fame")
    famed = saved(joined(meets.select("band", "node"), fame, ["node"], "inner", 32), "famed")
    hubs = saved(famed.groupBy("band").agg(F.max_by("node", F.col("fame") * 4096 - F.pmod(F.xxhash64("node"), F.lit(4096))).alias("hub")), "hubs")
    starred = saved(joined(famed.select("band", "node"), hubs, ["band"], "inner", 32), "stars")

    cand = saved(joined(classes.select("node", "key", F.col("rep").alias("doc_id")), fame.select("node"), ["node"], "left_semi", 24), "candidates")
    sets = full_sets(docs, cand)
    star = saved(compared(starred.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sets), "star-pairs")
    links = star.filter(_possible("s", "na", "nb")).select("a", "b")
    parts = components(links)

    # buckets in which members other than the hub are in different components have pairs that weren't compared
    placed = with_component(starred, parts, "node")
    others = placed.filter("node <> hub")
    split = others.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band")
    left = joined(others.select("band", "node", "component", "hub"), saved(split, "split"), ["band"], "left_semi", 24)
    left = saved(joined(left, star.select(F.col("a").alias("hub"), F.col("b").alias("node"), "s"), ["hub", "node"], "left", 48), "left")
    if left.isEmpty():
        return parts
    inside = left.select(F.explode(F.array("node", "hub")).alias("node")).distinct()
    their = saved(joined(sets, saved(inside, "inside"), ["node"], "left_semi", 24), "left-sets")
    each = their.select("node", "n", F.explode("hashes").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    known = saved(each.join(often, "h").groupBy("node", "n").agg(F.count("*").alias("p")).filter(f"100 * p >= {PERCENT} * n"), "known")
    open_ = saved(joined(left, known, ["node"], "inner", 40), "open").drop("hub")
    open_ = saved(open_.join(open_.groupBy("node").agg(F.collect_set("band").alias("bands")), "node"), "open-bands")  # BANDS at most
    one, two = (open_.toDF(*(f"{side}_{c}" for c in open_.columns)) for side in "xy")
    top = f"least(x_n, ((100 + {PERCENT}) * x_p - {PERCENT} * x_n) div {PERCENT})"
    one = one.withColumn("x_least", F.expr(f"({PERCENT} * x_n + 99) div 100")).withColumn("x_most", F.expr(top)).filter("x_most >= x_least")
    one = one.withColumn("y_step", F.explode(F.sequence(_step("x_least"), _step("x_most"))))
    two = two.withColumn("y_step", _step("y_n"))
    most = "least(x_p, y_p, coalesce(least(x_s, y_s) + least(x_p - x_s, y_p - y_s), x_p))"
    once = "array_min(array_intersect(x_bands, y_bands)) = x_band"  # in the first of their common buckets
    larger = "(x_n > y_n or (x_n = y_n and x_node > y_node)) and y_n between x_least and x_most"
    pairs = one.join(two.withColumnRenamed("y_band", "x_band"), ["x_band", "y_step"]).filter(f"{larger} and x_component <> y_component and {_possible(most, 'x_n', 'y_n')} and {once}")
    again = compared(saved(pairs.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")), "open-pairs"), their)
    more = saved(again.filter(_possible("s", "na", "nb")).select("a", "b"), "more-links")
    return parts if more.isEmpty() else components(links.unionByName(more))


def near_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    A text without words (null, empty, white space) has no shingles and is alone. A text of fewer than five words has one
    shingle, the whole. A row without doc_id is alone: component_id is null, kept is true. Rows that repeat a
    doc_id are that many rows, each in the component of its own text. Other columns are ignored. An empty table gives no rows.
    """
    with settings(docs.sparkSession, {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}):  # fewer tasks and files: most tables are small
        return _near_components(docs)


def _near_components(docs: DataFrame) -> DataFrame:
    rows = saved(signatures(docs), "signatures")
    rested(docs.sparkSession)
    in_class = "n > 0 and doc_id is not null"
    classes = rows.filter(in_class).groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.first("bands").alias("bands"))
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    parts = linked_classes(docs, classes)
    # a component's id is its smallest doc_id; classes of one row without links need none
    lean = classes.select("key", "node", "rep", "rows")
    placed = saved(joined(lean, parts, ["node"], "left", 32), "placed")
    least = saved(placed.filter("component is not null").groupBy("component").agg(F.min("rep").alias("least")), "least")
    named = joined(placed.filter("component is not null or rows > 1"), least, ["component"], "left", 32)
    named = saved(named.select("key", "rows", F.coalesce("least", "rep").alias("component_id")), "class-components")
    # classes of more than a thousandth of all rows, a thousand at most, are broadcast; their rows aren't shuffled
    bar = rows.count() // 1000
    hot = F.broadcast(named.filter(F.col("rows") > bar).select("key", "component_id"))
    cold = named.filter(F.col("rows") <= bar).select("key", "component_id")
    member = rows.filter(in_class).select("doc_id", "n", "key")
    found = member.join(hot, "key").select("doc_id", "n", "component_id")
    rest = joined(member.join(hot.select("key"), "key", "left_anti"), cold, ["key"], "left", 48).select("doc_id", "n", "component_id")
    alone = rows.filter(f"not ({in_class})").select("doc_id", "n", F.lit(None).cast("long").alias("component_id"))
    out = found.unionByName(rest).unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: one with its smallest doc_id. All columns stay; rows without doc_id stay. A doc_id that several
    texts have loses only those rows whose component has a smaller id, or this id in another row."""
    if repeated_ids(docs).isEmpty():
        dropped = saved(near_components(docs).filter("not kept").select("doc_id"), "near-dropped")
        return joined(docs, dropped, ["doc_id"], "left_anti", 24)
    no = fresh(docs, "_row")  # rows get numbers that stay, as ids don't tell them apart
    rows = saved(docs.withColumn(no, F.monotonically_increasing_id()), "numbered")
    named = rows.filter("doc_id is not null")
    found = saved(near_components(named.select(F.col(no).alias("doc_id"), "text")).select(F.col("doc_id").alias("_no"), "component_id"), "near-rows")
    found = found.join(named.select(F.col(no).alias("_no"), "doc_id"), "_no")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "_no")).alias("_first")).select(F.col("_first._no").alias(no))
    return joined(rows, saved(first, "near-kept"), [no], "left_semi", 24).unionByName(rows.filter("doc_id is null")).drop(no)
