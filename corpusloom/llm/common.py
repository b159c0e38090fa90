"""What the training-data operators share: scratch tables, hold-out rule, checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby, islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side of a join is broadcast; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Rows in an Arrow batch sent to Python; texts can be long.
ARROW_ROWS = 512
#: Applications whose executors have this package.
_SHIPPED: set[str] = set()
#: Scratch tables (application, path) that haven't been released.
_WRITTEN: list[tuple[str, str]] = []
#: ASCII white space, as words `[^\x20\x09-\x0D]+` leave it out. bytes.split() without arguments splits at the same six bytes.
SPACES = " \t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or a temporary one in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: a short lineage that outlives executors. The table goes with release(), or
    when the driver's file system closes."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/corpusloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, fs = _on_disk(spark, path)
    fs.deleteOnExit(at)
    _WRITTEN.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


def _on_disk(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def written() -> int:
    """How many scratch tables there are: a mark for release()."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Delete the scratch tables written since a mark, except those that `but` reads. For callers whose results are written."""
    kept = set(but.inputFiles()) if but is not None else set()
    for app, path in _WRITTEN[since:]:
        if app == spark.sparkContext.applicationId and not any(path.rsplit("/", 1)[1] in f for f in kept):
            at, fs = _on_disk(spark, path)
            fs.delete(at, True)
            _WRITTEN.remove((app, path))


def python_ready(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the session's Arrow batch size to `rows`, so that a batch of long texts fits in a Python worker; and
    hand this package to the executors, once for each application, as a zip file."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        folder = tempfile.mkdtemp(prefix="corpusloom-")  # the driver serves the file from here as long as it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(os.path.realpath(folder), "corpusloom-package.zip")
        root = Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent).as_posix())
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def slim() -> None:
    """Hand memory that this process has freed back to the system. Workers outlive their tasks, and the next stage's share them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries than glibc
        pass


def rested(spark: SparkSession) -> None:
    """Let the executors collect their garbage and hand free heap back to the system, which they share with Python workers. A task for each
    core, so that no executor is left out where all are idle; one that misses it keeps its heap."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


@contextmanager
def settings(spark: SparkSession, new: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    old = {k: spark.conf.get(k, None) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a written table has at most `limit` bytes, at so many a row."""
    return df.count() * row_bytes <= limit


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: int) -> DataFrame:
    """left.join(right): right is broadcast if its counted size allows, else both are shuffled and AQE splits skewed keys."""
    return left.join(F.broadcast(right) if small_enough(right, row_bytes) else right, on, how)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever the case of letters."""
    taken, name = {x.lower() for x in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def repeated_ids(docs: DataFrame) -> DataFrame:
    """The ids, other than null, that more than one row has."""
    return docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_rows")).filter("_rows > 1").select("doc_id")


def stretches(text: Column, most: int, pieces: int = 6) -> Column:
    """A text of at most `most` characters as it is; of a longer one as many pieces, from its beginning to its end, a line feed between."""
    size, n = most // pieces, F.char_length(text)
    parts = [F.substring(text, (F.floor((n - size) * i / (pieces - 1)) + 1).cast("int"), F.lit(size)) for i in range(pieces)]
    return F.when(n > most, F.concat_ws("\n", *parts)).otherwise(text)


def sample_by_label(docs: DataFrame, labelled: DataFrame, label: str, most: int, least: int, chars: int) -> tuple[dict, list[Row]]:
    """What a classifier is fitted on: how many documents each label has, and rows (doc_id, label, text) of a bounded sample, in order.

    labelled: rows (doc_id, label) of documents that have a text; nulls don't count, and a doc_id counts once, with its smallest label. Each
    label gets an equal share of `most`, but at least `least`: its ids with the smallest xxhash64(doc_id). Of texts over `chars` characters
    there are pieces from beginning to end. Ids are chosen first, and a repeated doc_id gives one text, the largest.
    """
    known = saved(labelled.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label")), "labelled")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}, []
    quota = max(most // len(sizes), least)
    # ids below a hash that about twice the quota of their label are below; a smaller label's ids all are
    limits = F.create_map(*[x for v in sizes for x in (F.lit(v), F.lit(min(1.0, (2 * quota + 20) / sizes[v])))])
    near = known.withColumn("_hash", F.xxhash64("doc_id")).filter((F.col("_hash").cast("double") / 2.0**64 + 0.5) <= limits[F.col("label")])
    ids = []
    for v, mine in groupby(sorted(near.collect(), key=lambda r: (r["label"], r["_hash"], r["doc_id"])), lambda r: r["label"]):
        ids.extend((r["doc_id"], v) for r in islice(mine, quota))
    chosen = docs.sparkSession.createDataFrame(ids, known.select("doc_id", "label").schema)
    texts = docs.filter("text <> ''").select("doc_id", stretches(F.col("text"), chars).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text")).collect()
    place = {i: n for n, i in enumerate(ids)}
    return sizes, sorted(rows, key=lambda r: place[r["doc_id"], r["label"]])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
