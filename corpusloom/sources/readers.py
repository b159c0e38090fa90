"""Sources: CSV, JSON lines, JSON objects, simple YAML, text files with line numbers, file digests, synthetic candidates."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text_of


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: The columns of the public files, in their order.
SAMPLES = strings("sample_id", "platform_source", "platform_sequence", "window_tag", "theme_bucket", "reply_type", "date", "public_text", "migration_status")
EVIDENCE = strings("evidence_id", "sample_id", "platform_source", "unit_index", "unit_text", "surface_topic", "mechanism_label", "label_source", "review_status", "analysis_inclusion_status")
FEEDBACK = strings("feedback_id", "platform", "window_tag", "raw_text")


def _null_free(rows: DataFrame) -> DataFrame:
    """'' for null in text columns, as the reader can't tell them apart."""
    return rows.select(*[text_of(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in rows.schema.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, missing_ok: bool = False) -> DataFrame:
    """A CSV file with a header: all text, a byte-order mark is dropped, quoted line feeds are kept. With a schema its columns, found by name: others
    are left out, absent ones are ''. A missing file is an error, or empty."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    try:
        rows = _null_free(reader.csv(path))
        return rows.select(*[(F.col(f"`{n}`") if n in rows.columns else F.lit("")).alias(n) for n in schema.names]) if schema else rows
    except AnalysisException as e:
        if missing_ok and schema is not None and "PATH_NOT_FOUND" in str(e.getCondition()):
            return spark.createDataFrame([], schema)
        raise


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a missing file is empty. Lines that can't be read have _corrupt_record."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    try:
        return spark.read.schema(full).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()):
            return spark.createDataFrame([], full)
        raise


def json_object(text: str | None) -> dict[str, Any]:
    """The object in a text; {} for bad text and for anything but an object."""
    try:
        found = json.loads(text or "")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def simple_yaml(text: str) -> dict[str, Any]:
    """Settings in YAML: a mapping of keys to scalars or lists of scalars. Read by PyYAML where it is installed, else by grouping lines under their keys."""
    try:
        import yaml
    except ModuleNotFoundError:
        return _settings(text)
    found = yaml.safe_load(text)
    return found if isinstance(found, dict) else {}


_ENTRY = re.compile(r"^(?P<key>[^\s#:-][^:\n]*?)[ \t]*:(?:[ \t]+(?P<value>[^\n]*?))?[ \t]*\n(?P<items>(?:[ \t]*(?:-[ \t]+[^\n]*|#[^\n]*)?\n)*)", re.M)
_ITEM = re.compile(r"^[ \t]*-[ \t]+([^\n]*?)[ \t]*$", re.M)


def _settings(text: str) -> dict[str, Any]:
    """Each entry is a key with a value, or with the items of the lines below it."""
    found = _ENTRY.finditer(text.replace("\r\n", "\n") + "\n")
    return {m["key"].strip(): _plain(m["value"]) if m["value"] and not m["value"].startswith("#") else [_plain(i) for i in _ITEM.findall(m["items"])] or None for m in found}


def _plain(text: str) -> Any:
    """A scalar: JSON's numbers, words and strings are what JSON says, in single quotes a text stands as it is, anything else is text."""
    if re.fullmatch(r"'(?:[^']|'')*'", text):
        return text[1:-1].replace("''", "'")
    try:
        return json.loads(text)
    except ValueError:
        return text


def with_required_terms(settings: dict[str, Any], key: str, terms: list[str]) -> dict[str, Any]:
    """settings with the terms added to a list, each once."""
    return settings | {key: list(dict.fromkeys([*settings.get(key, []), *terms]))}


def _excluded(path: Column, excluded: list[str]) -> Column:
    """A path that is one of these, lies below one, or has one among its parts."""
    parts = F.split(path, "/")
    out = F.lit(False)
    for e in excluded:
        bare = e.strip("/")
        out = out | (path == bare) | F.startswith(path, F.lit(f"{bare}/")) | F.array_contains(parts, bare)
    return out


def text_files(spark: SparkSession, root: str, pattern: str | list[str] = "*", excluded: list[str] | None = None) -> DataFrame:
    """(file_path relative to root, text) of files below root whose names match a glob (or one of several), each once."""
    globs = [pattern] if isinstance(pattern, str) else pattern
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(root)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(at).toUri().getPath().rstrip("/")
    glob = globs[0] if len(globs) == 1 else "{" + ",".join(globs) + "}"
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    # the path of the file's address, decoded, less the root's own length
    path = F.url_decode(F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9+.-]+:(//[^/]*)?", ""), "\\+", "%2B"))
    rows = rows.select(F.substring(path, F.lit(len(base) + 2), F.length(path)).alias("file_path"), F.col("value").alias("text"))
    return rows.filter(~_excluded(F.col("file_path"), excluded)) if excluded else rows


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of files: names without folders."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def candidates(spark: SparkSession, platforms: list[str], keywords: list[str], per_pair: int = 2, dry_run: bool = True) -> DataFrame:
    """Synthetic candidates, numbered over platforms and keywords in order. There is no real collection: anything but a dry run is an error."""
    if not dry_run:
        raise NotImplementedError("collection needs a provider; only dry runs are built in")
    n = len(platforms) * len(keywords) * per_pair
    place = F.col("id")
    at = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    pair = F.floor(place / per_pair)
    return spark.range(n).select(
        F.format_string("CAND_%04d", place + 1).alias("candidate_id"),
        at(platforms, F.floor(pair / len(keywords))).alias("platform"),
        at(keywords, pair % len(keywords)).alias("keyword"),
        F.format_string("placeholder %d", place % per_pair + 1).alias("title"),
        F.lit("").alias("notes"),
    )
