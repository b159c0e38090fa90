"""Sinks: CSV, JSON lines, JSON documents, append-only runs with dead letters, Markdown and HTML reports, manifests."""

from __future__ import annotations

import hashlib
import html
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.normalise import whitelist
from ..operators.runs import resume_state, split_valid
from .readers import read_jsonl


def write_csv(rows: DataFrame, path: str, columns: list[str], single: bool = False) -> None:
    """Exactly these columns, '' for what is absent. single: one part file, for small reports."""
    out = whitelist(rows, columns)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_run(reviews: DataFrame, path: str, run: str, dead_letters: str, resume: bool = False) -> None:
    """Reviews with problems appended to a folder of their run: valid rows to `path`, others with their codes to `dead_letters`.

    Without resume, a folder that has rows is left alone and UnsafeOutput raised. With it the rows there are checked (all readable, named, of this
    run), and only items that neither they nor the new rows before have are added. A rater's reviews of one item are one row.
    """
    good, bad = split_valid(reviews)
    where, lost = f"{path.rstrip('/')}/run={run}", f"{dead_letters.rstrip('/')}/run={run}"
    spark = reviews.sparkSession
    files = spark._jvm.org.apache.hadoop.fs.Path(where)
    keys = [c for c in ("reviewer_id", "blinded_item_id") if c in good.columns]
    good = good.dropDuplicates(keys)
    if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        done = read_jsonl(spark, where, good.schema)
        corrupt = done.agg(F.count_if(F.col("_corrupt_record").isNotNull()), F.count("blinded_item_id")).first()[0]
        resume_state(done, run, corrupt, resume)
        good = good.join(done.select(*keys), keys, "left_anti")
        bad = bad.join(done.select(*keys), keys, "left_anti")
    good.write.mode("append").json(where)
    bad.write.mode("append").json(lost)


def write_queue(consensus: DataFrame, path: str) -> None:
    """The items to adjudicate."""
    consensus.filter("needs_adjudication").write.mode("overwrite").option("header", True).csv(path)


def small_rows(rows: DataFrame, most: int = 10_000) -> list[dict[str, Any]]:
    """The rows of a report table; an error if it isn't small."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report table has more than {most} rows")
    return [r.asDict(recursive=True) for r in got]


def json_document(sections: dict[str, Any]) -> str:
    """A JSON document: frames become lists of their rows."""
    return json.dumps({k: small_rows(v) if isinstance(v, DataFrame) else v for k, v in sections.items()}, ensure_ascii=False, indent=2, default=str) + "\n"


def markdown_report(title: str, tables: dict[str, DataFrame]) -> str:
    out = [f"# {title}", ""]
    for name, frame in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
        out += ["| " + " | ".join(str(v).replace("|", "\\|").replace("\n", " ") for v in r.values()) + " |" for r in small_rows(frame)]
        out.append("")
    return "\n".join(out)


def html_report(title: str, tables: dict[str, DataFrame]) -> str:
    """A page that needs nothing else; all values are escaped."""
    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, frame in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in frame.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in small_rows(frame))
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join(parts) + "</body></html>\n"


def percent(share: float) -> str:
    return f"{share * 100:.1f}%"


def content_digest(rows: DataFrame) -> DataFrame:
    """One row: rows and a digest that depends on the rows' values and numbers only, not on their order or files.

    The rows' 64-bit digests are added as decimals, so that any partitioning gives the same sum.
    """
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    each = rows.select(F.xxhash64(text).cast("decimal(20,0)").alias("h"))
    return each.agg(F.count("*").alias("rows"), F.sha2(F.coalesce(F.sum("h").cast("decimal(38,0)").cast("string"), F.lit("")), 256).alias("digest"))


def manifest(tables: dict[str, DataFrame], created_at: str, version: str) -> dict[str, Any]:
    """Row counts, columns and content digests of artefacts."""
    out: dict[str, Any] = {"schema_version": version, "created_at": created_at, "files": {}}
    for name, frame in sorted(tables.items()):
        r = content_digest(frame).first()
        out["files"][name] = {"rows": r["rows"], "columns": frame.columns, "digest": r["digest"]}
    return out


def write_text(folder: str, name: str, text: str) -> str:
    """A small document into a local folder; its SHA-256."""
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text, encoding="utf-8", newline="\n")
    return hashlib.sha256(text.encode()).hexdigest()
