"""Runs that can be resumed: identity, state of what is there, remaining items, dead letters, reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import int_rate


class UnsafeOutput(Exception):
    """Output that a run must not add to; `code` says why."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


def run_id(provider: str, model: str, rater: str, prompt_version: str, temperature: float, seed: int) -> str:
    """The identity of a run, which any change in what it depends on changes: the rater, and a digest of all fields in the order of their names."""
    fields = {"provider": provider, "model": model, "rater": rater, "prompt_version": prompt_version, "temperature": float(temperature), "seed": int(seed)}
    return f"{rater}-{hashlib.sha256(json.dumps(fields, sort_keys=True).encode()).hexdigest()[:24]}"


def resume_state(done: DataFrame, expected: str, corrupt: int = 0, resume: bool = True) -> int:
    """Rows there are, if the run may go on from them; else UnsafeOutput with one of four codes. One small aggregate reaches the driver."""
    n, ids, one, unnamed, invalid = done.agg(F.count("*"), F.count_distinct("run_id"), F.max("run_id"), F.count_if((F.coalesce("run_id", F.lit("")) == "") | (F.coalesce("blinded_item_id", F.lit("")) == "")), F.count_if(F.size("problems") > 0) if "problems" in done.columns else F.lit(0)).first()
    if n and not resume:
        raise UnsafeOutput("output_not_empty", f"{n} rows are there, and resuming wasn't asked for")
    if corrupt or invalid or unnamed:
        raise UnsafeOutput("invalid_rows", f"{corrupt + invalid + unnamed} rows can't be read, are invalid or lack an id")
    if ids and ids > 1:
        raise UnsafeOutput("mixed_runs", f"rows of {ids} runs are there")
    if n and one != expected:
        raise UnsafeOutput("other_run", f"rows are of run {one}, not {expected}")
    return int(n)


def remaining(items: DataFrame, done: DataFrame, key: str = "blinded_item_id") -> DataFrame:
    """Items that no row is there for."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def capped(items: DataFrame, most: int | None, order: list[str], raters: list[str] | None = None, rater: str = "reviewer_id") -> DataFrame:
    """The first `most` items in order, of these raters if any are named. No cap: all."""
    mine = items.filter(F.col(rater).isin(raters)) if raters else items
    return mine if most is None else mine.orderBy(*order).limit(most)


def split_valid(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, dead letters): rows with problems go to a queue with their codes, never away."""
    bad = F.size("problems") > 0
    return reviews.filter(~bad).drop("problems"), reviews.filter(bad).withColumn("problems", F.array_join("problems", ","))


def run_report(reviews: DataFrame) -> DataFrame:
    """(run_id, reviewer_id, attempted, accepted, rejected, parse_success_rate)."""
    bad = F.coalesce(F.sum((F.size("problems") > 0).cast("long")), F.lit(0))
    sums = reviews.groupBy("run_id", "reviewer_id").agg(F.count("*").alias("attempted"), bad.alias("rejected"))
    return sums.select("run_id", "reviewer_id", "attempted", (F.col("attempted") - F.col("rejected")).alias("accepted"), "rejected", int_rate(F.col("attempted") - F.col("rejected"), F.col("attempted"), 4).alias("parse_success_rate"))


def retryable(error: Exception) -> bool:
    """Whether another try may help: too many requests (429), a server's fault (5xx), or no connection."""
    code = getattr(error, "code", getattr(error, "status", None))
    return code == 429 or 500 <= code <= 599 if isinstance(code, int) else isinstance(error, OSError)


def with_retries(call: Callable[[], str], attempts: int = 4, again: Callable[[Exception], bool] = retryable, sleep: Callable[[float], None] | None = None) -> str:
    """call(), again after 1, 2, 4, 8 seconds at most where it fails with an error that `again` accepts. After the last failure there is no wait."""
    import time

    for i in range(attempts):
        try:
            return call()
        except Exception as e:
            if i == attempts - 1 or not again(e):
                raise
            (sleep or time.sleep)(min(2**i, 8))
    raise AssertionError


def parsed_json(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """raw with the object in `column` (fenced or not) as columns, and `_corrupt`: not JSON, or not an object. Only the corrupt-record field tells {} from bad text."""
    from ..functions.text import without_fence

    text = without_fence(column)
    got = raw.withColumn("_p", F.from_json(text, f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}))
    bad = F.col("_p._corrupt_record").isNotNull() | F.col("_p").isNull() | ~F.startswith(text, F.lit("{"))
    return got.select(*raw.columns, "_p.*", bad.alias("_corrupt")).drop("_corrupt_record")


#: What a model's answer may fill, with what stands for a missing field.
ANSWER = {"boundary_status": "", "surface_topic": "", "mechanism_label": "", "evidence_phrase": "", "confidence_band": "", "abstain_reason": "none", "decision_basis": "", "created_at": ""}


def parsed_answers(raw: DataFrame, column: str, facts: dict[str, Column], now: str) -> tuple[DataFrame, DataFrame]:
    """(reviews, rejected): answers as reviews. A field that is absent has its default; `facts` are filled by the program whatever the answer
    says, and so is created_at if it is blank. Answers that aren't an object are rejected as they are."""
    got = parsed_json(raw.withColumn("_raw", F.col(column)), "_raw", ", ".join(f"{c} string" for c in ANSWER if c not in raw.columns))
    fields = [F.coalesce(c, F.lit(d)).alias(c) for c, d in ANSWER.items() if c != "created_at" and c not in facts]
    stamp = F.when(F.coalesce("created_at", F.lit("")) == "", F.lit(now)).otherwise(F.col("created_at")).alias("created_at")
    good = got.filter("not _corrupt").select(*[v.alias(k) for k, v in facts.items()], *fields, stamp)
    return good, got.filter("_corrupt").select(*raw.columns)
