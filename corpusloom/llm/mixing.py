"""Soft-membership mixing: document rates under which expected domain totals of tokens meet target weights.

1. Domains come from a labelled table (doc_id, domain), all of it: each domain that a text has. A naive Bayes classifier over byte trigrams is
   learned from a sample bounded for each domain. Every document gets a posterior over domains, tempered by its length.
2. Rates r >= 0 are those nearest to 1 whose expected totals of the domains, sum of r * tokens * posterior, meet the targets: a multiplier for each
   domain makes the rate of a posterior p the projection of 1 + multipliers * p onto the bounds. The gradient in the multipliers, which is
   how far totals are off, is preconditioned by its curvature. A step is one distributed aggregate, tried at several dampings, the strongest
   of which can't overshoot; steps go on until each relative error is below CLOSE. Targets that no rates meet are approached, with a warning.
3. A rate becomes whole copies: its floor, and one more if a hash of doc_id, uniform in 0 to 1, is below the rest.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import python_ready, sample_by_label, saved, slim

#: Labelled documents to learn from, shared out over the domains, but at least FIT_LEAST of each that has them; of longer ones as many characters, in pieces.
FIT_ROWS, FIT_LEAST, FIT_CHARS = 2000, 20, 20_000
SLOTS, KEPT = 1 << 14, 250_000
STEPS, PULL, CLOSE = 200, 1e-7, 5e-4
#: Shares of the whole curvature that are added to the present one, in the tries of a step.
DAMPINGS = (0.0, 0.01, 0.1, 1.0)


def _slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all words' trigrams, with a space at both ends, and where each word's begin."""
    n = np.array([len(w) for w in words])
    d = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint32)
    tri = ((d[:-2] | d[1:-1] << 8 | d[2:] << 16) * np.uint32(2654435761)) >> np.uint32(18)
    first = np.cumsum(n + 2) - (n + 2)
    inside = np.ones(len(tri), bool)
    for e in (first[1:] - 1, first[1:] - 2):  # trigrams across two words
        inside[e] = False
    return tri[inside].astype(np.int64), np.cumsum(n) - n


class _Members:
    """A worker's kept words: their trigrams' log probabilities in each domain, added up."""

    def __init__(self, model: Classifier) -> None:
        self.model, self.at, self.sums, self.n = model, {}, np.empty((4096, len(model.domains)), np.float32), 0

    def posteriors(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.at) > KEPT:
            self.at, self.n = {}, 0
        new = list(set().union(*texts).difference(self.at))
        if new:
            tri, at = _slots(new)
            if self.n + len(new) > len(self.sums):
                self.sums = np.concatenate([self.sums[: self.n], np.empty((max(self.n // 2, len(new)) + 4096, self.sums.shape[1]), np.float32)])
            self.sums[self.n : self.n + len(new)] = np.add.reduceat(self.model.logs[tri], at)
            self.at.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self.n += len(new)
        return [self._posterior(t) for t in texts]

    def _posterior(self, words: list[bytes]) -> np.ndarray:
        y = self.model.prior
        if words:
            idx = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            y = y + self.sums[idx].sum(0, dtype=np.float64) / np.sqrt(sum(map(len, words)))
        p = np.exp(y - y.max())
        return p / p.sum()


@dataclass
class Classifier:
    domains: list[str]
    prior: np.ndarray
    logs: np.ndarray  # (slot, domain)


def learn(docs: DataFrame, labelled: DataFrame, most: int = FIT_ROWS) -> Classifier:
    """All domains of the labelled table (doc_id, domain) that have a text in docs, their shares of it, and trigrams of some documents of each.
    Rows with nulls don't count; no rows: no domains."""
    there = labelled.select("doc_id", "domain").join(docs.filter("text <> ''").select("doc_id").distinct(), "doc_id", "left_semi")
    sizes, rows = sample_by_label(docs, there, "domain", most, FIT_LEAST, FIT_CHARS)
    domains = sorted(sizes)
    if not domains:
        return Classifier([], np.zeros(0), np.zeros((SLOTS, 0)))
    counts = np.ones((SLOTS, len(domains)))
    place = {d: k for k, d in enumerate(domains)}
    for r in rows:
        if words := r["text"].encode().lower().split():
            counts[:, place[r["label"]]] += np.bincount(_slots(words)[0], minlength=SLOTS)
    n = np.array([sizes[d] + 1.0 for d in domains])
    return Classifier(domains, np.log(n / n.sum()), np.log(counts / counts.sum(0)))


def with_posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with _tokens (words) and _p, the posterior in the order of model.domains."""
    spark = docs.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model)  # slots times domains, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = _Members(shared.value)
        for b in batches:
            words = [(t or "").encode().lower().split() for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            p = members.posteriors(words) if shared.value.domains else [[] for _ in words]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(map(len, words), pa.int64()), pa.array(p, pa.list_(pa.float64()))],
                names=[*b.schema.names, "_tokens", "_p"],
            )
        del members
        slim()

    kind = StructType([*docs.schema.fields, StructField("_tokens", LongType()), StructField("_p", ArrayType(DoubleType()))])
    return docs.mapInArrow(run, kind)


@dataclass
class Mix:
    """The domains' multipliers, from which any posterior's rate follows; totals, their targets, and the largest relative error."""

    multipliers: list[float]
    low: float
    high: float
    totals: dict[str, float]
    targets: dict[str, float]
    error: float = 0.0

    def rate(self, p: Column) -> Column:
        at = F.array(*map(F.lit, self.multipliers)) if self.multipliers else F.array().cast("array<double>")
        moved = F.aggregate(F.zip_with(p, at, lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(1.0), lambda s, x: s + x)
        return F.greatest(F.lit(self.low), F.least(F.lit(self.high), moved))


def _sums(groups: DataFrame, tries: np.ndarray, low: float, high: float) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each row of multipliers the dual value, the totals, and the curvature: sums over the documents (_p, n)."""
    k, d = tries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, 1 + d + d * d))
        for b in batches:
            p = b.column("_p").flatten().to_numpy().reshape(-1, d)
            n = b.column("n").to_numpy().astype(float)
            for row, at in zip(out, tries, strict=True):
                s = p @ at
                v = np.clip(s, low - 1, high - 1)
                row[0] += n @ (s * v - v * v / 2 + s)
                row[1 : 1 + d] += (n * (1 + v)) @ p
                row[1 + d :] += (p.T @ (p * (n * (s == v))[:, None])).ravel()
        yield pa.record_batch({"sums": pa.array([out.ravel()], pa.list_(pa.float64()))})

    parts = groups.select("_p", "n").mapInArrow(run, "sums array<double>").collect()  # a few numbers from each task
    sums = np.sum([r["sums"] for r in parts], 0).reshape(k, -1) if parts else np.zeros((k, 1 + d + d * d))
    return [(float(r[0]), r[1 : 1 + d], r[1 + d :].reshape(d, d)) for r in sums]


def solve(posteriors: DataFrame, domains: list[str], weights: dict[str, float] | None, power: float = 0.0, low: float = 0.0, high: float = float("inf"), whole: bool = False) -> Mix:
    """Rates for target weights (or, if None, the domains' present shares to `power`), from a written table with _tokens and _p, which each step reads.

    The total is that of the table, or with `whole` the least one at which no domain needs less than it has. A domain without tokens gets
    no target, as no rate can fill it. Rates have no upper bound unless `high` gives one. Relative errors of targets below a thousandth of
    all tokens are taken against that thousandth.
    """
    d = len(domains)
    if not d:
        return Mix([], low, high, {}, {})
    groups = posteriors.filter("_tokens > 0").select("_p", F.col("_tokens").alias("n"))
    _, now, most = _sums(groups, np.zeros((1, d)), -np.inf, np.inf)[0]
    n = now.sum()
    live = now > 0
    if not n:
        return Mix([], low, high, {}, {})
    share = np.array([weights.get(x, 0.0) for x in domains]) if weights else np.where(live, (now / n) ** power, 0)
    share = np.where(live, share, 0)
    share = share / share.sum() if share.sum() else now / n
    target = share * (np.max(now[live] / np.maximum(share[live], 1e-12)) if whole else n)
    scale = np.maximum(target, 1e-3 * n)
    soft = PULL * (scale / n) ** 2 * n  # what a multiplier costs, so that targets that can't be met leave it finite
    at = np.zeros(d)
    value, now, curve = _sums(groups, at[None], low, high)[0]
    for _ in range(STEPS):
        if np.abs((now - target) / scale).max() < CLOSE:
            break
        slope = now - target + soft * at
        tries = np.stack([at - np.linalg.lstsq(curve + x * most + np.diag(soft), slope, rcond=1e-15)[0] for x in DAMPINGS])
        found = _sums(groups, tries, low, high)
        cost = [v - t @ target + (soft * t * t).sum() / 2 for (v, _, _), t in zip(found, tries, strict=True)]
        best = int(np.argmin(cost))
        if cost[best] >= value - at @ target + (soft * at * at).sum() / 2 - 1e-13 * n:
            break
        at, (value, now, curve) = tries[best], found[best]
    at = np.array([float(f"{x:.10g}") for x in at])  # not the last digits, which depend on the order of sums
    now = _sums(groups, at[None], low, high)[0][1]
    error = float(np.abs((now - target) / scale).max())
    if error >= CLOSE:
        warnings.warn(f"mixing: totals miss their targets by up to {error:.2%}: {dict(zip(domains, (now / target.clip(1e-12)).round(4).tolist(), strict=True))} of the targets", stacklevel=2)
    return Mix(at.tolist(), low, high, dict(zip(domains, now.tolist(), strict=True)), dict(zip(domains, target.tolist(), strict=True)), error)


def copies(rate: Column, doc_id: Column) -> Column:
    u = F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("int")


def mixed_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, power: float = 0.0) -> DataFrame:
    """One row per row of docs: doc_id, domain (likeliest), n_tokens, p_domain, rate, copies. labelled: (doc_id, domain).

    A text without words, null or empty, has the domains' prior as posterior, adds to no total, and gets that posterior's rate. Repeated rows
    get the same rate. Without labels there are no domains: domain is null, rate 1. Other columns are ignored.
    """
    model = learn(docs, labelled)
    rows = saved(with_posteriors(docs.select("doc_id", "text"), model).drop("text"), "memberships")
    mix = solve(rows, model.domains, weights, power)
    rated = rows.withColumn("rate", mix.rate(F.col("_p")))
    names = F.array(*map(F.lit, model.domains)) if model.domains else F.array(F.lit(None).cast("string"))
    best = F.array_max("_p")
    return rated.select("doc_id", F.get(names, (F.array_position("_p", best) - 1).cast("int")).alias("domain"), F.col("_tokens").alias("n_tokens"), F.coalesce(best, F.lit(0.0)).alias("p_domain"), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def mix_documents(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, low: float = 1.0) -> DataFrame:
    """The rows of docs, each as often as its copies say. With low = 1 every document stays, and small domains are repeated. A text without
    words, null or empty, has the domains' prior; without labels every row stays once. All columns stay."""
    model = learn(docs, labelled)
    lean = saved(with_posteriors(docs.select("doc_id", "text"), model).select("_tokens", "_p"), "memberships")
    mix = solve(lean, model.domains, weights, power, low=low, whole=low >= 1)
    whole = docs.select("text", F.struct(*docs.columns).alias("_row"))
    rows = with_posteriors(whole, model).withColumn("_n", copies(mix.rate(F.col("_p")), F.col("_row.doc_id")))
    return rows.withColumn("_n", F.explode(F.expr("if(_n > 0, sequence(1, _n), cast(array() as array<int>))"))).select("_row.*")
