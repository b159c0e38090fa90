"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a text's bytes (A-Z lowered), white space and all, and labels every position with a probability for each language.
A long text is read in segments of SPAN bytes, each with CONTEXT more on either side whose positions aren't counted again, so that every
position has its neighbours. A text's label pools its positions: log probabilities are added over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import crc_mod, python_ready, sample_by_label

F4 = np.float32
#: Labelled documents to learn from, shared out over the languages, but at least FIT_LEAST of each that has them; of longer ones as many characters, in pieces.
FIT_ROWS, FIT_LEAST, FIT_CHARS = 1500, 20, 20_000
HIDDEN, SPAN, CONTEXT = 8, 192, 16
#: Bytes of a segment in training; probabilities in memory at once: positions of a chunk's segments times languages, over the segment's length.
TRAINED, CHUNK = 64, 8192
#: Neighbouring positions read nearly the same bytes: so many count as one in a text's probability.
ALIKE = 16
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def segments(sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts of these many bytes, one after the other: each segment's text, first byte, bytes, and those before and after which positions count."""
    n = -(-sizes // SPAN)
    text = np.repeat(np.arange(len(sizes)), n)
    at = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * SPAN
    base = (np.cumsum(sizes) - sizes)[text]
    lo, hi = np.maximum(at - CONTEXT, 0), np.minimum(at + SPAN + CONTEXT, sizes[text])
    return text, base + lo, hi - lo, at - lo, np.minimum(at + SPAN, sizes[text]) - lo


def _states(inputs: np.ndarray, data: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One direction's states (time, H, segment) for bytes (time, segment); inputs has the gates' inputs (3H, byte)."""
    k = len(u)
    ut, out, h = np.ascontiguousarray(u.T), np.empty((len(data), k, data.shape[1]), F4), np.zeros((k, data.shape[1]), F4)
    a = np.empty((3 * k, data.shape[1]), F4)
    for t, row in enumerate(data):
        np.matmul(ut, h, out=a)
        x = inputs.take(row, axis=1)
        a[: 2 * k] += x[: 2 * k]
        a[: 2 * k] *= F4(0.5)
        g = np.tanh(a[: 2 * k])
        g += F4(1)
        g *= F4(0.5)
        c = a[2 * k :]
        c *= g[k:]
        c += x[2 * k :]
        np.tanh(c, out=c)
        new = out[t]
        np.subtract(h, c, out=new)
        new *= g[:k]
        new += c
        h = new
    return out


class Net:
    """Weights, training and use. xf and xb hold each byte's input to the gates of either direction."""

    def __init__(self, langs: list[str], seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.normal(size=s) * 0.25).astype(F4)
        self.langs = langs
        self.w = {"xf": r(256, 3 * HIDDEN), "xb": r(256, 3 * HIDDEN), "uf": r(HIDDEN, 3 * HIDDEN), "ub": r(HIDDEN, 3 * HIDDEN), "o": r(2 * HIDDEN, len(langs)), "b": np.zeros(len(langs), F4)}

    def train(self, texts: list[list[bytes]], steps: int = 500, batch: int = 192, seed: int = 5) -> None:
        """texts: of each language. Backpropagation through time on segments drawn at random, every language alike; every position is told its text's language."""
        with gru.one_thread():
            self._train([[t for t in of if t] for of in texts], steps, batch, seed)

    def _train(self, texts: list[list[bytes]], steps: int, batch: int, seed: int) -> None:
        rng, adam = np.random.default_rng(seed), gru.Adam(self.w, 0.02)
        flat = [np.frombuffer(b"".join(of), np.uint8) for of in texts]
        ends = [np.cumsum([len(t) for t in of]) for of in texts]
        for s in range(steps):
            labels = rng.integers(len(texts), size=batch)
            data, lengths = np.zeros((TRAINED, batch), np.uint8), np.empty(batch, np.int64)
            for i, k in enumerate(labels):
                at = int(rng.integers(len(flat[k])))
                part = flat[k][at : min(at + TRAINED, int(ends[k][np.searchsorted(ends[k], at, "right")]))]
                data[: len(part), i], lengths[i] = part, len(part)
            tapes: tuple[list, list] = ([], [])
            h = gru.both_ways(self.w["xf"][data], self.w["xb"][data], lengths, self.w["uf"], self.w["ub"], tapes)
            y = h @ self.w["o"] + self.w["b"]
            g = np.exp(y - y.max(2, keepdims=True))
            g /= g.sum(2, keepdims=True)
            g[:, np.arange(batch), labels] -= 1
            g *= (gru.padded(lengths, TRAINED) / F4(lengths.sum()))[:, :, None].astype(F4)
            dx, dy, duf, dub = gru.both_ways_back(g @ self.w["o"].T, lengths, self.w["uf"], self.w["ub"], tapes)
            grads = {"uf": duf, "ub": dub, "o": np.tensordot(h, g, ((0, 1), (0, 1))), "b": g.sum((0, 1)), "xf": gru.scattered(data, dx, 256), "xb": gru.scattered(data, dy, 256)}
            adam.step(grads, 1.0 if s < steps * 0.6 else 0.25)

    def logs(self, data: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log probabilities (time, language, segment) of segments of data."""
        t = np.arange(int(lengths.max()))[:, None]
        w, last = self.w, first + lengths - 1
        f = _states(np.ascontiguousarray(w["xf"].T), data.take(np.minimum(first + t, last)), w["uf"])
        b = _states(np.ascontiguousarray(w["xb"].T), data.take(np.maximum(last - t, first)), w["ub"])
        of, ob = np.ascontiguousarray(w["o"][:HIDDEN].T), np.ascontiguousarray(w["o"][HIDDEN:].T)
        turn = np.maximum(lengths - 1 - t, 0)[:, None, :]
        y = np.matmul(of, f) + np.take_along_axis(np.matmul(ob, b), turn, 0) + w["b"][:, None]
        y -= y.max(1, keepdims=True)
        y -= np.log(np.exp(y).sum(1, keepdims=True))
        return y

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """Summed log probabilities (text, language) over all positions of each text."""
        out = np.zeros((len(texts), len(self.langs)))
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.intp)
        text, first, size, lo, hi = segments(np.array([len(t) for t in texts], np.int64))
        order, step = np.argsort(-size, kind="stable"), max(64, CHUNK // max(1, len(self.langs)))
        for at in range(0, len(order), step):
            part = order[at : at + step]
            y = self.logs(data, first[part], size[part])
            t = np.arange(len(y))[:, None]
            y *= ((t >= lo[part]) & (t < hi[part]))[:, None, :]
            np.add.at(out, text[part], y.sum(0, dtype=float).T)
        return out

    def positions(self, text: str) -> list[tuple[str, float]]:
        """The label and its probability at every byte of a text."""
        data = text.encode().lower()
        out: list[tuple[str, float]] = []
        _, first, size, lo, hi = segments(np.array([len(data)], np.int64))
        for i in range(len(first)):
            y = np.exp(self.logs(np.frombuffer(data, np.uint8).astype(np.intp), first[i : i + 1], size[i : i + 1])[lo[i] : hi[i], :, 0])
            out += [(self.langs[int(row.argmax())], float(row.max())) for row in y]
        return out


def fit(docs: DataFrame, most: int = FIT_ROWS) -> Net | None:
    """The network, from a bounded sample of the documents with text and lang that aren't held out: of all their languages. None without any."""
    free = docs.filter((crc_mod(F.col("doc_id"), 3) != 1) & (F.col("text") != ""))
    sizes, rows = sample_by_label(free, free.select("doc_id", "lang"), "lang", most, FIT_LEAST, FIT_CHARS)
    texts: dict[str, list[bytes]] = {}
    for r in rows:
        if r["text"].strip():
            texts.setdefault(r["label"], []).append(r["text"].encode().lower() + b"\n")
    if not texts:
        return None
    net = Net(sorted(texts))
    if len(texts) > 1:
        net.train([texts[k] for k in net.langs])
    return net


def label(net: Net, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language of each text, and its probability."""
    y = net.sums([(t or "").encode().lower() for t in texts]) / ALIKE
    p = np.exp(y - y.max(1, keepdims=True, initial=-np.inf))
    p /= p.sum(1, keepdims=True)
    there = [bool(t and _LETTER.search(t)) for t in texts]
    best = p.argmax(1)
    return [net.langs[k] if ok else UNKNOWN for ok, k in zip(there, best, strict=True)], [float(p[i, k]) if ok else 0.0 for i, (ok, k) in enumerate(zip(there, best, strict=True))]


def languages(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    A text that is null, or has no letter, is `und` with score 0. Ties go to the first language in order. Repeated rows come out alike.
    Without any labelled text to learn from, every text is `und`. With one language, all letters are that one. Other columns are ignored.
    """
    spark = docs.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(fit(docs))  # some 10 kB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            langs, scores = label(net, texts) if net is not None and texts else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
