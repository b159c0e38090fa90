"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the embedding of its hash (without marks at its ends), the mean embedding of its character trigrams, and the scaled sum of
those of its beginnings of three to eight bytes. A word over 64 bytes (text without ASCII spaces) enters as several words: its parts between other spaces and
marks, and of parts still as long overlapping pieces. Words, trigrams and beginnings that few of the training documents have
stay zero, so that no document is learned by heart. The network reads windows of 32 words, one every 16, so that each word has context on both sides in one of
them; attention pools a window's states into one probability. A text's score is its largest window's. A
document's label says only that some window is toxic, so training descends on each document's highest windows. What keeps it steady: several
windows of a toxic document count, embeddings decay, the weights are the mean over the last steps, and BLAS has one thread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import crc_mod, python_ready, sample_by_label

#: Labelled documents to learn from, at most, half of them toxic if there are as many; of longer ones as many characters, in pieces.
FIT_ROWS, FIT_CHARS = 3000, 12_000
WINDOW, STRIDE, HIDDEN, DIM, ATT = 32, 16, 8, 8, 8
WORD_SLOTS, CHAR_SLOTS, KEPT = 1 << 15, 1 << 15, 150_000
#: Beginnings of words, in bytes. Least documents that must have a feature: this many, and this share of the training documents.
STEMS, LEAST, LEAST_SHARE = range(3, 9), 3, 0.003
THRESHOLD = 0.3
#: Steps of training, toxic documents in each, and as many others; their highest windows that count, of a toxic one and of another.
STEPS, HALF, TOXIC_WINDOWS, OTHER_WINDOWS = 450, 24, 4, 2
#: Words of a document that isn't toxic that a step reads, at most.
RUN = 400
#: Scale of the sum of a word's beginnings; what embeddings lose in a step; share of the steps after which weights are averaged.
STEM_SCALE, DECAY, SETTLED = np.float32(0.4), np.float32(1 - 5e-4), 0.6
MARKS = b".,;:!?\"'()[]*#$%&|<>-"
#: Bytes of a word, at most; longer ones are read in parts. Characters of a piece (64 bytes at most) of a part still as long, and from one piece to the next.
LONG, PIECE, PIECE_STEP = 64, 16, 8
_BREAKS = r"\s!-&(-/:-@\[-`{-~\u2010-\u2018\u201a-\u205e\u3001-\u303f\uff01-\uff0f\uff1a-\uff20"
_PARTS = re.compile(f"[^{_BREAKS}]+[{_BREAKS}]*|[{_BREAKS}]+")


def split(text: str | None) -> list[bytes]:
    words = (text or "").encode().lower().split()
    if any(len(w) > LONG for w in words):
        return [p for w in words for p in (parts(w) if len(w) > LONG else [w])]
    return words


def parts(word: bytes) -> list[bytes]:
    """All of a long word: its parts up to spaces and marks, and overlapping pieces of those over LONG bytes, which end where the part ends."""
    out = []
    for part in _PARTS.findall(word.decode()):
        part = part.strip() or part
        if len(part.encode()) <= LONG:
            out.append(part.encode())
        else:
            starts = range(0, max(len(part) - PIECE, 0) + PIECE_STEP, PIECE_STEP)
            out.extend(part[i : i + PIECE].encode() for i in starts)
    return out


def inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its slot; the slots of all character trigrams, with where each word's begin; the slots of its beginnings
    (word, length), CHAR_SLOTS for those longer than the word."""
    bare = [w.strip(MARKS) or w for w in words]
    slots = np.array([xxhash.xxh32_intdigest(w) % WORD_SLOTS for w in bare], np.int64)
    framed = [b"^" + w + b"$" for w in words]
    data = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint32)
    n = np.array([len(f) for f in framed])
    ends = np.cumsum(n)
    tri = ((data[:-2] | data[1:-1] << 8 | data[2:] << 16) * np.uint32(2654435761)) >> np.uint32(17)
    inside = np.ones(len(tri), bool)
    for e in (ends[:-1] - 1, ends[:-1] - 2):
        inside[e[e < len(tri)]] = False
    last = STEMS[-1]
    first = np.frombuffer(b"".join([w[:last].ljust(last, b"\0") for w in bare]), np.uint8).reshape(len(words), last).astype(np.uint32)
    size, h, stems = np.array([len(w) for w in bare]), np.zeros(len(words), np.uint32), []
    for k in range(last):
        h = (h + first[:, k] + np.uint32(k + 1)) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        if k + 1 in STEMS:
            stems.append(np.where(size > k, ((h * np.uint32(2246822519)) >> np.uint32(17)).astype(np.int64), CHAR_SLOTS))
    return slots, tri[inside].astype(np.int64), np.concatenate([[0], np.cumsum(n - 2)]), np.stack(stems, 1)


def windows(n: int) -> list[int]:
    """Where the windows of n words begin: at least one, the last reaching the end."""
    return list(range(0, max(n - WINDOW, 0) + STRIDE, STRIDE)) if n > WINDOW else [0] if n else []


class Net:
    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.normal(size=s) * 0.3).astype(np.float32)
        h3 = 3 * HIDDEN
        self.rng = rng
        self.w = {"xf": r(3 * DIM, h3), "xb": r(3 * DIM, h3), "uf": r(HIDDEN, h3), "ub": r(HIDDEN, h3), "wa": r(2 * HIDDEN, ATT), "va": r(ATT), "wo": r(2 * HIDDEN), "bo": np.full(1, -1, np.float32)}

    def vectors(self, words: list[bytes]) -> np.ndarray:
        """Each word's input vector."""
        slots, tri, at, stems = self.known(*inputs(words))
        chars = np.add.reduceat(self.w["ec"][tri], at[:-1]) / np.diff(at)[:, None].astype(np.float32)
        return np.concatenate([self.w["ew"][slots], chars.astype(np.float32), self.w["es"][stems].sum(1) * STEM_SCALE], 1)

    def logits(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, tapes: tuple[list, list] | None = None) -> tuple[np.ndarray, tuple]:
        """A logit for each window from both directions' inputs (time, window, 3H)."""
        w = self.w
        h = gru.both_ways(x, y, lengths, w["uf"], w["ub"], tapes)
        a = np.tanh(h @ w["wa"])
        s = np.where(gru.padded(lengths, len(h)), a @ w["va"], -1e9)
        p = np.exp(s - s.max(0))
        p /= p.sum(0)
        pooled = np.einsum("tn,tnk->nk", p, h)
        return pooled @ w["wo"] + w["bo"], (h, a, p, pooled)

    def gates(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors @ self.w["xf"], vectors @ self.w["xb"]

    def best(self, gates: tuple[np.ndarray, np.ndarray], rows: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """All windows of texts whose words are rows of gates: logits, (rows, lengths) of windows, and the text of each."""
        starts = [windows(len(r)) for r in rows]
        owner = np.repeat(np.arange(len(rows)), [len(s) for s in starts])
        at = np.concatenate([np.array(s, np.int64) for s in starts]) if rows else np.empty(0, np.int64)
        base = np.cumsum([0, *(len(r) for r in rows)])
        flat = np.concatenate([*rows, np.zeros(WINDOW, np.int64)])
        lengths = np.minimum(WINDOW, np.array([len(r) for r in rows])[owner] - at)
        first = base[:-1][owner] + at
        out = np.empty(len(owner), np.float32)
        for lo in range(0, len(owner), 1024):
            part = slice(lo, lo + 1024)
            width = int(lengths[part].max())
            idx = flat[np.minimum(first[part][None, :] + np.arange(width)[:, None], len(flat) - 1)]
            out[part] = self.logits(gates[0][idx], gates[1][idx], lengths[part])[0]
        return out, flat, np.stack([first, lengths]), owner

    def train(self, docs: list[list[bytes]], labels: np.ndarray, steps: int = STEPS, half: int = HALF, seed: int = 13) -> None:
        """Each step draws as many toxic documents as others, and descends on the highest windows of each."""
        with gru.one_thread():
            self._train(docs, labels, steps, half, seed)

    def _train(self, docs: list[list[bytes]], labels: np.ndarray, steps: int, half: int, seed: int) -> None:
        vocab = sorted(set().union(*docs))
        index = {w: i for i, w in enumerate(vocab)}
        rows = [np.array([index[w] for w in d], np.int64) for d in docs]
        slots, tri, at, stems = inputs(vocab)
        self.choose(rows, slots, tri, at, stems)
        slots, tri, at, stems = self.known(slots, tri, at, stems)
        rng, adam = np.random.default_rng(seed), gru.Adam(self.w, 0.01)
        pos, neg = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        mean, late = {}, 0
        for s in range(steps):
            picked = np.concatenate([rng.choice(pos, half), rng.choice(neg, half)])
            mine = [rows[i] for i in picked]
            for k in range(half, 2 * half):  # of a text that isn't toxic no window is, so a run of it will do, another one each time
                if len(mine[k]) > RUN:
                    lo = int(rng.integers(len(mine[k]) - RUN + 1))
                    mine[k] = mine[k][lo : lo + RUN]
            used, local = np.unique(np.concatenate(mine), return_inverse=True)
            cut = np.split(local, np.cumsum([len(r) for r in mine])[:-1])
            n_tri = at[used + 1] - at[used]
            tris = tri[np.repeat(at[used] - np.concatenate([[0], np.cumsum(n_tri)[:-1]]), n_tri) + np.arange(n_tri.sum())]
            own = np.repeat(np.arange(len(used)), n_tri)
            chars = gru.scattered(own, self.w["ec"][tris], len(used))
            vec = np.concatenate([self.w["ew"][slots[used]], chars / n_tri[:, None].astype(np.float32), self.w["es"][stems[used]].sum(1) * STEM_SCALE], 1)
            gates = self.gates(vec)
            logit, flat, spans, owner = self.best(gates, cut)
            order = np.lexsort((-logit, owner))
            rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            toxic = labels[picked][owner[order]] == 1
            chosen = order[rank < np.where(toxic, TOXIC_WINDOWS, OTHER_WINDOWS)]
            first, lengths = spans[:, chosen]
            idx = flat[np.minimum(first[None, :] + np.arange(int(lengths.max()))[:, None], len(flat) - 1)]
            tapes: tuple[list, list] = ([], [])
            z, (h, a, p, pooled) = self.logits(gates[0][idx], gates[1][idx], lengths, tapes)
            y = labels[picked][owner[chosen]].astype(np.float32)
            g = (gru.sigmoid(z) - y) * np.where(y == 1, 1 / y.sum(), 1.5 / (1 - y).sum()).astype(np.float32)
            dp = np.outer(g, self.w["wo"])
            da = np.einsum("nk,tnk->tn", dp, h)
            ds = p * (da - (p * da).sum(0))
            dt = ds[:, :, None] * self.w["va"] * (1 - a * a)
            dh = p[:, :, None] * dp + dt @ self.w["wa"].T
            dx, dy, duf, dub = gru.both_ways_back(dh.astype(np.float32), lengths, self.w["uf"], self.w["ub"], tapes)
            gx, gy = gru.scattered(idx, dx, len(used)), gru.scattered(idx, dy, len(used))
            dv = gx @ self.w["xf"].T + gy @ self.w["xb"].T
            grads = {"uf": duf, "ub": dub, "wa": np.tensordot(h, dt, ((0, 1), (0, 1))), "va": np.tensordot(ds, a, ((0, 1), (0, 1))), "wo": g @ pooled, "bo": g.sum(keepdims=True), "xf": vec.T @ gx, "xb": vec.T @ gy}
            grads["ew"] = gru.scattered(slots[used], dv[:, :DIM], len(self.w["ew"]))
            grads["ec"] = gru.scattered(tris, (dv[:, DIM : 2 * DIM] / n_tri[:, None])[own], len(self.w["ec"]))
            grads["es"] = gru.scattered(stems[used], np.repeat(dv[:, None, 2 * DIM :] * STEM_SCALE, len(STEMS), 1), len(self.w["es"]))
            for k in ("ew", "ec", "es"):
                grads[k][0] = 0
            adam.step({k: v.astype(np.float32) for k, v in grads.items()}, 1.0 if s < steps * SETTLED else 0.3)
            for k in ("ew", "ec", "es"):
                self.w[k] *= DECAY
            if s >= steps * SETTLED:
                for k, v in self.w.items():
                    mean[k] = mean.get(k, 0.0) + v.astype(float)
                late += 1
        self.w = {k: (v / late).astype(np.float32) for k, v in mean.items()}

    def known(self, slots: np.ndarray, tri: np.ndarray, at: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, ...]:
        """Slots as rows of the embeddings; row 0, which is zero, stands for all that few documents had."""
        return self.rows["ew"][slots], self.rows["ec"][tri], at, self.rows["es"][stems]

    def choose(self, docs: list[np.ndarray], slots: np.ndarray, tri: np.ndarray, at: np.ndarray, stems: np.ndarray) -> None:
        """Give rows to the slots that as many documents have as LEAST and LEAST_SHARE say."""
        seen = {"ew": np.zeros(WORD_SLOTS), "ec": np.zeros(CHAR_SLOTS), "es": np.zeros(CHAR_SLOTS + 1)}
        for r in docs:
            u = np.unique(r)
            n = at[u + 1] - at[u]
            seen["ew"][np.unique(slots[u])] += 1
            seen["ec"][np.unique(tri[np.repeat(at[u] - np.cumsum(n) + n, n) + np.arange(n.sum())])] += 1
            seen["es"][np.unique(stems[u])] += 1
        seen["es"][CHAR_SLOTS] = 0
        self.rows = {}
        for k, v in seen.items():
            chosen = v >= max(LEAST, LEAST_SHARE * len(docs))
            self.rows[k] = np.where(chosen, np.cumsum(chosen), 0).astype(np.int32)
            self.w[k] = (self.rng.normal(size=(int(chosen.sum()) + 1, DIM)) * 0.3).astype(np.float32)
            self.w[k][0] = 0


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> tuple[Net | None, float]:
    """(network, prior) from labelled documents that aren't held out; a document with two labels counts as toxic. No network without both labels."""
    free = labels.filter((crc_mod(F.col("doc_id"), 4) != 2) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = free.join(docs.filter("text <> ''").select("doc_id").distinct(), "doc_id", "left_semi")
    _, got = sample_by_label(docs, there, "toxic", most, 20, FIT_CHARS)
    rows = [(split(r["text"]), r["label"]) for r in got]
    rows = [(w, y) for w, y in rows if w]
    y = np.array([y for _, y in rows], int)
    if len(set(y.tolist())) < 2:
        return None, float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
    net = Net()
    net.train([w for w, _ in rows], y)
    return net, 0.0


class _Scorer:
    """A worker's kept words: the inputs of both directions' gates."""

    def __init__(self, net: Net) -> None:
        self.net, self.at, self.n = net, {}, 0
        self.gates = [np.empty((1024, 3 * HIDDEN), np.float32) for _ in range(2)]

    def score(self, texts: list[str | None]) -> np.ndarray:
        words = [split(t) for t in texts]
        if len(self.at) > KEPT:
            self.at, self.n = {}, 0
        new = list(set().union(*words).difference(self.at))
        for lo in range(0, len(new), 50_000):
            part = new[lo : lo + 50_000]
            for i, g in enumerate(self.net.gates(self.net.vectors(part))):
                if self.n + len(part) > len(self.gates[i]):
                    self.gates[i] = np.concatenate([self.gates[i][: self.n], np.empty((max(self.n // 2, len(part)) + 1024, 3 * HIDDEN), np.float32)])
                self.gates[i][self.n : self.n + len(part)] = g
            self.at.update(zip(part, range(self.n, self.n + len(part)), strict=True))
            self.n += len(part)
        rows = [np.fromiter(map(self.at.__getitem__, w), np.int64, len(w)) for w in words]
        logit, _, _, owner = self.net.best((self.gates[0], self.gates[1]), rows)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, logit)
        return 1 / (1 + np.exp(-top))


_SCORERS: dict[int, _Scorer] = {}


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted (1 if score >= 0.3).

    A text without words, null or empty, has score 0. Repeated rows come out alike. Without labels of both kinds all texts with words get the
    labels' prior (0 without any). Other columns are ignored.
    """
    spark = docs.sparkSession
    python_ready(spark)
    net, prior = fit(docs, labels)
    shared = spark.sparkContext.broadcast(net)  # under 1 MB, whatever the corpus
    key = int(np.frombuffer(np.random.default_rng().bytes(8), np.int64)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is not None and key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = _Scorer(shared.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            scores = np.array([prior if split(t) else 0.0 for t in texts]) if shared.value is None else _SCORERS[key].score(texts)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(scores, pa.float64())})

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
