"""Language-model scores: online logistic mixing of hashed-context bit predictors.

The event that both scores describe is the text's sequence of tokens: its words (A-Z lowered, white space apart), then one end. The
model codes it in bits. Tokens that training has often enough form a dictionary, sorted by their bytes and halved by weight again and again: a
token's code is its way down that tree, one bit a node. Any other word is coded as an escape, then its bytes and a space, eight bits each.

1. Words are counted, per task and then over all tasks; the table of words is written. It gives the dictionary and the tree.
2. Bits of the code have these predictors: the node alone; the node with hashes of the two words before, and of the last
   frequent word before (which skips the words between); and the node's bits in this text so far. Hashed contexts
   have slots of zeros and ones, summed over all training texts; each predictor is smoothed by the one of the node alone.
   Bits of bytes have the bytes before within the word (0 to 4) and all of them; their slots are summed over all distinct training words.
3. The predictors' stretched probabilities are mixed by weights that a gate chooses (how often the contexts were seen). The weights are learned by
   Newton steps on sums of gradients and curvatures, each event without its own occurrence, over all training texts (all distinct words). The code's
   events are counted once by gate, bit and rounded inputs, and the steps read these counts; the spelling's are gone through in each step.
   So they depend on the rows only, not on partitions. An adaptive map from (gate, mixed probability) to what came refines the result.
4. A text is scored from its beginning to its end. After each block of its tokens the text's own correction of the weights learns online
   from that block's errors; it begins at zero with every text, so that scores depend on no other held-out text.

Tasks go through texts and words in the JVM (lm_java.py). The arrays here describe the same events in whole batches; tests hold one against the other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lm_java
from .common import crc_mod, python_ready, saved

F4, U1, U4 = np.float32, np.uint8, np.uint32
LN10 = float(np.log(10))
#: Tokens of the dictionary, at most (the most frequent in training), and the least occurrences there; other words are spelled.
DICTIONARY, LEAST = 1 << 18, 2
#: Frequent words, the last of which is a context.
FREQUENT = 256
#: Share of all tokens from which on a node of the code is mixed.
SHARE = 2.0**-14
#: Bits of the slots' numbers: of the code's hashed contexts; of the spelling's predictors, with where each one's slots begin.
CODE_BITS, SPELL_BITS = (20, 20), (8, 16, 18, 19, 19, 19)
SPELL_FIRST = [sum(1 << b for b in SPELL_BITS[:o]) for o in range(len(SPELL_BITS) + 1)]
#: Slots that a task sends on together.
BLOCK = 1 << 14
#: Weight of the node's own prediction in that of its contexts, and in that of the text so far.
PRIOR, TEXT_PRIOR = F4(2.0), F4(4.0)
#: Bins of the adaptive map; bound of mixed stretched probabilities.
BINS, TOP = 33, F4(12)
#: Rounds of learning weights over all counts of the code's events, and over all words; pull of the weights to where they began.
CODE_ROUNDS, SPELL_ROUNDS, PULL = 12, 2, 20.0
#: The code's inputs are rounded to this step for learning, to so many levels on either side of zero.
LEVEL, LEVELS = F4(0.75), 7
#: Tokens after which a text's correction learns; its step.
TURN, RATE = 48, F4(0.3)
#: Words a task counts before it passes the counts on.
HELD = 400_000


def tokens(text: str | None) -> list[bytes]:
    """The words of a text and its end, which is the empty word."""
    out = (text or "").encode().lower().split()
    out.append(b"")
    return out


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U4(16))) * U4(0x85EBCA6B)
    return (x ^ (x >> U4(13))) * U4(0xC2B2AE35)


# Mixing


@dataclass
class Sums:
    """What a round of learning adds up over events: gradients and curvatures by gate, and of the map's bins what came."""

    slope: np.ndarray
    curve: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray

    @classmethod
    def none(cls, gates: int, inputs: int) -> Sums:
        return cls(np.zeros((gates, inputs)), np.zeros((gates, inputs, inputs)), np.zeros((gates, BINS)), np.zeros((gates, BINS)))

    def flat(self) -> bytes:
        return np.concatenate([self.slope.ravel(), self.curve.ravel(), self.zeros.ravel(), self.ones.ravel()]).tobytes()

    def add(self, flat: bytes) -> None:
        a, at = np.frombuffer(flat), 0
        for mine in (self.slope, self.curve, self.zeros, self.ones):
            mine += a[at : at + mine.size].reshape(mine.shape)
            at += mine.size


class Mixer:
    """Weights for each gate and input, and the map's probabilities. Without training: the same weights in each gate, a map that changes nothing."""

    def __init__(self, gates: int, start: tuple[float, ...]) -> None:
        self.start = np.tile(np.array(start), (gates, 1))
        self.weights = self.start.astype(F4)
        self.map = np.tile((1 / (1 + np.exp(-np.linspace(-TOP, TOP, BINS)))).astype(F4), (gates, 1))

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Stretched probabilities from inputs (input, event)."""
        z = np.zeros(len(gate), F4)
        at = gate.astype(np.intp)
        for w, row in zip(np.ascontiguousarray(self.weights.T), x, strict=True):
            z += w.take(at) * row
        return np.clip(z, -TOP, TOP)

    def refined(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probabilities of a one: the mean of the mixed one and of the map's, which is read between two bins."""
        at = (z + TOP) * F4((BINS - 1) / (2 * TOP))
        low = np.minimum(at.astype(np.int32), BINS - 2)
        f = at - low.astype(F4)
        flat, where = self.map.ravel(), gate.astype(np.intp) * BINS + low
        r = flat.take(where)
        r += (flat.take(where + 1) - r) * f
        return np.clip(F4(0.5) / (1 + np.exp(-z)) + F4(0.5) * r, F4(1e-6), F4(1 - 1e-6))

    def study(self, sums: Sums, x: np.ndarray, bit: np.ndarray, gate: np.ndarray, times: np.ndarray | None = None) -> None:
        """Add events to a round's sums, each so many times."""
        z = self.mixed(x, gate)
        p = 1 / (1 + np.exp(-z))
        order = np.argsort(gate, kind="stable")
        ends = np.searchsorted(gate[order], np.arange(len(self.weights) + 1))
        x, err, bend = x[:, order], (bit - p)[order], (p * (1 - p))[order]
        if times is not None:
            err, bend, bit = err * times[order], bend * times[order], bit * times
        for g in np.flatnonzero(np.diff(ends)):
            s = slice(ends[g], ends[g + 1])
            sums.slope[g] += x[:, s] @ err[s]
            sums.curve[g] += (x[:, s] * bend[s]) @ x[:, s].T
        flat = gate.astype(np.int64) * BINS + np.rint((z + TOP) * F4((BINS - 1) / (2 * TOP))).astype(np.int64)
        n1 = np.bincount(flat, bit, sums.ones.size).reshape(sums.ones.shape)
        sums.ones += n1
        sums.zeros += np.bincount(flat, times, sums.ones.size).reshape(sums.ones.shape) - n1

    def learn(self, sums: Sums) -> None:
        """A Newton step in each gate, damped and pulled to the start; and the map, with a prior of 30 events at the bin's own value."""
        eye = np.eye(self.weights.shape[1])
        for g, (slope, curve) in enumerate(zip(sums.slope, sums.curve, strict=True)):
            w = self.weights[g].astype(float)
            move = np.linalg.solve(curve + (PULL + 1e-3 * np.trace(curve)) * eye, slope - PULL * (w - self.start[g]))
            self.weights[g] = w + move * min(1.0, 1.0 / (np.abs(move).max() + 1e-9))
        own = 1 / (1 + np.exp(-np.linspace(-TOP, TOP, BINS)))
        self.map = ((sums.ones + 30 * own) / (sums.zeros + sums.ones + 30)).astype(F4)


def _seen(n: np.ndarray, *edges: int) -> np.ndarray:
    """The number of edges that a count reaches."""
    return sum((n >= F4(e)).astype(np.uint8) for e in edges)


# The dictionary's code


@dataclass
class Tree:
    """The code of a sorted dictionary by halving weights. The last symbol is the escape. A node is the place at which it splits. Nodes that
    weigh less than `share` of all are not coded bit by bit: below them a word has its share of their weight, in `tail`."""

    words: list[bytes]
    weights: np.ndarray
    share: float = SHARE
    n0: np.ndarray = field(init=False)
    n1: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        v = len(self.weights)
        cum = np.concatenate([[0.0], np.cumsum(self.weights, dtype=float)])
        lo, hi, active = np.zeros(v, np.int64), np.full(v, v), np.arange(v)
        self.n0, self.n1 = np.zeros(v + 1, F4), np.zeros(v + 1, F4)
        depth, steps = np.zeros(v, np.int64), []
        while len(active := active[(hi[active] - lo[active] > 1) & (cum[hi[active]] - cum[lo[active]] >= self.share * cum[-1])]):
            a, b = lo[active], hi[active]
            half = (cum[a] + cum[b]) / 2
            mid = np.clip(np.searchsorted(cum, half), a + 1, b - 1)
            mid -= (mid - 1 > a) & (cum[mid] - half > half - cum[mid - 1])
            right = active >= mid
            self.n0[mid], self.n1[mid] = cum[mid] - cum[a], cum[b] - cum[mid]
            lo[active], hi[active] = np.where(right, mid, a), np.where(right, b, mid)
            steps.append((active, mid, right))
            depth[active] += 1
        self.stretched = np.log((self.n1 + F4(0.4)) / (self.n0 + F4(0.4)))
        self.share1 = (self.n1 + F4(0.4)) / (self.n0 + self.n1 + F4(0.8))
        self.tail = np.log10(self.weights / (cum[hi] - cum[lo]))
        self.at = np.concatenate([[0], np.cumsum(depth)])
        self.path = np.empty(self.at[-1], np.int32)  # twice the node, and the bit
        for level, (active, mid, right) in enumerate(steps):
            self.path[self.at[active] + level] = mid * 2 + right
        self.index = {w: i for i, w in enumerate(self.words)}
        self.hashes = _scrambled(np.array([xxhash.xxh32_intdigest(w) for w in self.words] + [0], U4))
        self.frequent = np.zeros(v, bool)
        self.frequent[np.argsort(-self.weights[:-1], kind="stable")[:FREQUENT]] = True

    def __getstate__(self) -> dict:
        return {"words": self.words, "weights": self.weights, "share": self.share}

    def __setstate__(self, kept: dict) -> None:
        self.__init__(**kept)


#: Inputs of the code's mixer: the node, its hashed contexts, the text so far. Gates: how often three of them have been seen.
CODE_INPUTS, CODE_GATES = 2 + len(CODE_BITS), 4 * 4 * 2
CODE_START = (0.0, 0.35, 0.5, 0.45)


@dataclass
class Events:
    """The bits of a batch of texts' codes, turn by turn: all texts' first tokens, then their next ones. ids, whose: each token's symbol and text."""

    text: np.ndarray
    ends: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    slots: list[np.ndarray]
    before: tuple[np.ndarray, np.ndarray]
    tails: np.ndarray
    ids: np.ndarray
    whose: np.ndarray


def events(tree: Tree, texts: list[list[bytes]], history: bool = True) -> Events:
    """ends: where turns begin and end. before: zeros and ones of the event's node in its text so far (empty unless history). tails: of each text."""
    sizes = np.array([len(t) for t in texts])
    words = [w for t in texts for w in t]
    n, escape = len(words), len(tree.words)
    ids = np.fromiter(map(tree.index.get, words, repeat(escape)), np.int64, n)
    hashes = tree.hashes[ids]
    lost = np.flatnonzero(ids == escape)
    hashes[lost] = _scrambled(np.fromiter((xxhash.xxh32_intdigest(words[i]) for i in lost.tolist()), U4, len(lost)))
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(n)
    two = np.where(at > first, np.roll(hashes, 1) * U4(3), U4(0)) + np.where(at > first + 1, np.roll(hashes, 2), U4(0))
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(tree.frequent[ids], at, -1))[:-1]])
    skip = np.where(last >= first, hashes[last], U4(0))
    turn = (at - first) // TURN
    order = np.argsort(turn.astype(np.int32), kind="stable")
    start = tree.at[ids][order]
    depth = tree.at[ids + 1][order] - start
    ends = np.concatenate([[0], np.cumsum(depth)])
    total = int(ends[-1])
    step = tree.path.take(np.repeat(start - ends[:-1], depth) + np.arange(total))
    came = step & 1
    node, bit = step >> 1, came.astype(F4)
    spread = node.view(U4) * U4(0x9E3779B1)
    slots = []
    for c, b in zip((two + U4(1), skip + U4(2)), CODE_BITS, strict=True):
        h = np.repeat(c[order], depth)
        h ^= spread
        h *= U4(0x85EBCA6B)
        h >>= U4(32 - b)
        slots.append(h.astype(np.int64))
    owner = np.repeat(text[order], depth)
    before = (np.empty(0, F4), np.empty(0, F4))
    if history:  # sorted by text and node, in the order of the text, ones are counted by running sums
        keyed = np.repeat(text[order].astype(np.int64) * (len(tree.n0) << 26), depth)
        keyed += node.astype(np.int64) << 26
        keyed += np.arange(total)
        keyed.sort()
        place = keyed & ((1 << 26) - 1)
        keyed >>= 26
        begins = np.concatenate([[0], np.flatnonzero(keyed[1:] != keyed[:-1]) + 1]) if total else np.empty(0, np.int64)
        runs = np.diff(begins, append=total)
        came = came.take(place)
        ones = np.cumsum(came, dtype=np.int32)
        ones -= came  # ones before, in the run and before it
        n1 = ones - np.repeat(ones[begins], runs)
        n0 = np.arange(total, dtype=np.int32) - np.repeat(begins.astype(np.int32), runs)
        n0 -= n1
        before = (np.empty(total, F4), np.empty(total, F4))
        before[0][place], before[1][place] = n0, n1
    ends = ends[np.searchsorted(turn[order], np.arange(int(turn.max(initial=-1)) + 2))]
    return Events(owner, ends, node, bit, slots, before, np.bincount(text, tree.tail[ids], len(texts)), ids, text)


def packed(counts: np.ndarray) -> np.ndarray:
    """Slots' zeros and ones (slot, 2) as 16 bits each; larger counts are halved until they fit."""
    counts = counts.astype(np.int64)
    over = np.ceil(np.log2(np.maximum(counts.max(1, initial=1), 1) / 65535).clip(0)).astype(np.int64)
    counts >>= over[:, None]
    return (counts[:, 1] << 16 | counts[:, 0]).astype(U4)


def unpacked(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (pairs & U4(0xFFFF)).astype(F4), (pairs >> U4(16)).astype(F4)


def code_inputs(tree: Tree, tables: list[np.ndarray], e: Events, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (input, event) and gates. own: the events are among the counts, and are left out of them."""
    out = np.empty((CODE_INPUTS, len(e.bit)), F4)
    if own:
        n0, n1 = tree.n0.take(e.node) + (F4(0.4) - (1 - e.bit)), tree.n1.take(e.node) + (F4(0.4) - e.bit)
        np.log(n1 / n0, out=out[0])
        p1 = n1 / (n0 + n1)
    else:
        tree.stretched.take(e.node, out=out[0], mode="clip")
        p1 = tree.share1.take(e.node)
    p0 = 1 - p1
    q0, q1, seen = PRIOR * p0, PRIOR * p1, []
    for k, (table, slots) in enumerate(zip(tables, e.slots, strict=True)):
        m0, m1 = unpacked(table.take(slots))
        if own:
            m0, m1 = np.maximum(m0 - (1 - e.bit), 0), np.maximum(m1 - e.bit, 0)
        seen.append(m0 + m1)
        np.log((m1 + q1) / (m0 + q0), out=out[1 + k])
    m0, m1 = e.before
    np.log((m1 + TEXT_PRIOR * p1) / (m0 + TEXT_PRIOR * p0), out=out[-1])
    gate = (_seen(seen[0], 1, 2, 8) * 4 + _seen(m0 + m1, 1, 4, 24)) * 2 + _seen(seen[1], 20)
    return out, gate


def cells(x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """The number of each event's gate and rounded inputs, below CODE_CELLS."""
    at = gate.astype(np.int64)
    for row in x:
        at *= 2 * LEVELS + 1
        at += np.clip(np.rint(row / LEVEL), -LEVELS, LEVELS).astype(np.int64) + LEVELS
    return at


CODE_CELLS = CODE_GATES * (2 * LEVELS + 1) ** CODE_INPUTS


def mixer_of(counts: np.ndarray) -> Mixer:
    """The code's mixer from zeros and ones (cell, 2) of all events."""
    at, bit = np.nonzero(counts)
    times, digits, rest = counts[at, bit].astype(float), [], at
    for _ in range(CODE_INPUTS):
        rest, d = np.divmod(rest, 2 * LEVELS + 1)
        digits.append((d - LEVELS).astype(F4) * LEVEL)
    x, gate, bit = np.stack(digits[::-1]), rest.astype(U1), bit.astype(F4)
    mixer = Mixer(CODE_GATES, CODE_START)
    for _ in range(CODE_ROUNDS):
        sums = Sums.none(CODE_GATES, CODE_INPUTS)
        mixer.study(sums, x, bit, gate, times)
        mixer.learn(sums)
    return mixer


@dataclass
class Code:
    """All that scoring by the code reads."""

    tree: Tree
    tables: list[np.ndarray]
    mixer: Mixer
    sent: object = None  # the tree's and tables' arrays in the driver's JVM

    def log10(self, texts: list[list[bytes]]) -> np.ndarray:
        """The log10 probability of each text's tokens, escapes without the words that follow them."""
        return self.scored(events(self.tree, texts), len(texts))

    def scored(self, e: Events, m: int) -> np.ndarray:
        """log10() of the m texts of these events."""
        x, gate = code_inputs(self.tree, self.tables, e, False)
        z = self.mixer.mixed(x, gate)
        own, squares = np.zeros((CODE_INPUTS, m), F4), np.full((CODE_INPUTS, m), 1e-2, F4)
        # events lie turn by turn, and in a turn text by text
        cuts = np.union1d(np.flatnonzero(np.diff(e.text)) + 1, e.ends[:-1])
        cuts = cuts[cuts < len(z)]
        runs, whose = np.diff(cuts, append=len(z)), e.text[cuts]
        turns = np.searchsorted(cuts, e.ends)
        for lo, hi, a, b in zip(e.ends[:-1].tolist(), e.ends[1:].tolist(), turns[:-1].tolist(), turns[1:].tolist(), strict=True):
            if lo == hi:
                continue
            part, who, n, now = x[:, lo:hi], whose[a:b], runs[a:b], z[lo:hi]
            if lo:
                now += np.einsum("ke,ke->e", np.repeat(own[:, who], n, 1), part)
            if hi < len(z):
                err = np.exp(-now)
                err += 1
                np.subtract(e.bit[lo:hi], np.reciprocal(err, out=err), out=err)
                g = (np.add.reduceat(part * err, cuts[a:b] - lo, 1) / (n + 1)).astype(F4)
                squares[:, who] += g * g
                own[:, who] += RATE * g / np.sqrt(squares[:, who])
        p = self.mixer.refined(np.clip(z, -TOP, TOP), gate)
        return np.bincount(e.text, np.log(np.abs(p - (1 - e.bit))), m) / LN10 + e.tails


# Spelling


SPELL_GATES = 8 * 6
SPELL_ARRAYS = {"bits": np.array(SPELL_BITS, np.int32), "first": np.array(SPELL_FIRST[:-1], np.int32)}


def _letters(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight bits of all bytes of the words and the spaces after them: slots of the predictors (predictor, byte), and the bits."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(U4)
    n = np.array([len(w) + 1 for w in words])
    start = np.repeat(np.cumsum(n) - n, n)
    at = np.arange(len(data)) - start
    hashes, h = np.zeros((len(SPELL_BITS), len(data)), U4), np.zeros(len(data), U4)
    padded = np.concatenate([np.zeros(4, U4), data])
    for k in range(1, 5):
        h = _scrambled(h + np.where(at >= k, padded[4 - k : len(padded) - k], 0).astype(U4) * U4(0x9E3779B1) + U4(k))
        hashes[k] = h
    place = _scrambled(data + U4(257) * (at.astype(U4) + U4(1)))
    run = np.concatenate([np.zeros(1, U4), np.cumsum(place, dtype=U4)])
    hashes[5] = (run[np.arange(len(data))] - run[start]) ^ (at.astype(U4) * U4(0x27D4EB2F))
    shifts, first = np.array([[32 - b] for b in SPELL_BITS], U4), np.array([[f] for f in SPELL_FIRST[:-1]], np.int64)
    node = np.ones(len(data), U4)
    for b in range(7, -1, -1):
        slots = (_scrambled(hashes + node * U4(0x9E3779B1)) >> shifts).astype(np.int64) + first
        slots[0] = node
        bit = ((data >> U4(b)) & U4(1)).astype(bool)
        yield slots, bit
        node = node << U4(1) | bit


def spell_inputs(table: np.ndarray, slots: np.ndarray, bit: np.ndarray, step: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and gates of one of the eight bits. Each order is smoothed by the one before it."""
    out, p1, total = np.empty(slots.shape, F4), F4(0.5), None
    for k, s in enumerate(slots):
        m0, m1 = unpacked(table.take(s))
        if own:
            m0, m1 = np.maximum(m0 - ~bit, 0), np.maximum(m1 - bit, 0)
        total = m0 + m1
        p1 = np.clip((m1 + PRIOR * p1) / (total + PRIOR), F4(1e-4), F4(1 - 1e-4))
        np.log(p1 / (1 - p1), out=out[k])
    return out, U1(step * 6) + _seen(total, 1, 3, 10, 30, 100)


@dataclass
class Spelling:
    table: np.ndarray
    mixer: Mixer
    sent: object = None  # its arrays in the driver's JVM

    def log10(self, words: list[bytes]) -> np.ndarray:
        """The log10 probability of each word's bytes and its space."""
        out, place = np.zeros(len(words)), np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
        for step, (slots, bit) in enumerate(_letters(words)):
            x, gate = spell_inputs(self.table, slots, bit, step, False)
            p = self.mixer.refined(self.mixer.mixed(x, gate), gate)
            out += np.bincount(place, np.log(np.where(bit, p, 1 - p)), len(words))
        return out / LN10


# Distributed sums


def slot_counts(parts: DataFrame, n: int) -> np.ndarray:
    """(slot, zeros and ones) summed over all tasks' rows (block, counts): zeros and ones of the slots of a block, in turn."""

    def added(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        for b in frames:
            for no, raw in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if no != block:
                    if total is not None:
                        yield pa.record_batch({"block": pa.array([block], pa.int64()), "counts": pa.array([total.tobytes()])})
                    block, total = no, np.zeros(min(BLOCK, n - no * BLOCK) * 2, np.int64)
                total += np.frombuffer(raw, np.int32 if len(raw) == total.size * 4 else np.int64)
        if total is not None:
            yield pa.record_batch({"block": pa.array([block], pa.int64()), "counts": pa.array([total.tobytes()])})

    kind = "block long, counts binary"
    sums = parts.repartition("block").sortWithinPartitions("block").mapInArrow(added, kind).toArrow()  # n slots
    out = np.zeros((n, 2), np.int64)
    for no, raw in zip(sums["block"].to_pylist(), sums["counts"].to_pylist(), strict=True):
        out[no * BLOCK : (no + 1) * BLOCK] = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return out


def learned(mixer: Mixer, rows: DataFrame, study) -> Mixer:
    """A round over rows: study(rows) has a row (sums) for each task; these few numbers are added up in order of size and place."""
    gates, inputs = mixer.weights.shape

    def added(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums.none(gates, inputs)
        for b in frames:
            for raw in b.column("sums").to_pylist():
                sums.add(raw)
        yield pa.record_batch({"sums": pa.array([sums.flat()])})

    parts = study(rows).repartition(8).mapInArrow(added, "sums binary").collect()  # 8 at most
    total = Sums.none(gates, inputs)
    for r in parts:
        total.add(r["sums"])
    mixer.learn(total)
    return mixer


def word_table(docs: DataFrame) -> DataFrame:
    """(token, a, c): occurrences in all texts, and in training texts. The end is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained: Counter[bytes] = Counter()
        others: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            names = list(trained.keys() | others.keys())
            c, o = (np.fromiter(map(k.get, names, repeat(0)), np.int64, len(names)) for k in (trained, others))
            trained.clear(), others.clear()
            return pa.record_batch({"token": pa.array(names, pa.binary()).cast(pa.string()), "a": pa.array(c + o), "c": pa.array(c)})

        for b in batches:
            for text, held in zip(b.column("text"), b.column("held").to_pylist(), strict=True):
                (others if held else trained).update(tokens(text.as_py()))
            if len(trained) + len(others) > HELD:
                yield flush()
        if trained or others:
            yield flush()

    rows = docs.select("text", (crc_mod(F.col("doc_id"), 5) == 1).alias("held")).mapInArrow(run, "token string, a long, c long")
    return rows.groupBy("token").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))


def _least(table: DataFrame, most: int = DICTIONARY) -> int:
    """The smallest count in training from which on at most `most` tokens have it; LEAST at least."""
    steps = table.filter(F.col("c") >= LEAST).groupBy(F.floor(F.log2(F.col("c").cast("double")) * 8).alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect()  # 8 rows a doubling
    least, total = 1 << 62, 0
    for r in steps:
        total += r["n"]
        if total > most:
            break
        least = r["c"]
    return least


def fit_code(train: DataFrame, words: list[bytes], counts: np.ndarray, escapes: int) -> Code:
    """The code's model from all training texts (doc_id, text), their dictionary in order and its counts."""
    spark = train.sparkSession
    tree = Tree(words, np.append(counts, escapes + 1).astype(float))
    sizes = [1 << b for b in CODE_BITS]
    arrays = {
        "words": b"".join(words),
        "word_ends": np.cumsum([len(w) for w in words], dtype=np.int32),
        "frequent": tree.frequent.astype(np.uint8),
        "at": tree.at.astype(np.int32),
        "path": tree.path,
        "bits": np.array(CODE_BITS, np.int32),
        "n0": tree.n0,
        "n1": tree.n1,
        "stretched": tree.stretched,
        "share1": tree.share1,
        "tail": tree.tail,
        "numbers": np.array([LEVEL, LEVELS, TURN, RATE], float),
    }
    rows = train.select(F.col("text").cast("binary").alias("text"))

    def counted(mode: str, arrays, n: int) -> np.ndarray:
        shared = lm_java.shared(spark, lm_java.sent(spark, {"cells": np.array([n], np.int32)}, arrays))
        out = slot_counts(lm_java.rows(rows, mode, shared, "block long, counts binary"), n)
        shared.destroy()
        return out

    sent = lm_java.sent(spark, arrays)
    whole = packed(counted("tally", sent, sum(sizes)))
    tables = [whole[sum(sizes[:k]) : sum(sizes[: k + 1])] for k in range(len(sizes))]
    sent = lm_java.sent(spark, {"one": tables[0], "two": tables[1]}, sent)
    return Code(tree, tables, mixer_of(counted("cells", sent, CODE_CELLS)), sent)


def fit_spelling(table: DataFrame) -> Spelling:
    """The spelling's model from all distinct words of training, each once."""
    spark = table.sparkSession
    rows = table.filter("c > 0").select(F.col("token").cast("binary").alias("token"))
    shared = lm_java.shared(spark, lm_java.sent(spark, {**SPELL_ARRAYS, "cells": np.array([SPELL_FIRST[-1]], np.int32)}))
    counts = packed(slot_counts(lm_java.rows(rows, "letters", shared, "block long, counts binary"), SPELL_FIRST[-1]))
    shared.destroy()
    mixer, sent = Mixer(SPELL_GATES, (0.2,) * len(SPELL_BITS)), lm_java.sent(spark, {**SPELL_ARRAYS, "table": counts})
    for _ in range(SPELL_ROUNDS):
        shared = lm_java.shared(spark, lm_java.sent(spark, {"weights": mixer.weights}, sent))
        mixer = learned(mixer, rows, lambda rows, shared=shared: lm_java.rows(rows, "study", shared, "sums binary"))
        shared.destroy()
    return Spelling(counts, mixer, sent)


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    A null or empty text is one token, the end. Repeated rows are scored, and counted, each. Without training texts N and V are 0, the
    base is that of the formula, and every word is spelled by bits of a half. Words of any length count whole.
    Other columns are ignored. bits_per_byte divides by the bytes of the coded words.
    """
    spark = docs.sparkSession
    python_ready(spark)
    table = saved(word_table(docs), "words")
    least = _least(table)
    frequent = table.filter((F.col("c") >= least) | ((F.col("token") == "") & (F.col("c") > 0)))
    rest = table.join(frequent.select("token"), "token", "left_anti") if least == 1 << 62 else table.filter((F.col("c") < least) & ((F.col("token") != "") | (F.col("c") == 0)))
    n, v = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    chosen = frequent.select(F.col("token").cast("binary").alias("token"), "c").toArrow()  # DICTIONARY and the end at most
    chosen = sorted(zip(chosen["token"].to_pylist(), chosen["c"].to_pylist(), strict=True))
    names, c = [w for w, _ in chosen], np.array([k for _, k in chosen], np.int64)
    train = docs.filter(crc_mod(F.col("doc_id"), 5) != 1).select("doc_id", "text")
    code = fit_code(train, names, c, int(n - c.sum()))
    spelling = fit_spelling(table)
    base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    coding = lm_java.shared(spark, lm_java.sent(spark, {"weights": code.mixer.weights, "map": code.mixer.map, "base": base}, code.sent))
    spelt = lm_java.shared(spark, lm_java.sent(spark, {"weights": spelling.mixer.weights, "map": spelling.mixer.map}, spelling.sent))

    # a row with sums for each text, and one for each of its words that isn't in the dictionary
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    parts = lm_java.rows(parts, "look", coding, "row long, doc_id long, token binary, k long, n_tokens long, size long, n_known long, base double, log double")
    parts = saved(parts.withColumn("token", F.col("token").cast("string")), "texts")
    spelled = lm_java.rows(rest.select(F.col("token").cast("binary").alias("token"), "c"), "spell", spelt, "token binary, c long, log double")
    spelled = spelled.withColumn("token", F.col("token").cast("string"))
    lost = parts.filter("token is not null").select("row", "token", "k").join(spelled, "token")
    lost = lost.select("row", F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("n_known"), (F.col("k") * F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1)))).alias("base"), (F.col("k") * F.col("log")).alias("log"))
    whole = parts.filter("token is null").drop("token", "k")
    added = whole.unionByName(lost, allowMissingColumns=True).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("size").alias("size"), *[F.sum(x).alias(x) for x in ("n_known", "base", "log")])
    return added.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("log").alias("score"),
        (-F.col("log") * F.lit(float(np.log2(10))) / F.col("size")).alias("bits_per_byte"),
    )
