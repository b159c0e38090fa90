"""Bidirectional gated recurrent networks in numpy: forward passes, backpropagation through time, Adam."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np

F4 = np.float32


@contextmanager
def one_thread() -> Iterator[None]:
    """numpy's BLAS on one thread, so that sums come in one order and training gives the same weights on any number of cores."""
    libs = [lib for folder in ("numpy.libs", "numpy/.dylibs") for lib in (Path(np.__file__).resolve().parents[1] / folder).glob("*openblas*")]
    before = None
    for path in libs:
        lib = ctypes.CDLL(str(path))
        for stem in ("scipy_openblas_{}_num_threads64_", "scipy_openblas_{}_num_threads", "openblas_{}_num_threads64_", "openblas_{}_num_threads"):
            if hasattr(lib, stem.format("set")):
                before = (getattr(lib, stem.format("set")), getattr(lib, stem.format("get"))())
                before[0](1)
                break
    try:
        yield
    finally:
        if before:
            before[0](before[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F4(0.5) * (np.tanh(F4(0.5) * x) + F4(1))


def scattered(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Rows of values added up by their place."""
    flat = values.reshape(-1, values.shape[-1])
    return np.stack([np.bincount(at.ravel(), flat[:, k], rows) for k in range(flat.shape[1])], 1).astype(F4)


def padded(lengths: np.ndarray, width: int) -> np.ndarray:
    """The mask (time, sequence) of sequences of these lengths."""
    return np.arange(width)[:, None] < lengths[None, :]


def backwards(lengths: np.ndarray, width: int) -> np.ndarray:
    """Indices (time, sequence) that turn each sequence around inside its length; the padding stays."""
    t = np.arange(width)[:, None]
    return np.where(t < lengths, lengths - 1 - t, t)


def forward(x: np.ndarray, mask: np.ndarray, u: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States (time, sequence, H) from inputs x (time, sequence, 3H: update, reset, candidate) and recurrent weights u (H, 3H)."""
    steps, n, h3 = x.shape
    k = h3 // 3
    h, out = np.zeros((n, k), F4), np.empty((steps, n, k), F4)
    for t in range(steps):
        a = h @ u
        g = sigmoid(x[t, :, : 2 * k] + a[:, : 2 * k])
        z, r = g[:, :k], g[:, k:]
        c = np.tanh(x[t, :, 2 * k :] + r * a[:, 2 * k :])
        m = mask[t, :, None]
        new = np.where(m, c + z * (h - c), h)
        if tape is not None:
            tape.append((h, z, r, c, a[:, 2 * k :], m))
        h = out[t] = new
    return out


def backward(d: np.ndarray, u: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u from those of the states."""
    steps, n, k = d.shape
    dx, du, dh = np.zeros((steps, n, 3 * k), F4), np.zeros_like(u), np.zeros((n, k), F4)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, an, m = tape[t]
        full = dh + d[t]
        g = np.where(m, full, 0)
        dc = g * (1 - z) * (1 - c * c)
        dz = g * (h - c) * z * (1 - z)
        dr = dc * an * r * (1 - r)
        dx[t, :, :k], dx[t, :, k : 2 * k], dx[t, :, 2 * k :] = dz, dr, dc
        da = np.concatenate([dz, dr, dc * r], 1)
        du += h.T @ da
        dh = np.where(m, g * z + da @ u.T, full)
    return dx, du


def both_ways(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, uf: np.ndarray, ub: np.ndarray, tapes: tuple[list, list] | None = None) -> np.ndarray:
    """States of both directions side by side (time, sequence, 2H); x and y are the directions' inputs, both in reading order."""
    width = len(x)
    mask, turn = padded(lengths, width), backwards(lengths, width)
    cols = np.arange(x.shape[1])[None, :]
    f = forward(x, mask, uf, tapes and tapes[0])
    b = forward(y[turn, cols], mask, ub, tapes and tapes[1])
    return np.concatenate([f, b[turn, cols]], 2)


def both_ways_back(d: np.ndarray, lengths: np.ndarray, uf: np.ndarray, ub: np.ndarray, tapes: tuple[list, list]) -> tuple[np.ndarray, ...]:
    """Gradients of x, y, uf, ub."""
    width, n, k2 = d.shape
    turn, cols = backwards(lengths, width), np.arange(n)[None, :]
    dx, duf = backward(d[:, :, : k2 // 2], uf, tapes[0])
    dy, dub = backward(d[:, :, k2 // 2 :][turn, cols], ub, tapes[1])
    return dx, dy[turn, cols], duf, dub


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float) -> None:
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        rate = self.rate * scale * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * F4(clip)
            self.m[k] += F4(0.1) * (g - self.m[k])
            self.v[k] += F4(0.001) * (g * g - self.v[k])
            self.w[k] -= F4(rate) * self.m[k] / (np.sqrt(self.v[k]) + F4(1e-8))
