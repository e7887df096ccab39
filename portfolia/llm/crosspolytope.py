"""Cross-polytope hashing: fast Hadamard pseudo-rotations and the nearest signed axes of a unit vector."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def padded(dim: int) -> int:
    """The power of two that holds ``dim`` components."""
    return 1 << max(1, (dim - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


@lru_cache(maxsize=512)
def _signs(d: int, no: int) -> np.ndarray:
    return np.random.default_rng([d, no, 77]).choice([-1.0, 1.0], size=(3, d))


def rotated(x: np.ndarray, no: int) -> np.ndarray:
    """Pseudo-rotation ``no`` of rows whose width is a power of two: signs and transform, three times."""
    for signs in _signs(x.shape[1], no):
        x = hadamard(x * signs)
    return x


def nearest_axes(x: np.ndarray, no: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of every row, nearest first; axis + d stands for the negative side."""
    y = rotated(x, no)
    both = np.concatenate([y, -y], axis=1)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    top = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(both, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1)


def codes(x: np.ndarray, table: int, width: int, probes: int) -> np.ndarray:
    """Bucket codes of every row in one table of ``width`` concatenated hashes: home first, then its probes.

    The probes change one hash at a time to its next axes, nearest ranks first.
    """
    d = x.shape[1]
    each = [nearest_axes(x, table * 16 + j, min(probes, 2 * d)) for j in range(width)]
    home = np.zeros(len(x), np.int64)
    for a in each:
        home = home * (2 * d) + a[:, 0]
    out = [home]
    for rank in range(1, min(probes, 2 * d)):
        for j, a in enumerate(each):
            if len(out) < probes:
                out.append(home + (a[:, rank] - a[:, 0]) * (2 * d) ** (width - 1 - j))
    return np.stack(out, axis=1)


@lru_cache(maxsize=64)
def meeting_chance(dim: int, width: int, probes: int, cosine: float, trials: int = 4000) -> float:
    """Share of random pairs at a cosine of which one's home is probed by the other, in one table."""
    rng, d = np.random.default_rng(5), padded(dim)
    u = rng.normal(size=(trials, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = rng.normal(size=(trials, dim))
    v -= (u * v).sum(axis=1, keepdims=True) * u
    v = cosine * u + math.sqrt(1 - cosine**2) * v / np.linalg.norm(v, axis=1, keepdims=True)
    wide = [np.pad(w, ((0, 0), (0, d - dim))) for w in (u, v)]
    a, b = (codes(w, 0, width, probes) for w in wide)
    return float(((a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)).mean())
