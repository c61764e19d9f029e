"""Counter-based binomial and multinomial draws.

Uniform numbers are words of an md5 over the seed, the draw, the cell and the attempt.
A binomial with a mean below ``SMALL_MEAN`` is found by inversion of its distribution,
a larger one by transformed rejection with squeeze (W. Hoermann, 1993), whose attempts
are numbered: the first accepted one counts.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

SMALL_MEAN = 10.0
MOST_ATTEMPTS = 40  # each is accepted with probability 0.75 and more
_EXACT = np.array([math.lgamma(k + 1.0) for k in range(64)])


def log_factorial(k: np.ndarray) -> np.ndarray:
    """ln k!, by a table and by Stirling's series beyond it."""
    x = np.maximum(k, 1).astype(np.float64) + 1.0
    inverse = 1.0 / (x * x)
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (
        1 / 12 - (1 / 360 - (1 / 1260 - inverse / 1680) * inverse) * inverse) / x
    return np.where(k < len(_EXACT), _EXACT[np.clip(k, 0, len(_EXACT) - 1).astype(np.int64)], series)


def uniforms(prefix: str, draws: np.ndarray, cell: int, attempt: int) -> np.ndarray:
    """Two numbers inside (0, 1) for each draw, as columns."""
    words = b"".join(hashlib.md5(f"{prefix}|{d}|{cell}|{attempt}".encode()).digest()[:8] for d in draws.tolist())
    return (np.frombuffer(words, ">u4").reshape(-1, 2) + 0.5) / 4294967296.0


def _inverted(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """Smallest k whose distribution function reaches ``u``."""
    k = np.zeros(len(n), np.int64)
    mass = np.exp(n * math.log(1.0 - p))
    total = mass.copy()
    while True:
        below = (total < u) & (k < n)
        if not below.any():
            return k
        mass = np.where(below, mass * (n - k) / (k + 1.0) * (p / (1.0 - p)), mass)
        k += below
        total = np.where(below, total + mass, total)


def _rejected(n: np.ndarray, p: float, prefix: str, draws: np.ndarray, cell: int) -> np.ndarray:
    """The first accepted attempt of each draw."""
    found = np.zeros(len(n), np.int64)
    left = np.arange(len(n))
    for attempt in range(MOST_ATTEMPTS):
        m = n[left].astype(np.float64)
        spread = np.sqrt(m * p * (1.0 - p))
        b = 1.15 + 2.53 * spread
        a = -0.0873 + 0.0248 * b + 0.01 * p
        mode = np.floor((m + 1.0) * p)
        u, v = uniforms(prefix, draws[left], cell, attempt).T
        u = u - 0.5
        us = 0.5 - np.abs(u)
        k = np.floor((2.0 * a / us + b) * u + m * p + 0.5)
        inside = (k >= 0) & (k <= m)
        safe = np.where(inside, k, 0)
        bound = (log_factorial(mode) + log_factorial(m - mode) - log_factorial(safe) - log_factorial(m - safe)
                 + (safe - mode) * math.log(p / (1.0 - p)))
        height = np.log(v * (2.83 + 5.1 / b) * spread / (a / (us * us) + b))
        taken = ((us >= 0.07) & (v <= 0.92 - 4.2 / b)) | (inside & (height <= bound))
        found[left[taken]] = k[taken].astype(np.int64)
        left = left[~taken]
        if not len(left):
            return found
    raise RuntimeError("no attempt was accepted")


def binomial(n: np.ndarray, q: float, prefix: str, draws: np.ndarray, cell: int) -> np.ndarray:
    """A binomial (n, q) count for each of the numbered draws."""
    if q >= 1.0:
        return n.copy()
    p = min(q, 1.0 - q)
    small = n * p < SMALL_MEAN
    x = np.zeros(len(n), np.int64)
    if small.any():
        x[small] = _inverted(n[small], p, uniforms(prefix, draws[small], cell, 0)[:, 0])
    if not small.all():
        x[~small] = _rejected(n[~small], p, prefix, draws[~small], cell)
    return n - x if q > 0.5 else x


def multinomial_counts(weights: np.ndarray, draws: np.ndarray, prefix: str) -> np.ndarray:
    """draws x cells: counts of drawing ``weights.sum()`` rows with replacement."""
    rest = np.cumsum(weights[::-1])[::-1]
    left = np.full(len(draws), int(weights.sum()), np.int64)
    counts = np.zeros((len(draws), len(weights)), np.int64)
    for i, (weight, total) in enumerate(zip(weights.tolist(), rest.tolist())):
        counts[:, i] = binomial(left, weight / total, prefix, draws, i + 1)
        left = left - counts[:, i]
    return counts
