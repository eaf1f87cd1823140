"""Distribution helpers used inside tasks and on small result tables."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x)
                     - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b))
    if x < (a + 1) / (a + b + 2):
        return front * beta_fraction(a, b, x) / a
    return 1.0 - front * beta_fraction(b, a, 1 - x) / b


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p value of a correlation coefficient by the t distribution."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return beta_inc((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def random_places(rng: np.random.Generator, draws: int, n_pos: int, n_total: int) -> np.ndarray:
    """``draws`` uniform subsets of ``n_pos`` of ``n_total`` places, each in rising order, in O(n_pos) a draw.

    Places are drawn with replacement and sorted; those that repeat are drawn anew until none does. That is drawing
    one after the other and passing over places already taken, so every subset is equally likely.
    """
    kind = np.int32 if n_total < 2**31 else np.int64
    out = np.sort(rng.integers(0, n_total, (draws, n_pos), dtype=kind), axis=1)
    open_rows = np.arange(draws)
    while len(open_rows) and n_pos > 1:
        part = out[open_rows]
        again = np.zeros(part.shape, bool)
        again[:, 1:] = part[:, 1:] == part[:, :-1]
        hit = again.any(axis=1)
        open_rows, part, again = open_rows[hit], part[hit], again[hit]
        if len(open_rows):
            part[again] = rng.integers(0, n_total, int(again.sum()), dtype=kind)
            out[open_rows] = np.sort(part, axis=1)
    return out


@lru_cache(maxsize=256)
def null_draws(n_pos: int, n_total: int, size: int, seed: int) -> np.ndarray:
    """Average precision of ``size`` random rankings; the same for the same arguments."""
    rng = np.random.default_rng([seed, n_pos, n_total])
    place = np.arange(1, n_pos + 1)
    if n_pos == n_total:
        return np.ones(size)
    harmonics = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, n_total + 1))]) if 2 * n_pos > n_total else None
    out, done = np.empty(size), 0
    while done < size:
        chunk = min(size - done, max(1, 4_000_000 // min(n_pos, n_total - n_pos)))
        if 2 * n_pos <= n_total:
            spots = random_places(rng, chunk, n_pos, n_total)
            out[done:done + chunk] = (place / (spots + 1)).mean(axis=1)
        else:  # the places that stay free are the fewer ones: between two of them the precisions add up to harmonic numbers
            free = random_places(rng, chunk, n_total - n_pos, n_total)
            ends = np.concatenate([free[:, 1:], np.full((chunk, 1), n_total, free.dtype)], axis=1)
            misses = (harmonics[ends] - harmonics[free + 1]) @ np.arange(1.0, n_total - n_pos + 1)
            out[done:done + chunk] = 1 - misses / n_pos
        done += chunk
    return out


def exceeding(shapes: tuple[tuple[int, int, int], ...], values: np.ndarray, size: int, seed: int) -> np.ndarray:
    """How many of ``size`` draws of the mean over ``shapes`` (positives, total, members) exceed each value."""
    weight = sum(n for _, _, n in shapes)
    null = np.sort(sum(null_draws(p, t, size, seed) * (n / weight) for p, t, n in sorted(shapes)))
    return size - np.searchsorted(null, values + 1e-12, "right")
