"""Special functions for arrays: shift the argument up, then an asymptotic series."""

from __future__ import annotations

import numpy as np

_SHIFT = 8


def digamma(x):
    x = np.asarray(x, dtype=float)
    low = sum(1.0 / (x + i) for i in range(_SHIFT))
    z = x + _SHIFT
    i2 = 1.0 / (z * z)
    series = i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 * (1 / 240 - i2 / 132))))
    return np.log(z) - 0.5 / z - series - low


def trigamma(x):
    x = np.asarray(x, dtype=float)
    low = sum(1.0 / (x + i) ** 2 for i in range(_SHIFT))
    z = x + _SHIFT
    i1 = 1.0 / z
    i2 = i1 * i1
    return i1 + i2 / 2 + i1 * i2 * (1 / 6 - i2 * (1 / 30 - i2 * (1 / 42 - i2 / 30))) + low


def gammaln(x):
    x = np.asarray(x, dtype=float)
    low = sum(np.log(x + i) for i in range(_SHIFT))
    z = x + _SHIFT
    i2 = 1.0 / (z * z)
    series = (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - low


def uniform(keys: np.ndarray, draw: int, seed: int) -> np.ndarray:
    """Uniform numbers fixed by row key, draw and seed, the same on every retry."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((draw * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(float) / 2.0**53


def normal(keys: np.ndarray, draw: int, seed: int) -> np.ndarray:
    """Standard normal numbers fixed by row key, draw and seed."""
    u = np.maximum(uniform(keys, draw, seed), 2.0**-53)
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * uniform(keys, draw, seed + 0x5BD1E995))


def beta_share(a, b, x):
    """Regularised incomplete beta function I_x(a, b), by its continued fraction on the side where that converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    turn = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inside = (x > 0) & (x < 1)
    z = np.where(inside, x, 0.5)
    front = np.exp(gammaln(a + b) - gammaln(a) - gammaln(b) + a * np.log(z) + b * np.log1p(-z)) / a
    tiny = 1e-300
    c, d = np.ones_like(z), 1 / np.where(np.abs(g := 1 - (a + b) * z / (a + 1)) < tiny, tiny, g)
    value = d.copy()
    for m in range(1, 10_000):
        for term in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            value = value * c * d
        if (np.abs(c * d - 1) < 1e-14).all():
            break
    share = np.where(inside, front * value, x)
    return np.where(turn, 1 - share, share)
