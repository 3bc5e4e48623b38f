"""Locally weighted regression (Cleveland 1979): tricube weights, linear fits, bisquare robustness iterations."""

from __future__ import annotations

import numpy as np

#: Numbers of a block of windows that are held at once.
HELD = 1 << 20


def windows(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted x, where the k nearest ones begin, and the distance of the farthest of these."""
    n = len(x)
    low, high = np.maximum(0, np.arange(n) - k + 1), np.minimum(np.arange(n), n - k)
    while (low < high).any():  # the first place from which going right brings nothing nearer
        middle = (low + high) // 2
        right = (low < high) & (x - x[middle] > x[np.minimum(middle + k, n - 1)] - x)
        low, high = np.where(right, middle + 1, low), np.where(right | (low == high), high, middle)
    return low, np.maximum(x - x[low], x[low + k - 1] - x)


def lowess(x: np.ndarray, y: np.ndarray, frac: float, iterations: int = 3) -> np.ndarray:
    """Fitted values at each x. Only a place's k nearest ones have weight, and they are neighbours once x is sorted, so
    a fit takes n * k steps and holds a block of windows at a time."""
    order = np.argsort(np.asarray(x, float), kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    n = len(x)
    if not n:
        return y
    k = max(2, min(n, int(frac * n + 1e-10))) if n > 1 else 1
    begin, reach = windows(x, k)
    # where more than k share a place, all of them are at no distance
    same = np.searchsorted(x, x, side="left"), np.searchsorted(x, x, side="right")
    wide = max(k, int((same[1] - same[0])[reach == 0].max(initial=0)))
    begin = np.minimum(np.where(reach == 0, same[0], begin), n - wide)
    robust, fitted = np.ones(n), y.copy()
    for _ in range(iterations + 1):
        for a in range(0, n, max(1, HELD // wide)):
            at = np.arange(a, min(n, a + max(1, HELD // wide)))
            near = begin[at, None] + np.arange(wide)
            far = np.abs(x[near] - x[at, None])
            d = reach[at, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                w = np.where(d > 0, np.where(far < d * 0.999, (1 - (far / d) ** 3) ** 3, 0.0), (far == 0) * 1.0) * robust[near]
                total = w.sum(1)
                w = w / total[:, None]
                mx, my = (w * x[near]).sum(1), (w * y[near]).sum(1)
                off = x[near] - mx[:, None]
                spread = (w * off**2).sum(1)
                slope = np.where(spread > 1e-12, (w * off * (y[near] - my[:, None])).sum(1) / spread, 0.0)
            fitted[at] = np.where(total > 0, my + slope * (x[at] - mx), y[at])
        rest = np.abs(y - fitted)
        scale = 6 * np.median(rest)
        if scale <= 0:
            break
        robust = np.where(rest < scale, (1 - (rest / scale) ** 2) ** 2, 0.0)
    out = np.empty(n)
    out[order] = fitted
    return out
