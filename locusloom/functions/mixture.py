"""Upper tails of weighted sums of chi-squared variables.

The characteristic function is inverted numerically (Davies), with bounds for both of
its errors. Where that can't reach its accuracy in a bounded number of terms, or the
tail is smaller than the accuracy is worth, the saddlepoint approximation is taken.
"""

from __future__ import annotations

import math

import numpy as np

from .distributions import chi2_1_sf

#: Absolute errors of the inversion, the first that it can reach is taken; how much larger a tail must be; most terms x weights.
ACCURACIES, TIMES, MOST_TERMS = (1e-11, 1e-9, 1e-7, 1e-6), 1e3, 1 << 24


def mixture_tail(q: float, weights: np.ndarray, degrees: np.ndarray | None = None) -> float:
    """P(sum of weights x chi2(degrees) > q); one degree of freedom each by default, fractions too."""
    w = np.asarray(weights, float)
    h = np.ones(len(w)) if degrees is None else np.asarray(degrees, float)
    use = (w > 1e-9 * max(w[h > 0].max(initial=0.0), 1e-300)) & (h > 0)
    w, h = w[use], h[use]
    if not len(w) or q <= 0:
        return 1.0
    if len(w) == 1 and h[0] == 1:
        return chi2_1_sf(q / w[0])
    for accuracy in ACCURACIES:
        p = inverted(q, w, h, accuracy)
        if p is not None:
            return float(min(p, 1.0)) if p > TIMES * accuracy else saddlepoint(q, w, h)
    return saddlepoint(q, w, h)


def inverted(q: float, w: np.ndarray, h: np.ndarray, accuracy: float) -> float | None:
    """The tail by a sum over the characteristic function; None if that takes more than MOST_TERMS."""
    scale = math.sqrt(2 * (h * w**2).sum())
    w, q = w / scale, q / scale
    # the step: beyond q + 2 pi / step there is less than the accuracy, by Chernoff's bound, and below q - 2 pi / step nothing
    t = 0.25 / w.max()
    beyond = (-0.5 * (h * np.log1p(-2 * t * w)).sum() - math.log(accuracy)) / t
    step = 2 * math.pi / max(beyond - q, q)
    logs = lambda u: -0.25 * (h * np.log1p(4 * u * u * w**2)).sum()
    slope = lambda u: (h * (4 * u * u * w**2) / (1 + 4 * u * u * w**2)).sum()
    # the last point: the sum beyond it is bounded by the modulus there, which falls at least as fast as a power
    high = step
    while logs(high) + math.log(2 / math.pi / max(slope(high), 1e-300)) > math.log(accuracy):
        high *= 1.2
        if high / step * len(w) > MOST_TERMS:
            return None
    total, n = 0.0, int(high / step) + 1
    for start in range(0, n, 4096):
        k = np.arange(start, min(n, start + 4096)) + 0.5
        u = (k * step)[:, None]
        modulus, angle = -0.25 * (h * np.log1p(4 * u * u * w**2)).sum(1), 0.5 * (h * np.arctan(2 * u * w)).sum(1) - k * step * q
        total += (np.exp(modulus) * np.sin(angle) / (math.pi * k)).sum()
    return 0.5 + total


def saddlepoint(q: float, w: np.ndarray, h: np.ndarray) -> float:
    """The tail by Lugannani and Rice, with a moment match near the mean."""
    k0 = lambda t: -0.5 * (h * np.log1p(-2 * t * w)).sum()
    k1 = lambda t: (h * w / (1 - 2 * t * w)).sum()
    low, high = -0.5 * h.sum() / q - 1 / w.max(), 0.5 / w.max() * (1 - 1e-14)
    while k1(low) > q:
        low *= 2
    for _ in range(200):
        t = (low + high) / 2
        low, high = (t, high) if k1(t) < q else (low, t)
    mean, var, third = (h * w).sum(), 2 * (h * w**2).sum(), 8 * (h * w**3).sum()
    if abs(t) * math.sqrt(var) < 1e-4:
        skew = third / var**1.5
        df = 8 / skew**2
        z = ((q - mean) / math.sqrt(var) * math.sqrt(2 * df) + df) / df
        x = (z ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
        return 0.5 * math.erfc(x / math.sqrt(2))
    k2 = (2 * h * w**2 / (1 - 2 * t * w) ** 2).sum()
    r = math.copysign(math.sqrt(max(0.0, 2 * (t * q - k0(t)))), t)
    v = t * math.sqrt(k2)
    z = r + math.log(v / r) / r
    return 0.5 * math.erfc(z / math.sqrt(2))
