"""Shapiro-Wilk W and p-value (Royston 1992/1995 approximation, algorithm AS R94).

Runs on one bounded sample (≤ 500 values) inside a grouped ``applyInPandas``
task, never on a whole column.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_N = NormalDist()


def _poly(coefs, x):
    return sum(cf * x ** i for i, cf in enumerate(coefs))


def shapiro_wilk(values) -> tuple[float, float]:
    """(W, p) for a 1-D sample with 3 ≤ n ≤ 5000; (nan, nan) otherwise."""
    x = np.sort(np.asarray(values, dtype=float))
    x = x[~np.isnan(x)]
    n = len(x)
    if n < 3 or n > 5000:
        return float("nan"), float("nan")
    rng = x[-1] - x[0]
    if rng <= 0:
        return 1.0, 1.0
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        m = np.array([_N.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        mm = float(np.dot(m, m))
        u = 1.0 / math.sqrt(n)
        cn = m[-1] / math.sqrt(mm)
        an = cn + _poly([0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056], u)
        a = m / math.sqrt(mm)
        if n > 5:
            cn1 = m[-2] / math.sqrt(mm)
            an1 = cn1 + _poly([0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
            a = m / math.sqrt(phi)
            a[-1], a[-2], a[0], a[1] = an, an1, -an, -an1
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * an ** 2)
            a = m / math.sqrt(phi)
            a[-1], a[0] = an, -an
    xc = x - x.mean()
    w = float(np.dot(a, x) ** 2 / np.dot(xc, xc))
    w = min(w, 1.0)
    if n == 3:
        p = max(0.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
        return w, min(p, 1.0)
    if w >= 1.0:
        return 1.0, 1.0
    if n <= 11:
        gamma = 0.459 * n - 2.273
        mu = _poly([0.5440, -0.39978, 0.025054, -0.0006714], n)
        sigma = math.exp(_poly([1.3822, -0.77857, 0.062767, -0.0020322], n))
        arg = gamma - math.log(1 - w)
        if arg <= 0:
            return w, 0.0
        z = (-math.log(arg) - mu) / sigma
    else:
        ln = math.log(n)
        mu = _poly([-1.5861, -0.31082, -0.083751, 0.0038915], ln)
        sigma = math.exp(_poly([-0.4803, -0.082676, 0.0030302], ln))
        z = (math.log(1 - w) - mu) / sigma
    return w, 1.0 - _N.cdf(z)
