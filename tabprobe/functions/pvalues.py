"""Tail probabilities for the test statistics (scipy is not a dependency).

Regularised incomplete beta and gamma functions by Lentz continued fractions
(the textbook forms), the normal tail by ``math.erfc``. They run on one scalar
per feature (small per-feature tables), through a vectorised pandas UDF.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_EPS = 1e-15
_TINY = 1e-300


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        de = d * c
        h *= de
        if abs(de - 1.0) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def gammaincc(s: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(s, x)."""
    if x <= 0:
        return 1.0
    lg = math.lgamma(s)
    if x < s + 1.0:
        ap, total, delta = s, 1.0 / s, 1.0 / s
        for _ in range(100_000):
            ap += 1.0
            delta *= x / ap
            total += delta
            if abs(delta) < abs(total) * _EPS:
                break
        return max(0.0, 1.0 - total * math.exp(-x + s * math.log(x) - lg))
    b = x + 1.0 - s
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - s)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        de = d * c
        h *= de
        if abs(de - 1.0) < _EPS:
            break
    return math.exp(-x + s * math.log(x) - lg) * h


def t_two_sided(t: float, dof: float) -> float:
    if t is None or dof is None or not (dof > 0) or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    if f is None or math.isnan(f) or not (d1 > 0 and d2 > 0):
        return float("nan")
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf(x: float, k: float) -> float:
    if x is None or math.isnan(x) or not (k > 0):
        return float("nan")
    return gammaincc(k / 2.0, x / 2.0)


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


# ── column forms (vectorised pandas UDFs over small per-feature tables) ───────

def _vec(fn, *series):
    out = [fn(*(None if pd.isna(v) else float(v) for v in vals)) if not any(pd.isna(v) for v in vals) else np.nan
           for vals in zip(*series)]
    return pd.Series(out, dtype="float64")


def _t_pd(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _vec(t_two_sided, t, dof)


def _f_pd(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _vec(f_sf, f, d1, d2)


def _chi2_pd(x: pd.Series, k: pd.Series) -> pd.Series:
    return _vec(chi2_sf, x, k)


def _norm2_pd(z: pd.Series) -> pd.Series:
    return _vec(lambda v: min(1.0, 2.0 * norm_sf(abs(v))), z)


# UDF objects are built at call time: a module-level pandas_udf would need a
# SparkContext when the Python worker imports this module.
def p_t(t: Column, dof: Column) -> Column:
    return F.pandas_udf(_t_pd, "double")(t.cast("double"), dof.cast("double"))


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return F.pandas_udf(_f_pd, "double")(f.cast("double"), d1.cast("double"), d2.cast("double"))


def p_chi2(x: Column, k: Column) -> Column:
    return F.pandas_udf(_chi2_pd, "double")(x.cast("double"), k.cast("double"))


def p_norm2(z: Column) -> Column:
    return F.pandas_udf(_norm2_pd, "double")(z.cast("double"))
