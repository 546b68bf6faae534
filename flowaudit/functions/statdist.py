"""Normal, Student t and binomial distribution functions.

Scalars are evaluated once on the driver (confidence constants). The vector forms are
Arrow UDFs over result tables that hold one row per test, never over raw rows.
"""
from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_N = NormalDist()


def norm_cdf(x: float) -> float:
    return _N.cdf(x)


def norm_ppf(p: float) -> float:
    return _N.inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + num * d, 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def _bisect(f, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if f(mid) < 0:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t for p > 0.5."""
    return _bisect(lambda t: (1.0 - t_two_sided(t, df) / 2.0) - p, 0.0, 1e4)


def binom_ppf(q: float, n: int, p: float) -> int:
    """Smallest k with P(X <= k) >= q."""
    def cdf(k: int) -> float:
        return 1.0 if k >= n else 1.0 - beta_inc(k + 1.0, n - k, p)
    lo, hi = -1, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if cdf(mid) >= q else (mid, hi)
    return hi


def _column(fn, *cols) -> Column:
    """One call of a scalar function per row of a small result table."""
    @F.pandas_udf("double")
    def run(*xs: pd.Series) -> pd.Series:
        ok = np.ones(len(xs[0]), bool)
        for x in xs:
            ok &= x.notna().to_numpy()
        out = np.full(len(xs[0]), np.nan)
        for i in np.flatnonzero(ok):
            out[i] = fn(*[float(x.iloc[i]) for x in xs])
        return pd.Series(out).where(ok, None)
    return run(*cols)


def t_p_value(t: Column, df: Column) -> Column:
    return _column(lambda a, d: t_two_sided(a, d) if d > 0 else math.nan, t, df)


def norm_cdf_col(x: Column) -> Column:
    return _column(norm_cdf, x)


def norm_ppf_col(p: Column) -> Column:
    return _column(norm_ppf, p)


def t_quantile(n: Column, p: float = 0.975, n_max: int = 200) -> Column:
    """t quantile for n paired values: exact up to n_max, normal expansion above.

    The table is a literal array made from the rule above, so the lookup stays in the
    JVM; the expansion is within 1e-6 at n_max.
    """
    table = F.array(*[F.lit(t_ppf(p, k)) for k in range(1, n_max + 1)])
    z = norm_ppf(p)
    d = n.cast("double") - 1.0
    g1, g2 = (z ** 3 + z) / 4.0, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96.0
    big = F.lit(z) + F.lit(g1) / d + F.lit(g2) / (d * d)
    return F.when((n >= 2) & (n <= n_max + 1), F.element_at(table, (n - 1).cast("int"))) \
        .when(n > n_max + 1, big)
