"""Distribution functions for already aggregated rows: Column expressions, and one vectorised function for Student's t."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Rational approximation of the normal tail (Hart 1968, as given by West 2005).
_TAIL_NUM = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_TAIL_DEN = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def _horner(coeffs, x: Column) -> Column:
    acc = F.lit(coeffs[0])
    for c in coeffs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_sf_abs(x: Column) -> Column:
    """P(Z > |x|)."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    near = e * _horner(_TAIL_NUM, a) / _horner(_TAIL_DEN, a)
    frac = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    far = e / frac / math.sqrt(2 * math.pi)
    return F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    tail = norm_sf_abs(x)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def erf(x: Column) -> Column:
    return 2.0 * norm_cdf(x * math.sqrt(2.0)) - 1.0


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive arguments: shifted upwards, then Stirling's series."""
    shift = np.zeros_like(x)
    x = x.copy()
    while (low := x < 12).any():
        shift[low] += np.log(x[low])
        x[low] += 1
    z = 1 / (x * x)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function for positive ``a``, ``b`` and ``x`` in [0, 1], by its continued fraction."""
    a, b, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(*np.atleast_1d(a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore"):
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c, total, m, open_ = np.ones_like(x), d.copy(), 0, np.ones(x.shape, bool)
    while open_.any():
        m += 1
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            total = np.where(open_, total * d * c, total)
        open_ &= np.abs(d * c - 1) > 1e-15
        open_ &= m < 100 + 20 * np.sqrt(a + b)  # far beyond the square root of the parameters, which suffices
    inside = np.where(x <= 0, 0.0, front * total)
    return np.where(swap, 1 - inside, inside)


@F.pandas_udf(DoubleType())
def t_p_one_sided(t: pd.Series, nu: pd.Series) -> pd.Series:
    """p-value of H1: mean > 0 for a t statistic with ``nu`` degrees of freedom; one row per tested group."""
    x, n = t.to_numpy(float), nu.to_numpy(float)
    known = np.isfinite(x) & (n >= 1)
    upper = np.full(len(x), np.nan)
    upper[known] = incomplete_beta(n[known] / 2, np.array(0.5), n[known] / (n[known] + x[known] ** 2)) / 2
    p = pd.Series(np.where(x > 0, upper, 1.0 - upper), index=t.index)
    return p.astype(object).where(known, None)


@F.pandas_udf(DoubleType())
def _binomial_tails(fewer: pd.Series, n: pd.Series) -> pd.Series:
    """Twice the chance of at most ``fewer`` heads in ``n`` fair throws, 1 at most; one row per tested group."""
    k, m = fewer.to_numpy(float), n.to_numpy(float)
    known = np.isfinite(k) & (m > 0)
    p = np.full(len(k), np.nan)
    p[known] = np.where(2 * k[known] >= m[known], 1.0, np.minimum(1.0, 2 * incomplete_beta(np.maximum(m[known] - k[known], 0.5), k[known] + 1, np.array(0.5))))
    return pd.Series(p, index=n.index).astype(object).where(known, None)


def t_test_p(mean: Column, std: Column, n: Column) -> Column:
    """One-sided one-sample t-test from mean, sample deviation and count.

    No spread: a positive mean is certain (0), a negative one impossible (1), a zero mean undefined (NULL).
    """
    t = F.try_divide(mean, std / F.sqrt(n.cast("double")))
    exact = F.when(mean > 0, F.lit(0.0)).when(mean < 0, F.lit(1.0))
    return F.when(n < 2, None).when(std == 0, exact).otherwise(t_p_one_sided(t, (n - 1).cast("long")))


def binomial_p_two_sided(wins: Column, n: Column) -> Column:
    """Chance of a win count at least as far from n/2 as the one seen, exact for every n; no trials give 1."""
    return F.when(n <= 0, F.lit(1.0)).otherwise(_binomial_tails(F.least(wins, n - wins).cast("double"), n.cast("double")))


def deflated_sharpe_p(mean: Column, std: Column, n: Column, trials: Column, benchmark: float = 0.0) -> Column:
    """Probability that the Sharpe ratio beats the best of ``trials`` lucky draws."""
    root = F.sqrt(F.greatest(n - 1, F.lit(1)).cast("double"))
    inflation = F.sqrt(2.0 * F.ln(F.greatest(trials, F.lit(2)).cast("double"))) / root
    z = (mean / std - (F.lit(benchmark) + inflation)) * root
    return F.when(std.isNull() | (std == 0), F.lit(0.0)).otherwise(norm_cdf(z))
