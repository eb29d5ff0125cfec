"""Tail probabilities for small result tables (t, F, normal, chi-square)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_fraction(a, b, x, rounds: int = 300):
    """Continued fraction of the incomplete beta function, element by element."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h




def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)  # made anew: one that was called cannot be pickled


def _erfc(x):
    return np.vectorize(math.erfc, otypes=[float])(x)


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = inner < (a + 1) / (a + b + 2)
    left = front * beta_fraction(a, b, inner) / a
    right = 1 - front * beta_fraction(b, a, 1 - inner) / b
    value = np.where(low, left, right)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def t_two_sided(t, df):
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


def normal_cdf(z):
    return 0.5 * _erfc(-np.asarray(z, dtype=float) / math.sqrt(2))


def _known(function, *columns: pd.Series) -> pd.Series:
    frame = pd.concat([c.astype(float) for c in columns], axis=1)
    good = np.isfinite(frame.to_numpy()).all(axis=1)
    out = np.full(len(frame), np.nan)
    if good.any():
        out[good] = function(*frame.to_numpy()[good].T)
    return pd.Series(out).where(good, None).astype("float64")


@F.pandas_udf(T.DoubleType())
def _t_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _known(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def _f_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _known(f_upper, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def _normal_udf(z: pd.Series) -> pd.Series:
    return _known(normal_cdf, z)


def _null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic."""
    return _null(_t_udf(t.cast("double"), df.cast("double")))


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """Upper p of an F statistic."""
    return _null(_f_udf(f.cast("double"), d1.cast("double"), d2.cast("double")))


def normal(z: Column) -> Column:
    """Standard normal distribution function."""
    return _null(_normal_udf(z.cast("double")))


def chi2_even(x: Column, df: int) -> Column:
    """Upper chi-square tail for an even number of degrees of freedom, in closed form."""
    half, term, total = x / 2, F.lit(1.0), F.lit(1.0)
    for i in range(1, df // 2):
        term = term * half / i
        total = total + term
    return F.exp(-half) * total


# Response surface of the unit-root tau with a constant, and level-stationarity table.
ADF_LARGE, ADF_SMALL, ADF_STAR = 2.74, -18.83, -1.61
ADF_LOW = (2.1659, 1.4412, 0.038269)
ADF_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)
KPSS_TABLE = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def adf_p(tau: Column) -> Column:
    """p-value of the unit-root tau statistic."""

    def surface(coefficients):
        total, power = F.lit(0.0), F.lit(1.0)
        for c in coefficients:
            total, power = total + power * c, power * tau
        return normal(total)

    return (
        F.when(tau > ADF_LARGE, 1.0)
        .when(tau < ADF_SMALL, 0.0)
        .when(tau <= ADF_STAR, surface(ADF_LOW))
        .otherwise(surface(ADF_HIGH))
    )


def kpss_p(statistic: Column) -> Column:
    """p-value by linear interpolation of the table, clamped at its ends."""
    (x0, p0), (xn, pn) = KPSS_TABLE[0], KPSS_TABLE[-1]
    out = F.when(statistic.isNull(), None).when(statistic <= x0, p0).when(statistic >= xn, pn)
    for (a, pa), (b, pb) in zip(KPSS_TABLE, KPSS_TABLE[1:]):
        out = out.when(statistic <= b, pa + (pb - pa) * (statistic - a) / (b - a))
    return out


def adf_p_value(tau: float) -> float:
    """:func:`adf_p` of one number; NaN stays."""
    if tau != tau:
        return math.nan
    if tau > ADF_LARGE or tau < ADF_SMALL:
        return float(tau > ADF_LARGE)
    return float(normal_cdf(np.polynomial.polynomial.polyval(tau, ADF_LOW if tau <= ADF_STAR else ADF_HIGH)))


def kpss_p_value(statistic: float) -> float:
    """:func:`kpss_p` of one number; NaN stays."""
    return math.nan if statistic != statistic else float(np.interp(statistic, *zip(*KPSS_TABLE)))
