"""Student t and F probabilities for small result tables."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
#: Degrees of freedom beyond which the normal distribution with one correction is exact to 1e-11.
_MANY = 1e6


def _log_beta(a, b) -> np.ndarray:
    """log of the beta function; differences of log gammas lose digits where one argument is large."""
    small, large = np.minimum(a, b), np.maximum(a, b)
    # gamma(large) / gamma(large + small) for large arguments: a series in 1 / middle.
    middle = large + (small - 1) / 2
    with np.errstate(all="ignore"):
        ratio = -small * np.log(middle) + small * (small * small - 1) / (24 * middle * middle)
    return np.where(
        (large > 1e5) & (small < 1e3), _lgamma(small) + ratio, _lgamma(a) + _lgamma(b) - _lgamma(a + b)
    )


def incomplete_beta(a, b, x, rest=None, terms: int = 2000) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction.

    ``rest`` is 1 - x, for callers that know it without a subtraction.
    """
    rest = 1 - np.asarray(x, dtype=float) if rest is None else rest
    a, b, x, rest = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x, rest)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, rest, x)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(
            -_log_beta(p, q)
            + p * np.log(np.maximum(z, tiny)) + q * np.log1p(-np.minimum(z, 1 - 1e-16))
        )
        c = np.ones_like(z)
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        value = d.copy()
        for m in range(1, terms):
            for step in (
                m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 + step * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + step / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                value *= d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        else:
            raise ArithmeticError("the continued fraction did not converge")
        tail = front * value / p
    return np.where(z <= 0, flip.astype(float), np.where(flip, 1 - tail, tail))


def t_two_sided(t, df) -> np.ndarray:
    """Probability that |T| exceeds |t|."""
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    many = df > _MANY
    few = np.where(many, 1.0, df)
    exact = incomplete_beta(few / 2, 0.5, few / (few + t * t), t * t / (few + t * t))
    normal = np.abs(t) * (1 - 1 / (4 * df)) / np.sqrt(1 + t * t / (2 * df))
    return np.where(many, _erfc(normal / math.sqrt(2)), exact)


def f_upper(f, df1, df2) -> np.ndarray:
    """Probability that F exceeds f."""
    f, df1, df2 = (np.asarray(v, dtype=float) for v in (f, df1, df2))
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f), df1 * f / (df2 + df1 * f))


def t_quantile(prob: float, df) -> np.ndarray:
    """Quantile of the t distribution for ``prob`` above one half.

    Newton steps on the convex upper tail, from a normal quantile with its first
    correction terms.
    """
    df = np.asarray(df, dtype=float)
    z = NormalDist().inv_cdf(prob)
    t = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
    log_scale = -_log_beta(df / 2, 0.5) - 0.5 * np.log(df)
    for _ in range(100):
        slope = 2 * np.exp(log_scale - (df + 1) / 2 * np.log1p(t * t / df))
        step = (t_two_sided(t, df) - 2 * (1 - prob)) / slope
        step = np.where(df > _MANY, 0.0, step)  # there the first terms are exact
        t = np.maximum(t + step, 1e-12)
        if np.all(np.abs(step) <= 1e-12 * t):
            return t
    raise ArithmeticError("the quantile did not converge")


def t_p_value(t: Column | str, df: Column | str) -> Column:
    """Two-sided p-value as a column; meant for result tables of a few rows."""

    @F.pandas_udf(DoubleType())
    def compute(t: pd.Series, df: pd.Series) -> pd.Series:
        ok = t.notna() & df.notna() & (df > 0)
        out = pd.Series(np.nan, index=t.index)
        out[ok] = t_two_sided(t[ok].to_numpy(), df[ok].to_numpy())
        return out.where(ok, None)

    return F.nanvl(compute(t, df), F.lit(None).cast("double"))


def f_p_value(f: Column | str, df1: Column | str, df2: Column | str) -> Column:
    """Upper-tail p-value of F as a column."""

    @F.pandas_udf(DoubleType())
    def compute(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
        ok = f.notna() & (df1 > 0) & (df2 > 0)
        out = pd.Series(np.nan, index=f.index)
        out[ok] = f_upper(f[ok].to_numpy(), df1[ok].to_numpy(), df2[ok].to_numpy())
        return out

    return F.nanvl(compute(f, df1, df2), F.lit(None).cast("double"))


def t_critical(df: Column | str, level: float = 0.95) -> Column:
    """Half-width factor of a confidence interval as a column."""

    @F.pandas_udf(DoubleType())
    def compute(df: pd.Series) -> pd.Series:
        ok = df.notna() & (df > 0)
        out = pd.Series(np.nan, index=df.index)
        out[ok] = t_quantile(0.5 + level / 2, df[ok].to_numpy())
        return out

    return F.nanvl(compute(df), F.lit(None).cast("double"))
