"""Numeric column expressions mirroring the reference's R helpers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: two-sided 5% critical value of the standard normal.
Z_CRIT_05 = 1.959963984540054


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def signif(x: Column | str, digits: int = 2) -> Column:
    """R ``signif(x, digits)``: round to ``digits`` significant digits; 0 stays 0."""
    x = _c(x)
    e = F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), e - (digits - 1))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / scale, 0) * scale)


def r_round(x: Column | str, digits: int = 0) -> Column:
    """R ``round`` (half to even) on doubles."""
    return F.bround(_c(x), digits)


def sprintf3(prefix: str, x: Column | str) -> Column:
    """C ``sprintf("<prefix>%.3f", x)``: the double's exact value, rounded half to even.

    0.8125 and 0.0625 are exact halves and give 0.812 and 0.062; Java's own %.3f and round()
    would go up. Which side of a half the thousandfold lies on is decided on two parts of
    the double whose products with 1000 are exact.
    """
    x = _c(x).cast("double")
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    low = x - high
    floor = F.floor(x * 1000).cast("double")
    rest = (high * 1000 - (floor + 0.5)) + low * 1000
    up = (rest > 0) | ((rest == 0) & (floor % 2 == 1))
    return F.format_string(prefix + "%.3f", (floor + F.when(up, 1.0).otherwise(0.0)) / 1000)


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value ``2 * pnorm(-|z|)``; NULL z -> NULL."""
    vals = z.to_numpy(dtype="float64", na_value=np.nan)
    out = np.array([math.erfc(abs(v) / math.sqrt(2.0)) if not math.isnan(v) else np.nan
                    for v in vals])
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def student_t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t with (fractional) degrees of freedom.

    Uses the regularised incomplete beta function by continued fraction (numerical
    recipe, no scipy needed).
    """
    tv = t.to_numpy(dtype="float64", na_value=np.nan)
    dv = df.to_numpy(dtype="float64", na_value=np.nan)
    out = np.array([_t_p(a, b) for a, b in zip(tv, dv)])
    return pd.Series(out)


def _t_p(t: float, df: float) -> float:
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    x = df / (df + t * t)
    return _betai(df / 2.0, 0.5, x)


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 300):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c
        c = c if abs(c) > 1e-300 else 1e-300
        de = d * c
        h *= de
        if abs(de - 1.0) < 3e-16:
            break
    return h


def _betai(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
           + a * math.log(x) + b * math.log(1.0 - x))
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b
