"""Distribution functions over already aggregated rows: Student t, normal, F."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    tiny = 1e-300
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(1000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + num * d if abs(1.0 + num * d) > tiny else tiny)
        c = 1.0 + num / c if abs(1.0 + num / c) > tiny else tiny
        f *= c * d
        if i and abs(c * d - 1.0) < 1e-15:
            break
    return front * (f - 1.0)


def t_two_sided(t: float | None, df: float | None) -> float | None:
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return None
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float | None) -> float | None:
    return None if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def f_upper(f: float | None, d1: float | None, d2: float | None) -> float | None:
    if None in (f, d1, d2) or any(map(math.isnan, (f, d1, d2))) or d1 <= 0 or d2 <= 0:
        return None
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def z_p(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided(a) for a in z], dtype="float64")


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_upper(a, b, c) for a, b, c in zip(f, d1, d2, strict=True)], dtype="float64")
