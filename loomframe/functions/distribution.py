"""The normal distribution and transforms of scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.functions.shipping import ships

ships(__name__)

#: Scores are kept this far from 0 and 1.
EPS = 1e-10


def clip(c: Column, eps: float = EPS) -> Column:
    return F.least(F.greatest(c, F.lit(eps)), F.lit(1 - eps))


def normal_pdf(x: Column, mean: Column | float = 0.0, sd: Column | float = 1.0) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * F.lit(math.sqrt(2 * math.pi)))


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function of a whole array, to about 1e-12 of its value: a series near 0, a continued fraction beyond."""
    x = np.asarray(x, float)
    a = np.minimum(np.abs(x), 40.0)
    term = np.minimum(a, 2.5)
    square, total = 2 * term * term, term.copy()
    near = term
    for n in range(80):
        term = term * square / (2 * n + 3)
        total = total + term
    series = 1 - 2 / math.sqrt(math.pi) * np.exp(-near * near) * total
    far = np.maximum(a, 2.5)
    tail = far.copy()
    for k in range(80, 0, -1):
        tail = far + (k / 2) / tail
    out = np.where(a < 2.5, series, np.exp(-far * far) / (math.sqrt(math.pi) * tail))
    return np.where(x < 0, 2 - out, out)


#: Coefficients of Acklam's rational approximation of the normal quantile (central and tail parts).
_CENTRE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
_TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))


def quantile(p: np.ndarray) -> np.ndarray:
    """The normal quantile of a whole array: an approximation, then two Halley steps; infinite at and beyond 0 and 1."""
    p = np.asarray(p, float)
    q = np.clip(np.minimum(p, 1 - p), 1e-300, 0.5)
    r = (q - 0.5) ** 2
    centre = np.polyval(_CENTRE[0], r) * (q - 0.5) / np.polyval(_CENTRE[1], r)
    t = np.sqrt(-2 * np.log(q))
    x = np.where(q < 0.02425, np.polyval(_TAIL[0], t) / np.polyval(_TAIL[1], t), centre)
    for _ in range(2):
        u = (0.5 * erfc(-x / math.sqrt(2)) - q) * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
        x = x - u / (1 + x * u / 2)
    x = np.where(p > 0.5, -x, x)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, np.where(np.isnan(p), np.nan, x)))


def _whole(f, c: Column | str) -> Column:
    """``f`` of whole Arrow batches as numpy arrays; null stays null."""

    def work(x: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float, na_value=np.nan))).where(x.notna().to_numpy())

    return F.pandas_udf(work, "double")(c)


def normal_cdf(x: Column | str) -> Column:
    return _whole(lambda v: 0.5 * erfc(-v / math.sqrt(2)), x)


def normal_ppf(p: Column | str) -> Column:
    return _whole(quantile, p)


def two_sided_p(z: Column | str) -> Column:
    return _whole(lambda v: erfc(np.abs(v) / math.sqrt(2)), z)


def transform_score(c: Column, how: str) -> Column:
    if how == "raw":
        return c
    if how == "log":
        return F.log1p(c + EPS)
    if how == "logit":
        p = clip(c)
        return F.log(p / (1 - p))
    if how == "probit":
        return normal_ppf(clip(c))
    raise ValueError(f"unknown transformation {how}")


def restore_score(c: Column, how: str) -> Column:
    if how == "raw":
        return c
    if how == "log":
        return F.expm1(c)
    if how == "logit":
        return 1 / (1 + F.exp(-c))
    if how == "probit":
        return normal_cdf(c)
    raise ValueError(f"unknown transformation {how}")


def restore_density(density: Column, x: Column, how: str) -> Column:
    """The density in the original space: divided by the derivative of the restored score."""
    if how == "raw":
        return density
    if how == "log":
        return density / F.exp(x)
    if how == "logit":
        s = 1 / (1 + F.exp(-x))
        return density / (s * (1 - s))
    if how == "probit":
        return density / normal_pdf(x)
    raise ValueError(f"unknown transformation {how}")
