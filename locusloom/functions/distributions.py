"""Distribution functions for p-values by ``math``, with Spark forms for tables of one row a test, and the normal quantile as a column."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bound of the quantile transform: the normal quantile of 1e-7, either way.
CLIP = 5.199337582605575

# Wichura's rational approximation of the normal quantile (AS 241), highest power first. Within 0.425 of 0.5:
CENTRE = (
    (2.509080928730122672e3, 3.343057558358812810e4, 6.726577092700870085e4, 4.592195393154987145e4, 1.373169376550946112e4, 1.971590950306551442e3, 1.331416678917843774e2, 3.387132872796366608e0),
    (5.226495278852854561e3, 2.872908573572194267e4, 3.930789580009271061e4, 2.121379430158659586e4, 5.394196021424751107e3, 6.871870074920579083e2, 4.231333070160091125e1, 1.0),
)
# Beyond it, up to tails of exp(-25), which lie outside of CLIP:
TAIL = (
    (7.745450142783414076e-4, 2.272384498926918458e-2, 2.417807251774506117e-1, 1.270458252452368382e0, 3.647848324763204605e0, 5.769497221460691405e0, 4.630337846156545295e0, 1.423437110749683577e0),
    (1.050750071644416843e-9, 5.475938084995344946e-4, 1.519866656361645719e-2, 1.481039764274800745e-1, 6.897673349851000045e-1, 1.676384830183803849e0, 2.053191626637758821e0, 1.0),
)


def chi2_1_sf(t: float) -> float:
    """Upper tail of chi-squared with one degree of freedom."""
    return math.erfc(math.sqrt(max(t, 0.0) / 2))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return betainc(df / 2, 0.5, df / (df + t * t))


def beta_pdf(x: float, a: float, b: float) -> float:
    if not 0 < x < 1:
        return b if x == 0 and a == 1 else 0.0
    return math.exp((a - 1) * math.log(x) + (b - 1) * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))


def udf_of(f, n: int = 1):
    """A pandas UDF of n double columns; null where an argument is null."""

    @F.pandas_udf("double")
    def applied(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            yield pd.Series([None if any(pd.isna(v) for v in x) else f(*x) for x in zip(*columns, strict=True)], dtype="float64")

    @F.pandas_udf("double")
    def single(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series([None if pd.isna(v) else f(v) for v in column], dtype="float64")

    return single if n == 1 else applied


def chi2_sf(column):
    return udf_of(chi2_1_sf)(column)


def t_pvalue(t, df):
    return udf_of(t_sf2, 2)(t, df)


def ratio(coefficients: tuple[tuple[float, ...], tuple[float, ...]], r: Column) -> Column:
    """One polynomial of r over another."""
    over, under = (reduce(lambda total, c: total * r + F.lit(c), rest, F.lit(first)) for first, *rest in coefficients)
    return over / under


def normal_quantile(p: Column) -> Column:
    """The normal quantile of p, clipped to +-CLIP; null for null. A column expression."""
    q = p - 0.5
    centre = q * ratio(CENTRE, F.lit(0.180625) - q * q)
    tail = ratio(TAIL, F.sqrt(-F.log(F.least(p, 1 - p))) - 1.6)
    inside = F.when(F.abs(q) <= 0.425, centre).when(q < 0, -tail).otherwise(tail)
    return F.when(p <= 1e-7, -CLIP).when(p >= 1 - 1e-7, CLIP).otherwise(inside)
