"""Statistical expressions. Each works as a plain aggregate or, with ``over``, in a frame."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def framed(expr: Column, over: WindowSpec | None) -> Column:
    return expr if over is None else expr.over(over)


def sample_skew(x: Column, over: WindowSpec | None = None) -> Column:
    """Bias-corrected skewness; 0 without spread, missing below 3 values."""
    n = framed(F.count(x), over).cast("double")
    spread = framed(F.var_pop(x), over)
    raw = framed(F.skewness(x), over)
    return F.when(
        n >= 3, F.when(spread > 0, raw * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(F.lit(0.0))
    )


def sample_kurtosis(x: Column, over: WindowSpec | None = None) -> Column:
    """Bias-corrected excess kurtosis; 0 without spread, missing below 4 values."""
    n = framed(F.count(x), over).cast("double")
    spread = framed(F.var_pop(x), over)
    raw = framed(F.kurtosis(x), over)
    return F.when(
        n >= 4,
        F.when(
            spread > 0, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * raw + F.lit(6.0))
        ).otherwise(F.lit(0.0)),
    )


def keep_missing(x: Column, expr: Column) -> Column:
    """``expr`` where ``x`` is present; greatest/least alone would turn missing into the bound."""
    return F.when(x.isNotNull(), expr)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def correlation(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson correlation over complete pairs; missing if either side is constant."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = framed(F.stddev_pop(a), over) * framed(F.stddev_pop(b), over)
    return F.try_divide(framed(F.covar_pop(x, y), over), F.when(spread > 1e-300, spread))


# One-row results only: Spark SQL has no erfc.
@F.udf(T.DoubleType())
def chi2_1_tail(x):
    return None if x is None else math.erfc(math.sqrt(max(x, 0.0) / 2.0))


@F.udf(T.DoubleType())
def normal_two_sided(z):
    return None if z is None else math.erfc(abs(z) / math.sqrt(2.0))


@F.udf(T.DoubleType())
def binomial_half_two_sided(k, n):
    """Exact two-sided test of k successes in n fair draws.

    The lower tail is a regularised incomplete beta function at 1/2. Its continued fraction takes
    about the square root of n steps and no memory.
    """
    if k is None or n is None:
        return None
    low = min(k, n - k)
    if n == 0 or 2 * low + 1 >= n:
        return 1.0  # the two tails cover everything
    a, b, x, tiny = float(n - low), low + 1.0, 0.5, 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1_000_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a + b) * math.log(0.5)
    return min(1.0, 2.0 * math.exp(front) * h / a)


@F.udf(T.DoubleType())
def chi2_tail(x, k):
    """Upper tail of the chi-squared law with k degrees of freedom (incomplete gamma)."""
    if x is None or k is None:
        return None
    a, y = k / 2.0, x / 2.0
    if y <= 0:
        return 1.0
    if y < a + 1:
        term = total = 1.0 / a
        i = a
        while abs(term) > abs(total) * 1e-15:
            i += 1
            term *= y / i
            total += term
        return 1.0 - total * math.exp(-y + a * math.log(y) - math.lgamma(a))
    tiny = 1e-300
    b = y + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-y + a * math.log(y) - math.lgamma(a)) * h
