"""Tail probabilities and normal quantiles as column expressions: continued fractions and series are folds over their terms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMS = 500
# Lanczos's coefficients of the gamma function for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
           -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive value."""
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        series = series + F.lit(c) / (x + F.lit(float(i)))
    t = x + 6.5
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.ln(t) - t + F.ln(series)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function for x between 0 and 1, by its continued fraction in Lentz's form.

    The fraction converges on the near side of the mean; beyond it, the function is one less that of the other side.
    """
    far = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(far, b).otherwise(a), F.when(far, a).otherwise(b), F.when(far, 1 - x).otherwise(x)
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(v == 0, tiny).otherwise(v)
    first = 1 / safe(1 - (p + q) * y / (p + 1))

    def step(acc: Column, k: Column) -> Column:
        m = k.cast("double")
        odd = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        even = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d, c, total = acc["d"], acc["c"], acc["total"]
        for num in (odd, even):
            d, c = 1 / safe(1 + num * d), safe(1 + num / c)
            total = total * c * d
        return F.struct(d.alias("d"), c.alias("c"), total.alias("total"))

    start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("total"))
    fraction = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["total"])
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.ln(y) + q * F.log1p(-y)) / p
    inside = F.when(far, 1 - front * fraction).otherwise(front * fraction)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def student_p(t, df) -> Column:
    """Two-sided p-value of Student's t."""
    t, df = _col(t), _col(df)
    return F.when(t.isNotNull() & df.isNotNull(), incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t)))


def normal_p(z) -> Column:
    """Two-sided p-value of a standard normal value, at most 1: the complementary error function at z / √2.

    Near 0 from a series of positive terms, from 3 on by the continued fraction, taken from its end.
    """
    y = _col(z) / math.sqrt(2)
    near, far = F.least(y, F.lit(3.0)), F.greatest(y, F.lit(3.0))

    def term(acc: Column, k: Column) -> Column:
        size = acc["size"] * 2 * near * near / (2 * k.cast("double") + 1)
        return F.struct(size.alias("size"), (acc["total"] + size).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(near.alias("size"), near.alias("total")), term, lambda acc: acc["total"])
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), far, lambda acc, k: far + k.cast("double") / 2 / acc)
    root = math.sqrt(math.pi)
    close = 1 - 2 / root * F.exp(-near * near) * series
    return F.when(y <= 0, 1.0).when(y < 3, close).when(y.isNotNull(), F.exp(-far * far) / root / fraction)


# Coefficients of a published rational approximation of the inverse normal (relative error 1.2e-9).
A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)


def _horner(coefficients, x: Column, last: float | None = None) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out if last is None else out * x + last


def with_normal_quantile(df: DataFrame, p: str, out: str) -> DataFrame:
    """Add the inverse of the standard normal distribution at a column of probabilities.

    The centred value and the tail argument are columns of their own, so the polynomials refer to them by name.
    """
    low, q, r, t = 0.02425, F.col("_q"), F.col("_r"), F.col("_t")
    middle = _horner(A, r) * q / _horner(B, r, 1.0)
    tail = _horner(C, t) / _horner(D, t, 1.0)
    return (
        df.withColumn("_q", F.col(p) - 0.5).withColumn("_r", q * q)
        .withColumn("_t", F.sqrt(-2 * F.ln(F.least(F.col(p), 1 - F.col(p)))))
        .withColumn(out, F.when(F.col(p) < low, tail).when(F.col(p) > 1 - low, -tail).otherwise(middle))
        .drop("_q", "_r", "_t"))
