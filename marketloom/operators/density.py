"""Gaussian kernel densities by the fast Gauss transform: rows become moments of cells, cells meet grid points.

With t = (x - c)/δ and s = (r - c)/δ, δ = √2 times the width, a kernel around a row r of a cell with centre c is the sum over n of
``s^n / n! · H_n(t) · exp(-t²)`` with Hermite's polynomials H_n. So a cell needs the sums of s^n over its rows, from one aggregate,
and no row ever meets a point; the number of cells follows from the range in widths, not from the rows.

Cut off after the term N - 1, the error of a row is at most ``1.09² Σ (a√2)^n / √n!`` over the terms left out (Cramér's bound), where a
is half a cell's side in δ. One dimension: a = 1/4 and 16 terms, below 1e-13. Two: a = 1/8 and all terms of a total degree below
12, below 1e-10. Kernels beyond 6.5 δ are below 1e-16 and count as 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMS, HALF_SIDE = 16, 0.25
TERMS_2D, HALF_SIDE_2D = 12, 0.125
REACH = 6.5
_ROOT = math.sqrt(2 * math.pi)


@lru_cache(maxsize=None)
def hermite(n: int) -> tuple[int, ...]:
    """Coefficients of H_n from the constant on."""
    if n == 0:
        return (1,)
    before, last = ((0,), (1,)) if n == 1 else (hermite(n - 2), hermite(n - 1))
    out = [0] * (n + 1)
    for i, a in enumerate(last):
        out[i + 1] += 2 * a
    for i, a in enumerate(before):
        out[i] -= 2 * (n - 1) * a
    return tuple(out)


def _hermite(n: int, t: Column) -> Column:
    """H_n(t) / n!, by Horner's rule in t²."""
    c = hermite(n)[n % 2:: 2]
    value = F.lit(float(c[-1]))
    for a in reversed(c[:-1]):
        value = value * t * t + float(a)
    return (value * t if n % 2 else value) / float(math.factorial(n))


def _power(x: Column, n: int) -> Column:
    return F.lit(1.0) if n == 0 else F.pow(x, F.lit(float(n)))


def kernel_density(long: DataFrame, keys: Sequence[str], points: int = 200, value: str = "r") -> DataFrame:
    """Gaussian kernel density on evenly spaced points with Scott's width, and the normal density beside it."""
    keys = list(keys)
    stats = long.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"),
        F.stddev_samp(value).alias("_sd"), F.avg(value).alias("_mu"))
    width = F.nullif(F.col("_sd"), F.lit(0.0)) * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    stats = stats.withColumn("_h", width).withColumn("_delta", F.col("_h") * math.sqrt(2))
    side = F.col("_delta") * (2 * HALF_SIDE)
    cell = F.floor((F.col(value) - F.col("_lo")) / side)
    centre = F.col("_lo") + (F.col("_cell") + 0.5) * side
    rows = long.filter(F.col(value).isNotNull()).join(stats, keys).withColumn("_cell", cell)
    moments = rows.select(*keys, "_cell", ((F.col(value) - centre) / F.col("_delta")).alias("_s")).groupBy(*keys, "_cell").agg(
        *[F.sum(_power(F.col("_s"), n)).alias(f"_m{n}") for n in range(TERMS)])
    x = F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / (points - 1)
    met = moments.join(stats, keys).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
    met = met.withColumn("_t", (F.col("x") - centre) / F.col("_delta"))
    terms = sum((F.col(f"_m{n}") * _hermite(n, F.col("_t")) for n in range(1, TERMS)), F.col("_m0") * _hermite(0, F.col("_t")))
    near = F.when(F.abs("_t") < REACH, F.exp(-F.col("_t") * F.col("_t")) * terms).otherwise(0.0)
    summed = met.groupBy(*keys, "point").agg(F.sum(near).alias("_k"), *[F.first(c).alias(c) for c in ("x", "_n", "_h", "_sd", "_mu")])
    normal = F.exp(-0.5 * F.pow((F.col("x") - F.col("_mu")) / F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(2.0))) / (F.nullif(F.col("_sd"), F.lit(0.0)) * _ROOT)
    return summed.select(*keys, "point", "x", (F.col("_k") / (F.col("_n") * F.col("_h") * _ROOT)).alias("density"), normal.alias("normal"))


def kernel_density_2d(df: DataFrame, x: str, y: str, mesh: int, low: float, high: float) -> DataFrame:
    """Gaussian kernel of two scores on a square mesh with the sample covariance scaled by n^(−1/3).

    Scores and points are turned and scaled so that the kernel is round; rows without either score do not count.
    """
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.count("*").cast("double")
    f = F.pow(n, F.lit(-1.0 / 3))
    a, b, c = F.var_samp(x) * f, F.var_samp(y) * f, F.covar_samp(x, y) * f
    shape = known.agg(F.struct(n.alias("n"), F.sqrt(a).alias("ra"), (c / a).alias("slope"), F.sqrt(b - c * c / a).alias("rb")))
    delta, side = math.sqrt(2), math.sqrt(2) * 2 * HALF_SIDE_2D

    def turned(px: Column, py: Column) -> tuple[Column, Column]:
        return px / F.col("_s.ra"), (py - F.col("_s.slope") * px) / F.col("_s.rb")

    u, v = turned(F.col(x).cast("double"), F.col(y).cast("double"))
    rows = known.withColumn("_s", shape.scalar()).select(u.alias("u"), v.alias("v")).select(
        "u", "v", F.floor(F.col("u") / side).alias("cu"), F.floor(F.col("v") / side).alias("cv"))
    su, sv = ((F.col(p) - (F.col(f"c{p}") + 0.5) * side) / delta for p in "uv")
    pairs = [(i, j) for i in range(TERMS_2D) for j in range(TERMS_2D - i)]
    moments = rows.select("cu", "cv", su.alias("su"), sv.alias("sv")).groupBy("cu", "cv").agg(
        *[F.sum(_power(F.col("su"), i) * _power(F.col("sv"), j)).alias(f"m{i}_{j}") for i, j in pairs])
    step = (high - low) / (mesh - 1)
    met = moments.withColumn("_s", shape.scalar()).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(mesh * mesh - 1))))
    met = met.withColumns({"i": F.floor(F.col("_p") / mesh), "j": F.col("_p") % mesh})
    pu, pv = turned(F.lit(low) + F.col("i") * step, F.lit(low) + F.col("j") * step)
    met = met.withColumns({"tu": (pu - (F.col("cu") + 0.5) * side) / delta, "tv": (pv - (F.col("cv") + 0.5) * side) / delta})
    polynomials = {f"h{p}": F.array(*[_hermite(k, F.col(f"t{p}")) for k in range(TERMS_2D)]) for p in "uv"}
    by_u = [
        F.get("hu", F.lit(i)) * sum((F.col(f"m{i}_{j}") * F.get("hv", F.lit(j)) for j in range(1, TERMS_2D - i)), F.col(f"m{i}_0") * F.get("hv", F.lit(0)))
        for i in range(TERMS_2D)]
    far = F.col("tu") * F.col("tu") + F.col("tv") * F.col("tv")
    near = F.when(far < REACH * REACH, F.exp(-far) * sum(by_u[1:], by_u[0])).otherwise(0.0)
    summed = met.withColumns(polynomials).groupBy("i", "j").agg(F.sum(near).alias("k"), F.first("_s").alias("_s"))
    root = F.col("_s.ra") * F.col("_s.rb")  # of the determinant
    return summed.select("i", "j", (F.col("k") / (F.col("_s.n") * 2 * math.pi * root)).alias("density"))
