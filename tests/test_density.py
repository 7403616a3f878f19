"""Fast Gauss transform against the direct sum."""

import math

import numpy as np
import plans
import pytest

from marketloom.operators import density


@pytest.mark.parametrize("n", [2, 40, 3000])
def test_density_equals_the_direct_sum(spark, n):
    rng = np.random.default_rng(n)
    values = {"a": rng.normal(3, 2, n), "b": np.concatenate([rng.standard_t(2, n - 1), [60.0]])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in values.items() for x in xs] + [("a", None), ("c", 1.0), ("c", 1.0)], "k string, r double").repartition(5)
    got = density.kernel_density(df, ["k"], 50).toPandas()
    for k, r in values.items():
        part = got[got["k"] == k].sort_values("point")
        h = r.std(ddof=1) * n**-0.2
        want = np.exp(-0.5 * ((part["x"].to_numpy()[:, None] - r) / h) ** 2).sum(1) / (n * h * math.sqrt(2 * math.pi))
        assert len(part) == 50 and np.abs(part["density"] - want).max() * h < 1e-11
    assert got[got["k"] == "c"]["density"].isna().all()


@pytest.mark.parametrize("n", [30, 2000])
def test_density_in_two_dimensions(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(10, 60, n)
    y = 0.7 * x + rng.uniform(-50, 50, n)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x double, y double").repartition(4)
    got = {(r.i, r.j): r.density for r in density.kernel_density_2d(df, "x", "y", 13, -150.0, 150.0).collect()}
    cov = np.cov(x, y) * n ** (-1 / 3)
    inverse, det = np.linalg.inv(cov), np.linalg.det(cov)
    for (i, j), value in got.items():
        d = np.stack([-150 + 25.0 * i - x, -150 + 25.0 * j - y])
        want = np.exp(-0.5 * np.einsum("an,ab,bn->n", d, inverse, d)).sum() / (n * 2 * math.pi * math.sqrt(det))
        assert abs(value - want) * math.sqrt(det) < 1e-9
    assert len(got) == 169


def test_rows_never_meet_grid_points(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(50)], "k string, r double")
    plan = plans.plan_of(density.kernel_density(df, ["k"], 30))
    assert plan.index("Generate explode") < plan.rindex("partial_sum(")  # the moments are added up below
