"""Quantile sketches: error against exact ranks, and batches against one run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import sketches

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def values():
    r = np.random.default_rng(1)
    return {
        "wide": np.concatenate([r.lognormal(0, 4, 4000), -r.lognormal(0, 4, 3000), np.zeros(50)]), "hot": np.concatenate([np.full(9000, 7.25), r.normal(0, 1, 500)]),
        "one": np.array([-3.5]), "tiny": np.array([1e-12, -1e-11, 2e-10])}


def frame(spark, values):
    rows = [(k, float(x)) for k, xs in values.items() for x in xs] + [("hot", None), ("hot", float("nan"))]
    return spark.createDataFrame(rows, "k string, value double").repartition(6)


@pytest.mark.parametrize("accuracy", [0.05, 0.005])
def test_error_against_exact_ranks(spark, values, accuracy):
    got = {r.k: r for r in sketches.quantiles(sketches.sketch(frame(spark, values), ["k"], accuracy=accuracy), ["k"], PROBS, accuracy).collect()}
    for k, xs in values.items():
        want = np.quantile(xs, PROBS, method="lower")
        assert got[k].n == len(xs)
        assert all(abs(a - b) <= accuracy * abs(b) * (1 + 1e-9) + 1e-9 for a, b in zip(got[k].q, want))
        assert got[k].q[0] == xs.min() and got[k].q[-1] == xs.max()


def test_batches_equal_one_run(spark, values, tmp_path):
    whole = frame(spark, values)
    once = sorted(map(tuple, sketches.sketch(whole, ["k"]).collect()))
    for turn in range(2):  # a repeated batch replaces its own
        for batch in range(4):
            sketches.store(sketches.sketch(whole.filter(F.pmod(F.xxhash64("k", "value"), F.lit(4)) == batch), ["k"]), f"{tmp_path}/s", batch)
    assert sorted(map(tuple, sketches.stored(spark, f"{tmp_path}/s", ["k"]).collect())) == once
    assert sketches.sketch(whole, ["k"]).filter("k = 'hot' AND n >= 9000").count() == 1
    assert sketches.quantiles(sketches.sketch(whole.limit(0), ["k"]), ["k"], PROBS).count() == 0
