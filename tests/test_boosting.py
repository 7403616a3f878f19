"""Keyed boosted trees against a direct fit per key."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import boosting


def brute_fit(x, y, bounds, s):
    """Greedy trees over the same bin ends; returns the value of each row."""
    bins = np.array([[sum(v > b for b in bounds[j]) for j, v in enumerate(row)] for row in x])
    f = np.zeros(len(y))
    w = np.where(y == 1, s.positive_weight, 1.0)
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = w * (p - y), w * p * (1 - p)

        def grow(rows, depth):
            G, H = g[rows].sum(), h[rows].sum()
            best = None
            if depth < s.depth:
                for j in range(x.shape[1]):
                    for cut in sorted(set(bins[rows, j])):
                        left = rows[bins[rows, j] <= cut]
                        gl, hl = g[left].sum(), h[left].sum()
                        if hl >= s.least_curvature and H - hl >= s.least_curvature:
                            gain = gl**2 / (hl + s.ridge) + (G - gl) ** 2 / (H - hl + s.ridge) - G**2 / (H + s.ridge)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                                best = (gain, j, cut)
            if best is None:
                f[rows] += -s.rate * G / (H + s.ridge)
                return
            _, j, cut = best
            grow(rows[bins[rows, j] <= cut], depth + 1)
            grow(rows[bins[rows, j] > cut], depth + 1)

        grow(np.arange(len(y)), 0)
    return 1 / (1 + np.exp(-f))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for key in ("a", "b", None):
        for i in range(220):
            x = rng.normal(size=3)
            hot = x[0] > 0.3 if key == "a" else x[1] * x[2] > 0
            out.append((key, i, float(x[0]), float(x[1]), float(np.round(x[2])), int(rng.random() < (0.85 if hot else 0.15))))
    return out


FEATURES = ["u", "v", "w"]
KIND = "k string, i int, u double, v double, w double, y int"


@pytest.mark.parametrize("rows_per_task", [50_000, 0])
def test_equal_to_a_direct_fit_per_key(spark, rows, rows_per_task):
    s = boosting.Settings(rounds=5, depth=2, rate=0.3, row_share=1.0, feature_share=1.0, bins=8, kept_rounds=2, rows_per_task=rows_per_task, keys_at_once=2)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    model = boosting.fit(df, ["k"], ["i"], FEATURES, "y", s)
    got = {(r.k, r.i): r.p_err for r in boosting.probabilities(df, ["k"], FEATURES, model, s).collect()}
    bounds = {r.k: r.bounds for r in model[0].collect()}
    for key in ("a", "b", None):
        own = [r for r in rows if r[0] == key]
        want = brute_fit(np.array([r[2:5] for r in own]), np.array([r[5] for r in own]), bounds[key], s)
        assert np.allclose([got[key, r[1]] for r in own], want, atol=1e-9)


def test_keys_do_not_meet_and_samples_repeat(spark, rows):
    s = boosting.Settings(rounds=4, depth=2, rate=0.3, bins=8)
    df = spark.createDataFrame(rows, KIND)
    whole = boosting.fit(df, ["k"], ["i"], FEATURES, "y", s)
    alone = boosting.fit(df.filter("k = 'a'").repartition(7), ["k"], ["i"], FEATURES, "y", s)
    spread = boosting.fit(df.repartition(6), ["k"], ["i"], FEATURES, "y", replace(s, rows_per_task=0, kept_rounds=3))
    each = [{r.i: round(r.p_err, 9) for r in boosting.probabilities(df.filter("k = 'a'"), ["k"], FEATURES, m, s).collect()} for m in (whole, alone, spread)]
    assert each[0] == each[1] == each[2] and len(set(each[0].values())) > 2
    top = boosting.importances(whole, ["k"], FEATURES).collect()
    assert all(abs(sum(r.importance for r in top if r.k == k) - 1) < 1e-9 for k in ("a", "b", None))
    assert max((r for r in top if r.k == "a"), key=lambda r: r.importance).feature == "u"


def test_unseen_keys_nulls_and_no_rows(spark, rows):
    s = boosting.Settings(rounds=2, depth=2, bins=4)
    df = spark.createDataFrame(rows + [("a", 900, None, None, None, 1), ("a", 901, 1.0, 1.0, 1.0, None)], KIND)
    model = boosting.fit(df, ["k"], ["i"], FEATURES, "y", s)
    other = spark.createDataFrame([("zzz", 1, 0.0, 0.0, 0.0, 1), ("a", 2, None, None, None, 1)], KIND)
    got = {r.k: r.p_err for r in boosting.probabilities(other, ["k"], FEATURES, model, s).collect()}
    assert got["zzz"] == 0.5 and 0 < got["a"] < 1
    empty = boosting.fit(df.limit(0), ["k"], ["i"], FEATURES, "y", s)
    assert {r.p_err for r in boosting.probabilities(other, ["k"], FEATURES, empty, s).collect()} == {0.5}
    assert boosting.importances(empty, ["k"], FEATURES).count() == 0


def test_single_class_has_leaves_only(spark):
    df = spark.createDataFrame([("a", i, float(i), 0.0, 0.0, 1) for i in range(50)], KIND)
    s = boosting.Settings(rounds=2, depth=2, row_share=1.0, bins=4)
    model = boosting.fit(df, ["k"], ["i"], FEATURES, "y", s)
    assert min(r.p_err for r in boosting.probabilities(df, ["k"], FEATURES, model, s).collect()) > 0.5
    assert df.select(F.lit(1)).count() == 50
