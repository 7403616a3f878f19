"""Logistic fits of many keys against a direct Newton solve per key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import learning, logistic


def direct_fit(x, y, weight, ridge=1.0):
    a = np.hstack([x, np.ones((len(x), 1))])
    beta, penalty = np.zeros(a.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        move = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (weight * (y - p)) - penalty @ beta)
        beta += move
        if np.abs(move).max() < 1e-8:
            break
    return beta


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    out = []
    for market in ("a", "b"):
        for walk in range(3):
            level = 0.0
            for i in range(140):
                u, v = rng.normal(size=2)
                level = 0.9 * level + u
                out.append((market, walk, i, "train" if i < 100 else "test", float(u), float(level), 2.0, int(level + v + rng.normal() > 0)))
    # A walk of one class has no model; one without test rows gives none.
    out += [("c", 0, i, "train" if i < 20 else "test", float(i % 7), 1.0, 2.0, 1) for i in range(40)]
    out += [("d", 0, i, "train", float(i % 7), float(i % 3), 2.0, i % 2) for i in range(40)]
    return out


KIND = "market string, walk int, date int, role string, u double, v double, constant double, y int"
KEYS = ["market", "walk"]


def test_probabilities_equal_a_direct_fit(spark, rows):
    df = spark.createDataFrame(rows, KIND).repartition(7)
    steps = 6
    seq, columns = logistic.sequence_summaries(df, [*KEYS, "role"], ["u", "v", "constant"], steps)
    got = {(r.market, r.walk, r.date): (r.prob, r.actual) for r in logistic.walk_probabilities(seq, KEYS, columns).collect()}
    want = {}
    for market, walk in {(r[0], r[1]) for r in rows}:
        x, y, role, date = [], [], [], []
        for part in ("train", "test"):
            own = [r for r in rows if r[:2] == (market, walk) and r[3] == part]
            values = np.array([r[4:7] for r in own])
            for i in range(steps, len(own)):
                part_rows = values[i - steps:i]
                x.append(np.concatenate([part_rows[-1], part_rows.mean(0), part_rows[-1] - part_rows[0]]))
                y.append(own[i][7])
                role.append(part)
                date.append(own[i][2])
        x, y, train = np.array(x), np.array(y), np.array(role) == "train"
        if len(set(y[train])) < 2:
            continue
        mu, sd = x[train].mean(0), x[train].std(0)
        sd[sd == 0] = 1
        z = (x - mu) / sd
        beta = direct_fit(z[train], y[train], np.where(y[train] == 1, (y[train] == 0).sum() / (y[train] == 1).sum(), 1.0))
        p = 1 / (1 + np.exp(-np.clip(np.hstack([z, np.ones((len(z), 1))]) @ beta, -30, 30)))
        want |= {(market, walk, d): (q, a) for d, q, a, t in zip(date, p, y, train) if not t}
    assert got.keys() == want.keys() and {k[0] for k in got} == {"a", "b"}
    assert all(abs(got[k][0] - want[k][0]) < 1e-7 and got[k][1] == want[k][1] for k in want)


def test_gradient_is_zero_at_the_fit(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[0] in "ab"], KIND).filter("role = 'train'").repartition(5).withColumn("weight", F.lit(1.0) + F.col("y"))
    z = logistic.standardised(df, KEYS, ["u", "v"], F.lit(True))
    beta = logistic.fit(z, KEYS)
    held = z.join(beta, KEYS).withColumn("r", F.col("weight") * (F.col("y") - logistic.probability()))
    slopes = held.groupBy(*KEYS).agg(*[
        (F.sum(F.col("r") * F.get("z", F.lit(i))) - F.first(F.get("beta", F.lit(i)))).alias(f"g{i}") for i in range(2)], F.sum("r").alias("g2")).collect()
    assert len(slopes) == 6 and all(abs(r[f"g{i}"]) < 1e-4 for r in slopes for i in range(3))
    assert logistic.fit(z.limit(0), KEYS).count() == 0


@pytest.mark.parametrize("include", [False, True])
def test_summaries_are_those_of_the_sequences(spark, rows, include):
    df = spark.createDataFrame(rows, KIND)
    keys = [*KEYS, "role"]
    seq = {(r.market, r.walk, r.role, r.date): np.array(r.x) for r in learning.sequences(df, keys, ["u", "v"], 5, include, "date").collect()}
    out, columns = logistic.sequence_summaries(df, keys, ["u", "v"], 5, include)
    got = {(r.market, r.walk, r.role, r.date): [r[c] for c in columns] for r in out.collect()}
    assert got.keys() == seq.keys()
    assert all(np.allclose(got[k], np.concatenate([x[-1], x.mean(0), x[-1] - x[0]])) for k, x in seq.items())
