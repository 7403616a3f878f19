"""Block scans against sequential restatements, and the spread of one long series over tasks."""

import random
import re

import numpy as np
import plans
import pytest
from pyspark.sql import functions as F

from marketloom.operators import scan


def series_rows(n=1500, seed=2):
    rng = random.Random(seed)
    rows = []
    for key in ("a", None, "b"):
        at = -700
        for _ in range(n if key == "a" else 60):
            at += rng.choice((1, 1, 2, 9, 40))
            rows.append((key, at, None if rng.random() < 0.6 else rng.uniform(-5, 5)))
    return rows


def sequential(rows, decay):
    want, last = {}, {}
    for key, at, x in rows:
        before, y = last.get(key, (at, 0.0))
        y = y * decay ** (at - before) + (x or 0.0)
        last[key] = (at, y)
        want[key, at] = y
    return want


@pytest.mark.parametrize("longest", [4, 512])
@pytest.mark.parametrize("decay", [1.0, 0.99999, 0.98, 0.5, 1e-30, 0.0])
def test_decayed_sum(spark, monkeypatch, longest, decay):
    monkeypatch.setattr(scan, "LONGEST", longest)
    rows = series_rows(400 if longest == 4 else 1500)
    df = spark.createDataFrame(rows, "k string, d long, x double").repartition(5)
    got = {(r.k, r.d): r.y for r in scan.decayed_sum(df, ["k"], F.col("d"), {"y": F.col("x")}, decay).collect()}
    want = sequential(rows, decay)
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], [want[k] for k in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("longest", [4, 512])
def test_filled_forward(spark, monkeypatch, longest):
    monkeypatch.setattr(scan, "LONGEST", longest)
    rows = series_rows(400)
    df = spark.createDataFrame(rows, "k string, d long, x double").repartition(5)
    held, want = {}, {}
    for key, at, x in rows:
        held[key] = x if x is not None else held.get(key)
        want[key, at] = held[key]
    assert {(r.k, r.d): r.x for r in scan.filled_forward(df, ["k"], F.col("d"), ["x"]).collect()} == want
    assert scan.filled_forward(df.limit(0), ["k"], F.col("d"), ["x"]).count() == 0


def test_one_series_spreads_over_tasks(spark):
    df = spark.range(60_000).select(F.lit("a").alias("k"), "id", F.lit(1.0).alias("x"))
    for out in (scan.decayed_sum(df, ["k"], F.col("id"), {"y": F.col("x")}, 0.98), scan.running_sum(df, ["k"], F.col("id"), {"y": F.col("x")})):
        windows = [x for x in plans.plan_of(out).splitlines() if re.search(r"[ -]Window \[", x)]
        assert windows and all("_b#" in x for x in windows)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be joined in one task
        try:
            in_tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(in_tasks) >= 4 and max(in_tasks) < 30_000


def test_times_that_are_no_dates_are_numbered(spark):
    df = spark.createDataFrame([("a", f"2020-01-01 0{i}:00:00", float(i)) for i in range(9)], "k string, t string, x double").withColumn("t", F.to_timestamp("t"))
    placed, position = scan.whole_position(df, ["k"], "t")
    out = scan.running_sum(placed, ["k"], position, {"y": F.col("x")}).orderBy("t").collect()
    assert [r.y for r in out] == list(np.cumsum(range(9)))
