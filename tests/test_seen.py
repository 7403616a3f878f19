"""The store of seen keys: what is read, repeated batches, merging, and keys that are not there."""

import random

import numpy as np
import pytest

from marketloom.streaming import intake, seen


def keys_of(df):
    return sorted((r.k for r in df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return seen.SeenKeys(spark, f"{tmp_path}/seen", "k", buckets=4, fan=3)


def frame(spark, keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, x int")


def test_unseen_over_many_batches(spark, store):
    rng = random.Random(2)
    pool = [f"key{i}" for i in range(60)]
    known: set = set()
    for number in range(11):
        batch = rng.sample(pool, 12) + [None]
        assert keys_of(store.unseen(frame(spark, batch), number)) == sorted((k for k in batch if k not in known), key=str)
        store.add(frame(spark, [k for k in batch if k is not None]), number)
        known |= {k for k in batch if k}
    # Ten earlier batches in tiers of three: one run of nine, one of one, and the last batch's own.
    assert store.runs() == [(0, 8), (9, 9), (10, 10)]
    assert keys_of(store.unseen(frame(spark, pool))) == sorted(set(pool) - known)


def test_repeated_batch_replaces_its_run(spark, store):
    store.add(frame(spark, ["a", "b"]), 0)
    store.add(frame(spark, ["c", "d"]), 1)
    assert keys_of(store.unseen(frame(spark, ["a", "c", "e"]), 1)) == ["c", "e"]  # its own run is not looked into
    store.add(frame(spark, ["c"]), 1)
    assert keys_of(store.unseen(frame(spark, ["a", "c", "d", "e"]), 2)) == ["d", "e"]


def test_run_without_index_does_not_count(spark, store, tmp_path):
    store.add(frame(spark, ["a"]), 0)
    store.add(frame(spark, ["b"]), 1)
    (tmp_path / "seen/index/run=1-1/_SUCCESS").unlink()
    assert store.runs() == [(0, 0)] and keys_of(store.unseen(frame(spark, ["a", "b"]), 2)) == ["b"]


def test_only_buckets_and_runs_that_may_hold_a_key_are_read(spark, tmp_path):
    store = seen.SeenKeys(spark, f"{tmp_path}/seen", "k", buckets=16)
    store.add(frame(spark, [f"a{i}" for i in range(400)]), 0)
    store.add(frame(spark, [f"b{i}" for i in range(400)]), 1)
    hit = store.candidates(frame(spark, ["a7"]), store.runs())
    assert len(hit) in (1, 2) and "0-0" in {run for _, run in hit} and len({bucket for bucket, _ in hit}) == 1
    read = [f for f in store.unseen(frame(spark, ["a7"]), 2).inputFiles() if "/keys/" in f]
    assert 1 <= len(read) <= 2 and any("keys/run=0-0/bucket=" in f for f in read)
    assert len(store.candidates(frame(spark, [f"z{i}" for i in range(16)]), store.runs())) < 8
    assert store.candidates(frame(spark, ["a1"]), []) == [] and store.candidates(frame(spark, []), store.runs()) == []


def test_filters_hold_what_they_were_built_from():
    rng = np.random.default_rng(1)
    for n in (1, 7, 5000):
        h = rng.integers(-(2**62), 2**62, n)
        raw = seen._filter(h)
        assert seen._may_hold(h, raw).all()
        assert seen._may_hold(rng.integers(-(2**62), 2**62, 20_000), raw).mean() < 0.05


def test_documents_of_many_batches_are_scored_once(spark, tmp_path):
    from pyspark.sql import functions as F

    schema = spark.createDataFrame([], "doc_id long, content string").schema
    seen_by: list = []

    def score(df):
        seen_by.append(sorted(r.doc_id for r in df.select("doc_id").collect()))
        return df.withColumns({c: F.lit(1.0) for c in intake.SCORES.names})

    for turn in range(3):
        spark.createDataFrame([(i, "x") for i in range(turn * 5, turn * 5 + 10)], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        intake.score_documents(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/log", score)
    assert seen_by == [list(range(10)), list(range(10, 15)), list(range(15, 20))]
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out/scored").collect()) == list(range(20))
