"""Windows of streamed events: the same rows whatever the number, order and batching of the files."""

import datetime as dt
import random

import pandas as pd
import pytest

from marketloom.streaming import intake, sessions, windows
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "user_id long, ts timestamp, value double"


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(8)
    # User 1 holds a third of the rows; some sessions cross midnight, some events lie exactly one gap apart.
    rows = [(1 if rng.random() < 0.33 else rng.randint(2, 9), T0 + dt.timedelta(minutes=rng.randint(0, 6000)), float(rng.randint(0, 9))) for _ in range(1500)]
    rows += [(50, T0 + dt.timedelta(minutes=m), 1.0) for m in (0, 30, 1430, 1445, 1475)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((r.user_id, r.start, r.end, r.n, round(r.total, 6)) for r in df.collect())


GAP = dt.timedelta(minutes=30)


def whole_sessions(events):
    """One after the other: an event a gap or more after the last one opens a session."""
    out = []
    for r in sorted(events.collect(), key=lambda r: (r.user_id, r.ts)):
        if out and out[-1][0] == r.user_id and r.ts < out[-1][2]:
            user, start, _, n, total = out[-1]
            out[-1] = (user, start, r.ts + GAP, n + 1, total + r.value)
        else:
            out.append((r.user_id, r.ts, r.ts + GAP, 1, r.value))
    return sorted(out)


@pytest.mark.parametrize("files, per_batch, folders", [(1, 100, 100), (4, 1, 2), (60, 9, 3)])
def test_no_event_is_late(spark, events, tmp_path, files, per_batch, folders):
    source = f"{tmp_path}/in"
    events.repartition(files, F.rand(3)).write.parquet(source)
    whole = lambda window: rows_of(events.groupBy(window.alias("w"), "user_id").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", "w.start", "w.end", "n", "total"))
    for name, build, merge, want in (
            ("day", windows.tumbling, windows.summed_windows, whole(F.window("ts", "1 day"))),
            ("week", windows.sliding, windows.summed_windows, whole(F.window("ts", "7 days", "1 day"))),
            ("session", windows.sessions, windows.merged_sessions, whole_sessions(events))):
        for _ in range(2):  # the second time there is nothing new
            got = windows.run_available(spark, source, events.schema, build, f"{tmp_path}/{name}", f"{tmp_path}/{name}-log", ["user_id"], merge, per_batch, folders)
            assert rows_of(got) == want
        left = list((tmp_path / name).glob("batch=*"))
        assert len(left) <= folders and (len(list((tmp_path / name).glob("merged=*"))) == 1 or files <= folders)


@pytest.mark.parametrize("files, per_batch", [(1, 100), (4, 1), (200, 40)])
def test_sessions_in_state(spark, events, tmp_path, files, per_batch):
    source, out, log = (f"{tmp_path}/{x}" for x in ("in", "out", "log"))
    events.repartition(files, F.rand(5)).write.parquet(source)
    run = lambda: sessions.run_available(spark, source, events.schema, out, log, ["user_id"], delay="10 minutes", files_per_batch=per_batch)
    assert rows_of(run()) == whole_sessions(events)
    kinds = {r.kind: r["count"] for r in spark.read.parquet(out).groupBy("kind").count().collect()}
    assert files == 1 or kinds["late"] > 0
    # What is over has left the state; the rest is within the delay of the newest event, by day.
    newest = max(r.ts for r in events.collect())
    assert all(r.end > newest - dt.timedelta(minutes=10) for r in sessions.open_sessions(spark, log, ["user_id"]).collect())
    # More files, among them some long past, are added to what is there.
    more = spark.createDataFrame([(50, T0 + dt.timedelta(minutes=m), 1.0) for m in (15, 1440, 9000, 9030)] + [(None, T0, 2.0)], SCHEMA)
    more.write.mode("append").parquet(source)
    got = run()
    known = got.filter("user_id IS NOT NULL")
    assert rows_of(known) == whole_sessions(events.union(more.filter("user_id IS NOT NULL")))
    assert [(r.n, r.total) for r in got.filter("user_id IS NULL").collect()] == [(1, 2.0)]


def test_state_by_slot(spark, tmp_path):
    """State, timers and calls are per slot, however many keys and days there are; large keys, null keys and null values stay apart."""
    source, out, log = (f"{tmp_path}/{x}" for x in ("in", "out", "log"))
    big = 2**60
    rows = [(big + u, T0 + dt.timedelta(minutes=m), v) for u in range(3000) for m, v in ((0, None), (20, 1.5), (60, None))] + [(None, T0, 2.0)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(source)
    got = sessions.run_available(spark, source, spark.read.parquet(source).schema, out, log, ["user_id"], delay="2 hours")
    at = lambda m: T0 + dt.timedelta(minutes=m)
    want = [(None, at(0), at(30), 1, 2.0)] + [x for u in range(3000) for x in ((big + u, at(0), at(50), 2, 1.5), (big + u, at(60), at(90), 1, None))]
    assert sorted(map(tuple, got.select("user_id", "start", "end", "n", "total").collect()), key=repr) == sorted(want, key=repr)
    assert spark.read.format("statestore").option("stateVarName", "open").load(log).count() <= 1024
    left = sessions.open_sessions(spark, log, ["user_id"], {"user_id": "bigint"})
    assert left.count() == 6001 and dict(left.dtypes)["user_id"] == "bigint"


def test_scorer_gets_a_few_megabytes_at_a_time(spark):
    """Long documents come in small pieces, a row larger than a piece alone; order, null texts and other columns stay."""
    size = lambda i: 9_000_000 if i == 700 else 20_000
    long = F.when(F.col("id") % 10 == 3, None).otherwise(F.repeat(F.lit("é"), F.when(F.col("id") == 700, 4_500_000).otherwise(10_000).cast("int")))
    docs = spark.range(1000).coalesce(1).select("id", F.timestamp_seconds("id").alias("at"), long.alias("content"))

    def score(batch):
        assert batch["at"].dt.tz is None
        total = batch["content"].str.len().fillna(0).sum() * 2.0
        return pd.DataFrame({"supply": batch["id"].astype("float64"), "demand": total, "strength": float(len(batch))})

    got = intake.scored_by(score)(docs).select("id", "at", F.octet_length("content").alias("size"), "supply", "demand", "strength").collect()
    assert [(r.id, r.supply, r.size) for r in got] == [(i, i, None if i % 10 == 3 else size(i)) for i in range(1000)]
    assert all(r.at == dt.datetime.fromtimestamp(r.id, dt.timezone.utc).replace(tzinfo=None) for r in got)
    assert max(r.demand for r in got if r.id != 700) <= intake.PIECE and [r.strength for r in got if r.id == 700] == [1.0]


def test_broken_lines_are_rejected_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"doc_id": "1", "content": "x"}\nno json\n{"doc_id": "1", "content": "x"}\n')
    schema = spark.createDataFrame([], "doc_id string, content string").schema
    score = lambda df: df.withColumns({c: F.lit(1.0) for c in intake.SCORES.names})
    intake.score_documents(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/log", score)
    read = lambda part: [r.doc_id for r in spark.read.parquet(f"{tmp_path}/out/{part}").collect()]
    assert (read("scored"), read("rejected")) == (["1"], [None])
