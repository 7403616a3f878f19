"""Sources, sinks, intake and hooks: bad lines, missing paths, restarts, missing keys."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators import documents as ops
from marketloom.operators.alignment import lookup
from marketloom.operators.strategies import Strategies
from marketloom.session import fresh_path, settle
from marketloom.sources import documents, sinks
from marketloom.streaming import intake, seen


def write_lines(path, name, lines):
    folder = path / name
    folder.mkdir(parents=True)
    (folder / "part.jsonl").write_text("\n".join(lines), encoding="utf-8")
    return str(folder)


def test_bad_lines_and_missing_paths(spark, tmp_path):
    good = '{"doc_id": "1", "content": "碳", "source": "X"}'
    folder = write_lines(tmp_path, "agency/notices", [good, "not json", "", '{"doc_id": "2"}'])
    df = documents.scan_jsonl(spark, [folder, str(tmp_path / "absent")]).cache()
    assert df.filter("_bad_line IS NOT NULL").count() == 1
    got = {r.doc_id: (r.source, r.section) for r in df.filter("doc_id IS NOT NULL").collect()}
    assert got == {"1": ("X", "notices"), "2": ("agency", "notices")}
    assert documents.scan_jsonl(spark, [str(tmp_path / "absent")]).count() == 0


def test_missing_key_stops_a_lookup(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    prices = spark.createDataFrame([("a", 9.0)], "k string, p double")
    with pytest.raises(Exception, match="no value for b"):
        lookup(rows, prices, ["k"]).collect()


def test_intake_survives_a_repeat(spark, tmp_path):
    source, out = fresh_path(spark, "in"), fresh_path(spark, "out")
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("content", T.StringType())])

    def score(batch):
        return pd.DataFrame({"supply": batch["content"].str.len().astype(float), "demand": 0.0, "strength": 1.0})

    def run(ids):
        spark.createDataFrame([(str(i), "x" * i) for i in ids], schema).write.mode("append").json(source)
        intake.score_documents(spark, source, schema, out, f"{out}-log", intake.scored_by(score), files_per_batch=2)
        return spark.read.parquet(f"{out}/scored")

    assert sorted(r.doc_id for r in run([1, 2, 200]).collect()) == ["1", "2"]
    again = run([2, 3, 1])
    assert sorted(r.doc_id for r in again.collect()) == ["1", "2", "3"]
    assert {r.doc_id for r in spark.read.parquet(f"{out}/rejected").collect()} == {"200"}


def test_files_grow_with_bytes_not_with_tasks(spark, tmp_path):
    """Small rows of 40 tasks and 5 folders are few files; a second arrival of all is taken in without a run of the store."""
    out, source = f"{tmp_path}/out", f"{tmp_path}/in"
    docs = spark.range(400).repartition(40).select(F.col("id").cast("string").alias("doc_id"), F.lit("x").alias("content"), (F.col("id") % 5).alias("source"))
    schema = docs.select("doc_id", "content").schema
    score = lambda df: df.withColumns({c: F.lit(1.0) for c in intake.SCORES.names})
    for turn in (1, 2):
        documents.write_jsonl(docs, source, ["source"], mode="append")
        files = list((tmp_path / "in").glob("source=*/*.json"))
        assert {f.parent.name for f in files} == {f"source={i}" for i in range(5)} and len(files) <= 10 * turn
        intake.score_documents(spark, source, schema, out, f"{out}-log", score)
        assert spark.read.parquet(f"{out}/scored").count() == 400
        assert seen.SeenKeys(spark, f"{out}/seen", "doc_id").runs() == [(0, 0)]


def test_cleaning_records_what_fired(spark):
    rules = (ops.Pattern("tail", r"END.*", flags=("DOTALL",)), ops.Pattern("mine", r"^A", source="a"))
    rows = spark.createDataFrame([("a", "Abc END\nmore"), ("b", "Abc"), ("b", None)], "source string, content string")
    got = [(r.content, None if r.cleaning is None else (r.cleaning.chars_removed, r.cleaning.patterns_applied)) for r in ops.clean(rows, rules).orderBy("source", F.col("content").desc()).collect()]
    assert got == [("bc", (10, ["mine", "tail"])), ("Abc", None), ("", None)]


def test_registry_keeps_the_latest(spark):
    rows = spark.createDataFrame([("d", "x", 1, 0.1, None), ("d", "x", 2, 0.2, 0.9)], "model string, market string, ts int, accuracy double, test_accuracy double")
    latest = sinks.latest_results(rows, ["model", "market"])
    assert latest.select(sinks.metric("accuracy", latest.columns).alias("a"), sinks.metric("recall", latest.columns).alias("r")).first() == (0.9, 0.0)


def test_strategies_are_valued_together(spark, tables):
    s = Strategies()
    s.add("hold", lambda px: px.select("market", "date", F.lit(1).alias("signal")))
    s.add("cash", lambda px: px.select("market", "date", F.lit(0).alias("signal")))
    with pytest.raises(ValueError):
        s.add("hold", lambda px: px)
    px = settle(tables.px)
    nav = s.values(px, whole_units=True, capital=1000.0)
    assert nav.count() == 2 * px.count()
    assert nav.filter("strategy = 'cash' AND nav <> 1000").count() == 0
