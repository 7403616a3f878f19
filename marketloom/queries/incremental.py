"""Incremental, streaming and hook queries."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.queries.registry import query
from marketloom.session import fresh_path
from marketloom.sources import documents
from marketloom.streaming import intake, seen, sessions, windows


@query("I01_resume_by_log", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE url LIKE 'https:%')")
def _(t):
    log = intake.progress(t.pages.filter(F.col("url").startswith("https:")), "news")
    done = seen.SeenKeys(t.spark, fresh_path(t.spark, "progress"), "url")
    done.add(log, 0)
    return done.unseen(t.pages.select("page_id", "url"))


def local_scores(batch: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in for a document scorer: letter balance and length decide."""
    text = batch["content"].fillna("")
    size = text.str.len()
    return pd.DataFrame({
        "supply": ((size % 301) - 150).astype("float64"), "demand": ((text.str.count("e") % 331) - 150).astype("float64"),
        "strength": (text.str.count(" ") % 151).astype("float64")})


def letters(x):
    return f"length({x}) - length(replace({x}, 'e', ''))"


SCORED = f"""
s AS (SELECT doc_id, CAST(length(text) % 301 - 150 AS DOUBLE) AS supply, CAST(({letters('text')}) % 331 - 150 AS DOUBLE) AS demand, CAST((length(text) - length(replace(text, ' ', ''))) % 151 AS DOUBLE) AS strength FROM documents)
"""


@query("X06_document_scorer", "WITH " + SCORED + "SELECT doc_id, supply, demand, strength FROM s")
def _(t):
    docs = t.documents.select("doc_id", F.col("text").alias("content"))
    return intake.scored_by(local_scores)(docs).drop("content")


@query("I02_checkpointed_scoring", "WITH " + SCORED + "SELECT CAST(doc_id AS VARCHAR) AS doc_id, supply, demand, strength FROM s WHERE demand <= 150")
def _(t):
    source, output = fresh_path(t.spark, "intake"), fresh_path(t.spark, "scores")
    docs = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), "source")
    documents.write_jsonl(docs, source, ["source"])
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("content", T.StringType())])

    def run():
        intake.score_documents(t.spark, source, schema, output, f"{output}-log", intake.scored_by(local_scores))

    run()
    # The same documents arrive again; the second run must leave no second copy.
    documents.write_jsonl(docs, source, ["source"], mode="append")
    run()
    return t.spark.read.parquet(f"{output}/scored").select("doc_id", "supply", "demand", "strength")


@query("I04_run_summary", """
SELECT source, count(*) AS total_documents, CAST(count_if(n_chars >= 200) AS BIGINT) AS processed, CAST(count_if(n_chars < 200) AS BIGINT) AS failed,
  R6(count_if(n_chars >= 200) / greatest(count(*), 1)) AS success_rate, R8(sum(n_chars) / 1000 / greatest(count_if(n_chars >= 200), 1)) AS avg_seconds FROM documents GROUP BY source
""")
def _(t):
    log = t.documents.select("source", F.when(F.col("n_chars") >= 200, "ok").otherwise("failed").alias("status"), (F.col("n_chars") / 1000).alias("seconds"))
    return intake.run_summary(log, ["source"]).withColumns({"success_rate": F.round("success_rate", 6), "avg_seconds": F.round("avg_seconds", 8)})


def streamed(t, build, keys, merge=windows.summed_windows):
    output = fresh_path(t.spark, "windows")
    return windows.run_available(
        t.spark, f"{t.folder}/events*.parquet", t.events.schema, build, output, f"{output}-log", keys, merge)


@query("I05_tumbling_windows", """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, R4(sum(value)) AS total FROM events GROUP BY 1, 2
""")
def _(t):
    rows = streamed(t, windows.tumbling, ["event_type"])
    return rows.select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("I05_sliding_windows", """
SELECT CAST(ts AS DATE) - CAST(k.range AS INTEGER) AS first_day, event_type, count(*) AS n, R4(sum(value)) AS total FROM events, range(7) k GROUP BY 1, 2
""")
def _(t):
    rows = streamed(t, windows.sliding, ["event_type"])
    return rows.select(F.to_date("start").alias("first_day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("I05_session_windows", """
WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS ended, count(*) AS n, R4(sum(value)) AS total FROM s GROUP BY user_id, k
""")
def _(t):
    output = fresh_path(t.spark, "sessions")
    rows = sessions.run_available(t.spark, f"{t.folder}/events*.parquet", t.events.schema, output, f"{output}-log", ["user_id"])
    return rows.select(
        "user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("started"), F.unix_micros(F.col("end").cast("timestamp")).alias("ended"),
        "n", F.round("total", 4).alias("total"))


@query("I05_news_shock_stream", """
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, day, R6(n / (avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS 6 PRECEDING) + 0.1)) AS news_shock FROM d
""")
def _(t):
    from marketloom.operators.series import ordered, trailing

    rows = streamed(t, windows.tumbling, ["event_type"]).withColumn("day", F.to_date("start"))
    w = trailing(ordered(["event_type"], "day"), 7)
    return rows.select("event_type", "day", F.round(F.col("n") / (F.avg("n").over(w) + 0.1), 6).alias("news_shock"))
