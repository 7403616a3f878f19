"""Source and sink queries: each writes rows derived from the tables to the shared folder and reads them back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.cleaning import union_all
from marketloom.queries.registry import query
from marketloom.session import allow_charsets, fresh_path
from marketloom.sources import documents, indicators, prices, sinks


@query("S01_price_scan", """
SELECT market, date, close, vwap, volume AS volume_tons, turnover AS turnover_cny, turnover AS cum_turnover_cny FROM px
""", ("px",))
def _(t):
    t.share_px()
    allow_charsets(t.spark)
    path = fresh_path(t.spark, "prices")
    number = lambda c: F.col(c).cast("string")
    rows = t.px.select(
        "market", F.date_format("date", "yyyy/MM/dd").alias("date"), number("close").alias("close"), number("vwap").alias("vwap"),
        number("volume").alias("volume_tons"), number("turnover").alias("turnover_cny"), number("turnover").alias("turnover_again"),
        number("turnover").alias("cum_turnover_cny"))
    notes = t.px.select("market").distinct().select(
        "market", F.explode(F.array(*[F.lit(x) for x in ("频率", "单位", "来源", "更新时间", "数据来源：交易所", "")])).alias("date"))
    union_all([rows, notes]).write.partitionBy("market").option("encoding", "GB18030").option("header", "true").csv(path)
    return prices.scan_prices(t.spark, path)


@query("S02_indicator_scan", "SELECT indicator, date, value FROM ind", ("ind",))
def _(t):
    allow_charsets(t.spark)
    path = fresh_path(t.spark, "indicators")
    rows = t.ind.select("indicator", F.col("date").cast("string").alias("date"), F.col("value").cast("string").alias("value"))
    notes = t.ind.select("indicator").distinct().select(
        "indicator", F.explode(F.array(*[F.lit(x) for x in ("指标名称", "频率", "单位", "来源", "数据来源")])).alias("date"))
    union_all([rows, notes]).write.partitionBy("indicator").option("encoding", "GBK").csv(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), "indicator=([^/]+)/", 1)
    return indicators.scan_indicators(t.spark, f"{path}/*", name=name)


def indicator_folder(t):
    path = fresh_path(t.spark, "series")
    df = t.ind.select("date", "value", F.col("indicator").alias("g"))
    df.write.partitionBy("g").parquet(path)
    return path


@query("S03_manifest_scan", "SELECT indicator, date, value FROM ind WHERE indicator LIKE 'M%'", ("ind",))
def _(t):
    path = indicator_folder(t)
    listed = fresh_path(t.spark, "manifest")
    t.ind.filter("indicator LIKE 'M%'").select(F.concat(F.lit("g="), "indicator").alias("value")).distinct().write.text(listed)
    df = indicators.scan_listed(t.spark, path, indicators.manifest(t.spark, listed))
    return df.select(F.regexp_replace("stem", "^g=", "").alias("indicator"), "date", "value")


@query("S04_folder_scan", "SELECT indicator, substr(indicator, 1, 1) AS grouped, date, value FROM ind", ("ind",))
def _(t):
    df = indicators.scan_folder(t.spark, indicator_folder(t))
    name = F.regexp_replace("stem", "^g=", "")
    return df.select(name.alias("indicator"), F.substring(name, 1, 1).alias("grouped"), "date", "value")


@query("S05_panel_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def _(t):
    return t.orders.filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")).select("o_orderkey", "o_totalprice")


def raw_documents(t):
    return t.scored.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), F.length("text").cast("long").alias("content_length"),
        "source", F.col("lang").alias("section"), F.col("publish_date").cast("string").alias("publish_date"))


def jsonl_folder(t):
    path = fresh_path(t.spark, "documents")
    documents.write_jsonl(raw_documents(t), path, ["source", "section"])
    return path


DOCS = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content, source, lang AS section, CAST(publish_date AS VARCHAR) AS publish_date FROM scored"


@query("S06_jsonl_scan", DOCS, ("scored",))
def _(t):
    path = jsonl_folder(t)
    df = documents.scan_jsonl(t.spark, [f"{path}/source={s}" for s in ("national", "regional_a", "regional_b", "absent")])
    return df.filter("_bad_line IS NULL").select("doc_id", "content", "source", "section", "publish_date")


@query("S07_recursive_jsonl_scan", DOCS, ("scored",))
def _(t):
    df = documents.scan_jsonl(t.spark, [jsonl_folder(t)])
    return df.select("doc_id", "content", "source", "section", "publish_date")


SCORE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("scores", T.StructType([
    T.StructField(n, T.DoubleType()) for n in ("supply", "demand", "policy_strength")]))])


def batch_folder(t):
    """Scored documents in numbered batch files, one JSON array each; every fourth document is in two batches."""
    path = fresh_path(t.spark, "batches")
    doc = F.struct("doc_id", F.struct("supply", F.when(F.col("doc_id") % 5 > 0, F.col("demand")).alias("demand"),
                                      F.col("strength").alias("policy_strength")).alias("scores"))
    numbers = F.when(F.col("doc_id") % 4 == 0, F.array((F.col("doc_id") / 50).cast("int"), (F.col("doc_id") / 50).cast("int") + 1)).otherwise(
        F.array((F.col("doc_id") / 50).cast("int")))
    rows = t.scored.select(F.explode(numbers).alias("n"), doc.alias("doc"))
    # A batch file holds at most fifty documents and the repeats of one neighbour, the format's own bound.
    arrays = rows.groupBy("n").agg(F.to_json(F.array_sort(F.collect_list("doc"))).alias("value"))
    arrays.withColumn("batch", F.format_string("batch_%04d", "n")).select("value", "batch").write.partitionBy("batch").text(path)
    return path


BATCHES = """
WITH b AS (SELECT doc_id, supply, CASE WHEN doc_id % 5 > 0 THEN demand END AS demand, strength AS policy_strength, CAST(doc_id // 50 AS BIGINT) AS batch_num FROM scored
           UNION ALL SELECT doc_id, supply, CASE WHEN doc_id % 5 > 0 THEN demand END, strength, CAST(doc_id // 50 + 1 AS BIGINT) FROM scored WHERE doc_id % 4 = 0)
"""


def scan_scores(t):
    return documents.scan_batches(t.spark, f"{batch_folder(t)}/batch=*", SCORE)


@query("S08_batch_scan", BATCHES + "SELECT batch_num, doc_id, supply, demand, policy_strength FROM b", ("scored",))
def _(t):
    return scan_scores(t).select("batch_num", "doc_id", "scores.*")


@query("A24_score_extraction", BATCHES + "SELECT batch_num, doc_id, supply AS score_supply, coalesce(demand, 0) AS score_demand, policy_strength AS score_policy_strength FROM b", ("scored",))
def _(t):
    return scan_scores(t).select("batch_num", "doc_id", *[
        F.coalesce(F.col(f"scores.{n}"), F.lit(0.0)).alias(f"score_{n}") for n in ("supply", "demand", "policy_strength")])


@query("X03_struct_field_default", "SELECT doc_id, supply, CASE WHEN doc_id % 5 > 0 THEN demand ELSE 0 END AS demand FROM scored", ("scored",))
def _(t):
    scores = F.struct("supply", F.when(F.col("doc_id") % 5 > 0, F.col("demand")).alias("demand"))
    return t.scored.select("doc_id", scores.alias("s")).select("doc_id", *[F.coalesce(F.col(f"s.{n}"), F.lit(0.0)).alias(n) for n in ("supply", "demand")])


@query("I03_merge_batches", BATCHES + """
SELECT doc_id, min(batch_num) AS batch_num, arg_min(supply, batch_num) AS score_supply, coalesce(arg_min(demand, batch_num), 0) AS score_demand,
       arg_min(policy_strength, batch_num) AS score_policy_strength FROM b GROUP BY doc_id
""", ("scored",))
def _(t):
    from marketloom.operators.ordering import first_per_key

    first = first_per_key(scan_scores(t), ["doc_id"], ["batch_num", "pos"])
    return first.select("doc_id", "batch_num", *[
        F.coalesce(F.col(f"scores.{n}"), F.lit(0.0)).alias(f"score_{n}") for n in ("supply", "demand", "policy_strength")])


@query("S09_panel_sink", "SELECT market, date, close, volume FROM panel", ("panel",))
def _(t):
    path = fresh_path(t.spark, "panel")
    sinks.write_panel(t.panel.select("market", "date", "close", "volume"), path)
    return t.spark.read.parquet(path).select("market", "date", "close", "volume")


@query("S10_jsonl_sink", "SELECT doc_id, text FROM documents")
def _(t):
    path = fresh_path(t.spark, "jsonl")
    documents.write_jsonl(t.documents.select("doc_id", "text"), path)
    return t.spark.read.schema("doc_id long, text string").json(path)


@query("S11_section_sink", "SELECT doc_id, source, lang, n_chars FROM documents")
def _(t):
    path = fresh_path(t.spark, "sections")
    documents.write_jsonl(t.documents.select("doc_id", "source", "lang", "n_chars"), path, ["source", "lang"], mode="append")
    return t.spark.read.schema("doc_id long, n_chars long, source string, lang string").json(path)


@query("S12_summary_sink", "SELECT source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def _(t):
    path = fresh_path(t.spark, "summary")
    sinks.write_summary(t.documents.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars")), path)
    return t.spark.read.schema("source string, documents long, chars long").option("header", "true").csv(path)


@query("S13_metrics_sink", """
SELECT market, count(*) AS n, R6(avg(CAST(pred = actual AS INTEGER))) AS accuracy FROM pred GROUP BY market
""", ("pred",))
def _(t):
    path = fresh_path(t.spark, "metrics")
    hit = F.avg((F.col("pred") == F.col("actual")).cast("int"))
    sinks.write_metrics(t.pred.groupBy("market").agg(F.count("*").alias("n"), F.round(hit, 6).alias("accuracy")), ["market"], path)
    parsed = t.spark.read.text(path).select(F.from_json("value", "market string, metrics struct<n: long, accuracy: double>").alias("j"))
    return parsed.select("j.market", "j.metrics.n", "j.metrics.accuracy")


@query("S14_prediction_store", """
SELECT 'base' AS model, market, 'daily' AS frequency, CAST(year(date) - 1995 AS INTEGER) AS walk, date, prob, pred, actual FROM pred
""", ("pred",))
def _(t):
    path = fresh_path(t.spark, "predictions")
    rows = t.pred.select(
        F.lit("base").alias("model"), "market", F.lit("daily").alias("frequency"), (F.year("date") - 1995).alias("walk"), "date", "prob", "pred", "actual")
    sinks.write_predictions(rows, path)
    return t.spark.read.parquet(path).select(*sinks.PREDICTION_KEYS, "prob", "pred", "actual")


REGISTRY = """
WITH g AS (SELECT CASE WHEN month(date) % 2 = 0 THEN 'daily_base' ELSE 'daily_sentiment' END AS model_type, market, max(date) AS ts,
       avg(CAST(pred = actual AS INTEGER)) AS accuracy, CASE WHEN month(date) % 3 = 0 THEN avg(prob) END AS test_accuracy, month(date) AS m FROM pred GROUP BY market, month(date))
"""


def registry(t):
    m = F.month("date")
    return t.pred.groupBy("market", m.alias("m")).agg(
        F.max("date").alias("ts"), F.avg((F.col("pred") == F.col("actual")).cast("int")).alias("accuracy"), F.avg("prob").alias("p")).select(
        F.when(F.col("m") % 2 == 0, "daily_base").otherwise("daily_sentiment").alias("model_type"), "market", "ts", "accuracy",
        F.when(F.col("m") % 3 == 0, F.col("p")).alias("test_accuracy"))


@query("S15_results_registry", REGISTRY + """
SELECT model_type, market, ts, R6(coalesce(test_accuracy, accuracy, 0)) AS accuracy, 0.0 :: DOUBLE AS recall FROM (
  SELECT *, row_number() OVER (PARTITION BY model_type, market ORDER BY ts DESC) AS i FROM g) WHERE i = 1
""", ("pred",))
def _(t):
    latest = sinks.latest_results(registry(t), ["model_type", "market"])
    return latest.select(
        "model_type", "market", "ts", F.round(sinks.metric("accuracy", latest.columns), 6).alias("accuracy"),
        sinks.metric("recall", latest.columns).alias("recall"))
