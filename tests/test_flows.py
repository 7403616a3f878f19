"""The end-to-end flows on the small tables, with the invariants of their outputs."""

import pytest
from pyspark.sql import functions as F

from marketloom.operators import boosting, documents, learning, sentiment
from marketloom.plans import flows
from marketloom.session import settle


@pytest.fixture(scope="module")
def panel(tables):
    px = settle(tables.px)
    names = ["M_A", "Q_F", "D_ALL"]
    return settle(flows.price_features(px, tables.cal.filter("is_open"), tables.ind, names, mature_share=0.1))


def test_feature_panel(panel):
    assert panel.count() > 500 and panel.groupBy("market", "date").count().filter("count > 1").count() == 0
    bad = panel.filter(
        (F.col("rsi_14") < 0) | (F.col("rsi_14") > 100) | (F.abs("dow_sin") > 1) | (F.abs("month_cos") > 1)
        | (F.weekday("date") > 4) | (F.col("gap_days") < 0) | (F.col("is_quiet") & F.col("has_trade")) | (F.col("M_A_age") < 0))
    assert bad.count() == 0
    # Only rows before a market's first trade after the cut can lack a price.
    first = panel.filter("close IS NOT NULL").groupBy("market").agg(F.min("date").alias("first"))
    assert panel.join(first, "market").filter("close IS NULL AND date >= first").count() == 0


def test_documents_to_sentiment(tables):
    docs = tables.documents.select("doc_id", "source", F.lit("").alias("title"), F.col("text").alias("content"))
    kept = flows.clean_and_filter(docs, (documents.Pattern("marks", r"[#%$&*]{3}"),), "the")
    assert 0 < kept.count() < docs.count() and kept.filter(F.col("content").contains("###")).count() == 0
    daily = flows.market_sentiment(tables.scored, {"a": ("national", "regional_a"), "b": ("national", "regional_b")})
    assert daily.groupBy("market", "effective_date").count().filter("count > 1").count() == 0
    assert daily.filter("doc_count < 1 OR market_pressure IS NULL OR supply_decayed IS NULL").count() == 0


def test_predictions_to_backtest(tables, panel):
    split = learning.Split(120, 30, 60, 60, 10)
    features = ["close", "volume", "log_return"]
    probs = settle(flows.walk_forward(panel.select("market", "date", *features), features, steps=10, split=split))
    assert probs.count() > 0 and probs.filter("prob < 0 OR prob > 1").count() == 0
    rules = {"binary": lambda df: F.col("pred"), "confident": lambda df: (F.col("prob") > 0.6).cast("int")}
    metrics = flows.backtest(flows.strategy_signals(probs.dropDuplicates(["market", "date"]), rules, panel)).collect()
    assert {r.model for r in metrics} == {"binary", "confident", "Buy&Hold"}
    assert all(r.beta is not None for r in metrics if r.model == "binary")
    assert all(r.max_drawdown <= 0 for r in metrics)


def test_weekly_path(panel):
    from marketloom.operators import weekly

    week = weekly.panel(panel.drop("M_A", "Q_F", "D_ALL"))
    assert week.groupBy("market", F.trunc("date", "week")).count().filter("count > 1").count() == 0
    # Returns are those between weeks, not the last day's.
    from marketloom.operators.series import ordered

    same = week.withColumn("r", F.ln(F.col("close") / F.lag("close").over(ordered(["market"])))).filter("r IS NOT NULL AND abs(r - log_return) > 1e-12")
    assert same.count() == 0 and week.filter("rsi_14 < 0 OR rsi_14 > 100").count() == 0
    probs = flows.weekly_walk_forward(panel.select("market", "date", "close", "volume"), ["close", "volume", "log_return"], 4, learning.Split(40, 10, 10, 20))
    assert probs.filter("prob < 0 OR prob > 1").count() == 0 and probs.count() > 0


def test_error_reversal(tables):
    docs = settle(tables.scored.withColumn("market", F.lit("ASIA")).withColumn("effective_date", F.date_add("publish_date", 1)))
    rows = flows.error_rows(tables.pred, sentiment.daily_sentiment(docs))
    features = [*learning.PREDICTION_INPUTS, *learning.SENTIMENT_INPUTS, *learning.AGREEMENT_INPUTS]
    out = settle(flows.reverse_errors(rows, features, settings=boosting.Settings(rounds=3, depth=2)))
    assert out.filter("reversed AND final = pred").count() == 0 and out.filter("NOT reversed AND final <> pred").count() == 0
    assert out.filter("p_err < 0 OR p_err > 1").count() == 0
    seen = {(r.market, r.frequency, r.part) for r in out.select("market", "frequency", "part").distinct().collect()}
    markets = {r.market for r in tables.pred.select("market").distinct().collect()}
    assert seen == {(m, f, p) for m in markets for f in ("daily", "weekly") for p in ("val", "test")}
    week = out.filter("frequency = 'weekly'")
    assert week.groupBy("market", F.trunc("date", "week")).count().filter("count > 1").count() == 0
    plain = flows.error_rows(tables.pred, weekly_too=False)
    assert "agrees" not in plain.columns and plain.filter("frequency <> 'daily'").count() == 0
