"""Edge frames: empty stretches, ties, one row, open ends."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.operators import cleaning, decay, indicators, learning, performance, portfolio, sentiment, series, slots
from marketloom.operators.series import ordered

D0 = dt.date(2020, 1, 1)


def frame(spark, values, column="close", market="a", start=D0):
    rows = [(market, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"market string, date date, {column} double")


def values(df, column):
    return [r[column] for r in df.orderBy("date").collect()]


def test_one_row_per_market(spark):
    df = frame(spark, [5.0])
    w = ordered(["market"])
    row = df.select(series.band_width("close", w).alias("b"), series.log_return("close", w).alias("r")).first()
    assert row.b is None and row.r is None
    nav = portfolio.nav_frictionless(df.withColumn("signal", F.lit(1)), ["market"], capital=100.0)
    assert nav.first().nav == 100.0


def test_interpolation_ends(spark):
    df = frame(spark, [None, 1.0, None, None, 4.0, None])
    one = df.withColumn("v", series.interpolated("close", ["market"]))
    both = df.withColumn("v", series.interpolated("close", ["market"], both=True))
    assert values(one, "v") == [None, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert values(both, "v") == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_interpolation_rounds_half_to_even(spark):
    df = frame(spark, [1.0, None, 1.5])
    assert values(df.withColumn("v", series.interpolated("close", ["market"])), "v")[1] == 1.2


def test_change_flags_with_nulls(spark):
    df = frame(spark, [None, None, 1.0, 1.0])
    assert values(df.withColumn("c", series.changed("close", ordered(["market"]))), "c") == [True, True, True, False]
    assert values(series.data_age(df, "close", ["market"]), "age") == [0, 0, 0, 1]


@pytest.mark.parametrize("step, feature, strategy", [(1.0, None, 100.0), (-1.0, 0.0, 0.0)])
def test_strength_without_losses_or_gains(spark, step, feature, strategy):
    df = frame(spark, [100 + step * i for i in range(16)])
    gain, loss = series.gain_loss("close", ordered(["market"]))
    s = decay.ewm_mean(df.select("market", "date", gain.alias("g"), loss.alias("l")), ["market"], {"gain": "g", "loss": "l"}, 1 / 14, 14)
    last = s.select("date", decay.relative_strength("gain", "loss").alias("f"), decay.relative_strength("gain", "loss", "full").alias("s")).orderBy(F.desc("date")).first()
    assert last.f == feature and last.s == strategy


def test_first_difference_keeps_its_null(spark):
    gain, loss = series.gain_loss("close", ordered(["market"]))
    row = frame(spark, [1.0, 2.0]).select("date", gain.alias("g"), loss.alias("l")).orderBy("date").collect()
    assert (row[0].g, row[0].l, row[1].g, row[1].l) == (None, None, 1.0, 0.0)


def test_friday_document(spark):
    friday = dt.date(2024, 1, 5)
    docs = spark.createDataFrame([("a", friday + dt.timedelta(days=1), 10.0, 20.0, 5.0)], "market string, effective_date date, supply double, demand double, strength double")
    daily = sentiment.daily_weighted(docs)
    prices = spark.createDataFrame([("a", friday, 1.0), ("a", dt.date(2024, 1, 8), 2.0)], "market string, date date, close double")
    same = values(sentiment.merge_same_day(prices, daily, ["sentiment_supply"]), "sentiment_supply")
    as_of = values(sentiment.merge_as_of(prices, daily, ["sentiment_supply"]), "sentiment_supply")
    assert same == [0.0, 0.0] and as_of == [None, 10.0]


def test_month_without_rows(spark):
    nav = spark.createDataFrame([("m", dt.date(2020, 1, 31), 100.0), ("m", dt.date(2020, 3, 2), 110.0)], "model string, date date, nav double")
    got = {r.month: round(r.r, 6) for r in performance.monthly_returns(nav, ["model"]).collect()}
    assert got == {dt.date(2020, 2, 1): 0.0, dt.date(2020, 3, 1): 0.1}


def test_open_drawdown(spark):
    nav = frame(spark, [100, 90, 100, 95, 90], "nav")
    rows = performance.episodes(nav, ["market"]).orderBy("start").collect()
    assert [(r.end is None, r.recovery_days, r.duration_days) for r in rows] == [(False, 1, 1), (True, None, 1)]
    assert performance.longest_drawdown(nav, ["market"]).first().duration_rows == 0
    assert performance.recovery(nav, ["market"]).first().max_recovery_days == 1


def test_no_drawdown_at_all(spark):
    nav = frame(spark, [100, 101, 102], "nav")
    assert performance.episodes(nav, ["market"]).count() == 0
    m = performance.return_metrics(nav, ["market"]).first()
    assert m.max_drawdown == 0 and m.calmar_ratio == 0 and m.sortino_ratio == math.inf
    assert performance.longest_drawdown(nav, ["market"]).first().duration_rows == 0


def test_half_signal(spark):
    df = frame(spark, [10, 20, 40, 80]).join(
        spark.createDataFrame([(D0 + dt.timedelta(days=i), s) for i, s in enumerate([0.5, 0.0, 1.0, 1.0])], "date date, signal double"), "date")
    plain = values(portfolio.nav_frictionless(df, ["market"], capital=100.0), "nav")
    costed = values(portfolio.nav_costed(df, ["market"], capital=100.0, cost=0.0, slippage=0.0), "nav")
    assert plain == [100.0, 100.0, 100.0, 100.0]
    assert [round(x, 6) for x in costed] == [100.0, 100.0, 200.0, 200.0]


@pytest.mark.parametrize("net, label", [(24.0, "neutral price impact"), (25.0, "moderate downward price pressure"), (-25.0, "moderate downward price pressure"), (76.0, "strong upward price pressure")])
def test_price_effect_edges(spark, net, label):
    df = spark.createDataFrame([(0.0, net)], "s double, d double")
    assert df.select(sentiment.price_effect("s", "d").alias("x")).first().x == label


def test_dates(spark):
    cases = ["on 2020-13-05", "2020/1/2 and 2021年3月4日", "2019-02-30", "no date", "于2020-1-2发布"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = [r.d for r in df.select("i", text.extract_date("t").alias("d")).orderBy("i").collect()]
    assert got == [None, dt.date(2021, 3, 4), None, None, dt.date(2020, 1, 2)]


def test_text_cleaning(spark):
    df = spark.createDataFrame([("　碳\t\n价 3.5% <b>x</b>'\"，é",)], "t string")
    assert df.select(text.clean_text("t").alias("c")).first().c == '碳 价 35 x"，'


def test_relative_links(spark):
    base = "https://x.example.org/a/b/list.html?p=1"
    cases = {"c.html": "https://x.example.org/a/b/c.html", "/c.html#t": "https://x.example.org/c.html", "../c.html": "https://x.example.org/a/c.html",
             "../../../c.html": "https://x.example.org/c.html", "./c.html?q=1": "https://x.example.org/a/b/c.html?q=1", "http://y.org/d#e": "http://y.org/d",
             "//z.org/f": "https://z.org/f", "?p=2": "https://x.example.org/a/b/list.html?p=2"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    got = {r.l: r.u for r in df.select("l", text.absolute_url("l", F.lit(base)).alias("u")).collect()}
    assert got == cases


def test_even_probability(spark):
    df = spark.createDataFrame([(0.5,)], "prob double")
    row = learning.error_features(df).withColumn("pred", learning.decide()).first()
    assert row.pred == 0 and row.confidence == 0 and abs(row.entropy - math.log(2)) < 1e-6


def test_threshold_default(spark):
    rows = [("a", 1, 1, 0.9)] * 5
    df = spark.createDataFrame(rows, "market string, pred int, actual int, p_err double")
    assert learning.best_threshold(df, ["market"]).first().threshold == 0.6


def test_runner_up_fills_inner_slot(spark):
    rows = [(1, "supply", "restrict", 9.0), (2, "supply", "restrict", 8.0), (3, "supply", "restrict", 7.0), (4, "policy_strength", "binding", 1.0), (5, "policy_strength", "binding", 1.0)]
    got = {(r.dimension, r.category): (r.doc_id, r.adapted) for r in slots.merged_slots(
        spark.createDataFrame(rows, "doc_id long, dimension string, category string, score double")).collect()}
    assert len(got) == 12
    assert got["supply", "restrict"] == (1, False) and got["supply", "reduce"] == (2, True) and got["supply", "increase"] == (None, False)
    assert got["policy_strength", "binding"] == (4, False) and got["policy_strength", "encouraged"] == (None, False)


def test_lagged_indicators(spark):
    df = frame(spark, range(20), "value").withColumnRenamed("market", "indicator")
    freq = spark.createDataFrame([("a", 15)], "indicator string, lag_rows int")
    got = values(indicators.shifted(df, ["indicator"], freq), "value")
    assert got == [None] * 15 + [0.0, 1.0, 2.0, 3.0, 4.0]


def test_value_bands_are_closed_above(spark):
    df = spark.createDataFrame([(-110.0,), (-109.9,), (25.0,), (110.1,)], "s double")
    got = [r.b for r in df.select(cleaning.bands(F.col("s"), sentiment.SUPPLY_BANDS, sentiment.SUPPLY_LAST).alias("b")).collect()]
    assert got == ["Extreme supply restriction", "Strong supply restriction", "Neutral supply impact", "Extreme supply expansion"]


def test_all_null_column(spark):
    df = frame(spark, [None, None])
    audit = cleaning.null_audit(df, ["close"]).first()
    assert (audit.n_rows, audit.nulls, audit.null_pct) == (2, 2, 100.0)
    assert values(df.withColumn("v", series.interpolated("close", ["market"], both=True)), "v") == [None, None]
