"""Series features: gaps, ages, lags, rolling statistics, strength index, fills, signals."""

from pyspark.sql import functions as F

from marketloom.operators import decay, scan, series
from marketloom.operators.series import ordered
from marketloom.queries.registry import query

M = ["market"]

SPINE = """
WITH spine AS (
  SELECT i.indicator, CAST(i.d AS DATE) AS date, v.value
  FROM (SELECT indicator, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM ind GROUP BY indicator) i
  LEFT JOIN ind v ON v.indicator = i.indicator AND v.date = CAST(i.d AS DATE)),
filled AS (
  SELECT indicator, date, value, last_value(value IGNORE NULLS) OVER (PARTITION BY indicator ORDER BY date ROWS UNBOUNDED PRECEDING) AS daily
  FROM spine)
"""


def daily_indicator(t):
    spine = series.date_spine(t.ind, ["indicator"])
    return spine.withColumn("daily", series.forward_fill("value", ordered(["indicator"])))


@query("J01_date_spine", SPINE + "SELECT indicator, date, value FROM spine", ("ind",))
def _(t):
    return series.date_spine(t.ind, ["indicator"])


@query("W01_day_gap", """
SELECT market, date,
       CAST(CASE WHEN is_open THEN coalesce(date_diff('day', prev, date), 0) ELSE 0 END AS BIGINT) AS gap_days
FROM (SELECT market, date, is_open, max(CASE WHEN is_open THEN date END) OVER
        (PARTITION BY market ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM panel)
""", ("panel",))
def _(t):
    return series.day_gap(t.panel, M).select("market", "date", F.col("gap_days").cast("long").alias("gap_days"))


@query("W02_change_flag", SPINE + """
SELECT indicator, date, NOT coalesce(daily = lag(daily) OVER (PARTITION BY indicator ORDER BY date), FALSE) AS changed FROM filled
""", ("ind",))
def _(t):
    d = daily_indicator(t)
    return d.select("indicator", "date", series.changed("daily", ordered(["indicator"])).alias("changed"))


@query("W03_data_age", SPINE + """
, f AS (SELECT indicator, date, daily,
          CAST(NOT coalesce(daily = lag(daily) OVER (PARTITION BY indicator ORDER BY date), FALSE) AS INTEGER) AS c FROM filled),
g AS (SELECT *, sum(c) OVER (PARTITION BY indicator ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT indicator, date, daily, CAST(row_number() OVER (PARTITION BY indicator, island ORDER BY date) - 1 AS BIGINT) AS age FROM g
""", ("ind",))
def _(t):
    d = series.data_age(daily_indicator(t), "daily", ["indicator"])
    return d.select("indicator", "date", "daily", F.col("age").cast("long").alias("age"))


@query("W04_row_lag", SPINE + """
SELECT indicator, date, lag(daily, 15) OVER (PARTITION BY indicator ORDER BY date) AS value_15 FROM filled
""", ("ind",))
def _(t):
    return daily_indicator(t).select("indicator", "date", F.lag("daily", 15).over(ordered(["indicator"])).alias("value_15"))


@query("W05_rolling_mean", """
SELECT market, date,
       R6(CASE WHEN count(*) OVER w60 >= 60 THEN avg(CAST(CAST(has_trade AS INTEGER) AS DOUBLE)) OVER w60 END) AS trade_frequency,
       R6(avg(volume) OVER w20) AS volume_mean
FROM panel WINDOW w60 AS (PARTITION BY market ORDER BY date ROWS 59 PRECEDING), w20 AS (PARTITION BY market ORDER BY date ROWS 19 PRECEDING)
""", ("panel",))
def _(t):
    w = ordered(M)
    return t.panel.select(
        "market", "date",
        F.round(series.rolling_mean(F.col("has_trade").cast("double"), w, 60), 6).alias("trade_frequency"),
        F.round(series.rolling_mean("volume", w, 20, 1), 6).alias("volume_mean"))


@query("W06_band_width", """
SELECT market, date, R6(4 * stddev_samp(close) OVER w / nullif(avg(close) OVER w, 0)) AS bb_width
FROM px WINDOW w AS (PARTITION BY market ORDER BY date ROWS 19 PRECEDING)
""", ("px",))
def _(t):
    return t.px.select("market", "date", F.round(series.band_width("close", ordered(M)), 6).alias("bb_width"))


@query("W07_returns", """
WITH f AS (SELECT market, date, last_value(close IGNORE NULLS) OVER (PARTITION BY market ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM panel)
SELECT market, date, R6(ln(c / lag(c) OVER w)) AS log_return, R6(c / lag(c, 5) OVER w - 1) AS return_5d
FROM f WINDOW w AS (PARTITION BY market ORDER BY date)
""", ("panel",))
def _(t):
    w = ordered(M)
    f = t.panel.select("market", "date", series.forward_fill("close", w).alias("c"))
    return f.select(
        "market", "date", F.round(series.log_return("c", w), 6).alias("log_return"),
        F.round(series.percent_change("c", w, 5), 6).alias("return_5d"))


@query("W08_gain_loss", """
SELECT market, date, R5(greatest(d, 0)) AS gain, R5(greatest(-d, 0)) AS loss
FROM (SELECT market, date, close - lag(close) OVER (PARTITION BY market ORDER BY date) AS d FROM px) WHERE d IS NOT NULL
UNION ALL SELECT market, min(date), NULL, NULL FROM px GROUP BY market
""", ("px",))
def _(t):
    gain, loss = series.gain_loss("close", ordered(M))
    return t.px.select("market", "date", F.round(gain, 5).alias("gain"), F.round(loss, 5).alias("loss"))


EWM = """
WITH d AS (SELECT market, date, close - lag(close) OVER w AS d, row_number() OVER w - 2 AS k FROM px WINDOW w AS (PARTITION BY market ORDER BY date)),
x AS (SELECT market, date, k, greatest(d, 0) * CASE k WHEN 0 THEN 1 ELSE 1.0 / 14 END AS g, greatest(-d, 0) * CASE k WHEN 0 THEN 1 ELSE 1.0 / 14 END AS l
      FROM d WHERE d IS NOT NULL),
y AS (SELECT a.market, a.date, a.k, sum(b.g * pow(13.0 / 14, a.k - b.k)) AS gain, sum(b.l * pow(13.0 / 14, a.k - b.k)) AS loss
      FROM x a JOIN x b ON b.market = a.market AND b.k <= a.k GROUP BY a.market, a.date, a.k),
z AS (SELECT d.market, d.date, y.k, y.gain, y.loss FROM d LEFT JOIN y ON y.market = d.market AND y.date = d.date)
"""


def smoothed(t, min_rows):
    gain, loss = series.gain_loss("close", ordered(M))
    parts = t.px.select("market", "date", gain.alias("g"), loss.alias("l"))
    return decay.ewm_mean(parts, M, {"gain": "g", "loss": "l"}, 1 / 14, min_rows)


@query("W09_ewm_mean", EWM + """
SELECT market, date, R6(CASE WHEN k >= 13 THEN gain END) AS avg_gain, R6(CASE WHEN k >= 13 THEN loss END) AS avg_loss FROM z
""", ("px",))
def _(t):
    return smoothed(t, 14).select("market", "date", F.round("gain", 6).alias("avg_gain"), F.round("loss", 6).alias("avg_loss"))


@query("W10_rsi", EWM + """
SELECT market, date, R6(CASE WHEN k >= 13 THEN 100 - 100 / (1 + gain / nullif(loss, 0)) END) AS rsi_14,
       R6(CASE WHEN loss = 0 AND gain > 0 THEN 100 ELSE 100 - 100 / (1 + gain / nullif(loss, 0)) END) AS rsi_open
FROM z
""", ("px",))
def _(t):
    s = smoothed(t, 1)
    ready = F.row_number().over(ordered(M)) >= 15
    return s.select(
        "market", "date",
        F.round(F.when(ready, decay.relative_strength("gain", "loss")), 6).alias("rsi_14"),
        F.round(decay.relative_strength("gain", "loss", zero_loss="full"), 6).alias("rsi_open"))


@query("W11_cyclic_time", """
SELECT market, date, R6(sin(2 * pi() * (isodow(date) - 1) / 7)) AS dow_sin, R6(cos(2 * pi() * (isodow(date) - 1) / 7)) AS dow_cos,
       R6(sin(2 * pi() * (month(date) - 1) / 12)) AS month_sin, R6(cos(2 * pi() * (month(date) - 1) / 12)) AS month_cos
FROM panel
""", ("panel",))
def _(t):
    return t.panel.select("market", "date", *[F.round(c, 6).alias(n) for n, c in series.cyclic().items()])


FFILL = "last_value({c} IGNORE NULLS) OVER (PARTITION BY market ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query("W12_forward_fill", f"SELECT market, date, {FFILL.format(c='close')} AS close, {FFILL.format(c='vwap')} AS vwap FROM panel", ("panel",))
def _(t):
    return scan.filled_forward(t.panel.select("market", "date", "close", "vwap"), M, F.unix_date("date"), ["close", "vwap"])


@query("W13_fill_flag", f"SELECT market, date, (close IS NULL AND {FFILL.format(c='close')} IS NOT NULL) AS filled FROM panel", ("panel",))
def _(t):
    filled = F.col("close").isNull() & series.forward_fill("close", ordered(M)).isNotNull()
    return t.panel.select("market", "date", filled.alias("filled"))


INTERPOLATE = """
WITH n AS (SELECT market, date, close, row_number() OVER (PARTITION BY market ORDER BY date) AS i FROM panel),
k AS (SELECT *, CASE WHEN close IS NOT NULL THEN i END AS ki FROM n),
b AS (SELECT *, last_value(close IGNORE NULLS) OVER p AS pv, last_value(ki IGNORE NULLS) OVER p AS pi,
             first_value(close IGNORE NULLS) OVER f AS nv, first_value(ki IGNORE NULLS) OVER f AS ni
      FROM k WINDOW p AS (PARTITION BY market ORDER BY date ROWS UNBOUNDED PRECEDING),
                    f AS (PARTITION BY market ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT market, date, close, nv, CASE WHEN close IS NOT NULL THEN close WHEN pv IS NOT NULL AND nv IS NOT NULL
             THEN pv + (nv - pv) * (i - pi) / (ni - pi) ELSE pv END AS value FROM b)
"""


@query("W14_interpolate_forward", INTERPOLATE + "SELECT market, date, round_even(value, 1) + 0.0 AS value FROM v", ("panel",))
def _(t):
    return t.panel.select("market", "date", series.interpolated("close", M).alias("value"))


@query("W15_interpolate_both", INTERPOLATE + """
SELECT market, date, round_even(coalesce(value, nv), 1) + 0.0 AS value, (close IS NULL AND coalesce(value, nv) IS NOT NULL) AS is_interpolated_daily FROM v
""", ("panel",))
def _(t):
    value = series.interpolated("close", M, both=True)
    return t.panel.select("market", "date", value.alias("value"), "close").select(
        "market", "date", "value", (F.col("close").isNull() & F.col("value").isNotNull()).alias("is_interpolated_daily"))


@query("W24_centred_mean", """
SELECT market, date, R6(CASE WHEN count(close) OVER w = 30 THEN avg(close) OVER w END) AS trend
FROM px WINDOW w AS (PARTITION BY market ORDER BY date ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)
""", ("px",))
def _(t):
    return t.px.select("market", "date", F.round(series.centred_mean("close", ordered(M), 30), 6).alias("trend"))


@query("W28_mean_cross_signal", "SELECT market, date, signal FROM sig WHERE model = 'Trend'", ("sig",))
def _(t):
    return t.px.select("market", "date", series.cross_signal("close", ordered(M)).alias("signal"))


RSI_SIGNAL = EWM + """
, r AS (SELECT market, date, CASE WHEN loss = 0 AND gain > 0 THEN 100 ELSE 100 - 100 / (1 + gain / nullif(loss, 0)) END AS rsi FROM z),
s AS (SELECT market, date, coalesce(last_value(CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN 0 END IGNORE NULLS)
        OVER (PARTITION BY market ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS signal FROM r)
"""


def strength_signal(t):
    rsi = smoothed(t, 1).withColumn("rsi", decay.relative_strength("gain", "loss", zero_loss="full"))
    return rsi.select("market", "date", series.threshold_signal("rsi", ordered(M)).alias("signal"))


@query("W29_strength_signal", RSI_SIGNAL + "SELECT market, date, signal FROM s", ("px",))
def _(t):
    return strength_signal(t)


@query("W30_execution_lag", """
SELECT model, market, date, coalesce(lag(signal) OVER (PARTITION BY model, market ORDER BY date), 0) AS position FROM sig
""", ("sig",))
def _(t):
    return t.sig.select("model", "market", "date", series.lagged("signal", ordered(["model", "market"])).alias("position"))


@query("W31_rolling_accuracy", """
SELECT market, date, R6(acc) AS accuracy FROM (
  SELECT market, date, avg(CAST(pred = actual AS INTEGER)) OVER (PARTITION BY market ORDER BY date ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS acc,
         row_number() OVER (PARTITION BY market ORDER BY date) AS i FROM pred) WHERE i > 50
""", ("pred",))
def _(t):
    w = ordered(M)
    hit = (F.col("pred") == F.col("actual")).cast("int")
    return (
        t.pred.select("market", "date", F.avg(hit).over(w.rowsBetween(-50, -1)).alias("a"), F.row_number().over(w).alias("i"))
        .filter("i > 50").select("market", "date", F.round("a", 6).alias("accuracy")))
