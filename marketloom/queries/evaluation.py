"""Portfolio and evaluation queries: signals, values, trades, drawdowns, metrics, comparisons, tests."""

from pyspark.sql import functions as F

from marketloom.functions import significance
from marketloom.operators import cleaning, density, learning, performance, portfolio, series
from marketloom.operators.series import ordered
from marketloom.queries.features import RSI_SIGNAL, strength_signal
from marketloom.queries.registry import query
from marketloom.queries.sentiment import rounded
from marketloom.session import settle

K = ["model", "market"]
M = ["market"]
W = "PARTITION BY model, market ORDER BY date"


@query("B01_hold_signal", "SELECT market, date, 1 AS signal FROM px", ("px",))
def _(t):
    return t.px.select("market", "date", F.lit(1).alias("signal"))


@query("B02_frictionless_value", "SELECT model, market, date, nav FROM nav", ("nav",))
def _(t):
    return t.nav


@query("B03_costed_value", "SELECT model, market, date, R2(nav) AS nav FROM pos", ("pos",))
def _(t):
    nav = portfolio.nav_costed(t.sig, K)
    return rounded(nav.select("model", "market", "date", "nav"), "nav", places=2)


#: Capital that seldom buys a unit of the fixture's prices at once, so entries wait for a lower one.
SMALL_CAPITAL = 101.0


@query("B04_whole_unit_value", f"""
WITH RECURSIVE a AS (SELECT model, market, date, close, coalesce(lag(signal) OVER ({W}), 0) AS held FROM sig),
b AS (SELECT *, coalesce(lag(held) OVER ({W}), 0) AS was FROM a),
c AS (SELECT *, sum(CASE WHEN held = 1 AND was = 0 THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS trip FROM b),
s AS (SELECT model, market, CAST(trip AS BIGINT) AS trip, list({{'d': date, 'p': close}} ORDER BY date) FILTER (held = 1) AS asked,
             max(CASE WHEN held = 0 AND was = 1 THEN close END) AS sold FROM c WHERE trip > 0 GROUP BY model, market, trip),
r AS (SELECT DISTINCT model, market, k.capital, CAST(0 AS BIGINT) AS trip, CAST(NULL AS STRUCT(d DATE, p DOUBLE)) AS entry, k.capital AS cash, k.capital AS after
      FROM sig, (VALUES (CAST(1000000 AS DOUBLE)), (CAST({SMALL_CAPITAL} AS DOUBLE))) k(capital)
      UNION ALL SELECT e.model, e.market, e.capital, e.trip, e.entry, e.cash, e.cash + coalesce(floor(e.cash / e.entry.p) * (e.sold - e.entry.p), 0)
      FROM (SELECT r.model, r.market, r.capital, s.trip, s.sold, r.after AS cash, list_filter(s.asked, lambda x: x.p <= r.after)[1] AS entry
            FROM r JOIN s ON s.model = r.model AND s.market = r.market AND s.trip = r.trip + 1) e)
SELECT r.capital, c.model, c.market, c.date, R2(CASE WHEN held = 0 THEN after WHEN c.date >= entry.d THEN cash + floor(cash / entry.p) * (close - entry.p) ELSE cash END) AS nav
FROM c JOIN r ON r.model = c.model AND r.market = c.market AND r.trip = c.trip
""", ("sig",))
def _(t):
    sig = settle(t.sig)
    both = [portfolio.nav_whole_units(sig, K, capital).select(F.lit(capital).alias("capital"), "model", "market", "date", "nav")
            for capital in (1_000_000.0, SMALL_CAPITAL)]
    return rounded(both[0].union(both[1]), "nav", places=2)


LOG = "log AS (SELECT model, market, date, action, trade_units AS units, trade_price AS price, trade_cost AS cost FROM pos WHERE action IS NOT NULL)"


@query("B05_trade_log", "WITH " + LOG + "SELECT model, market, date, action, R4(units) AS units, R6(price) AS price, R4(cost) AS cost FROM log", ("pos",))
def _(t):
    return portfolio.trade_log(t.pos, K).withColumns({"units": F.round("units", 4), "price": F.round("price", 6), "cost": F.round("cost", 4)})


TOTALS = """
WITH m AS (SELECT *, abs(units - lag(units) OVER (PARTITION BY model, market{walk} ORDER BY date)) AS moved FROM {src}),
tot AS (SELECT model, market{walk}, count(action) AS total_trades, coalesce(sum(trade_cost), 0) AS total_costs, coalesce(sum(trade_cost), 0) / 1000000 AS cost_impact,
  coalesce(sum(moved) / nullif(2 * avg(units), 0), 0) AS turnover, arg_max(nav, date) AS final_nav FROM m GROUP BY model, market{walk})
"""


@query("B06_turnover", TOTALS.format(walk="", src="pos") + "SELECT model, market, total_trades, R4(total_costs) AS total_costs, R8(cost_impact) AS cost_impact, R6(turnover) AS turnover, R2(final_nav) AS final_nav FROM tot", ("pos",))
def _(t):
    out = portfolio.trade_totals(t.pos, K)
    return out.withColumns({"total_costs": F.round("total_costs", 4), "cost_impact": F.round("cost_impact", 8), "turnover": F.round("turnover", 6), "final_nav": F.round("final_nav", 2)})


def _walk_pos():
    from marketloom.queries.view_sql import POS

    text = POS.replace("PARTITION BY model, market ORDER", "PARTITION BY model, market, walk ORDER").replace("SELECT model, market, date, close, CASE WHEN coalesce", "SELECT model, market, year(date) AS walk, date, close, CASE WHEN coalesce")
    text = text.replace("FROM sig WINDOW w AS (PARTITION BY model, market, walk ORDER BY date)", "FROM sig WINDOW w AS (PARTITION BY model, market, year(date) ORDER BY date)")
    return text.replace("SELECT model, market, date, close, nav", "SELECT model, market, walk, date, close, nav")


@query("B07_walk_backtest", "WITH wpos AS (" + _walk_pos() + ")," + TOTALS.format(walk=", walk", src="wpos").strip()[len("WITH"):] + """
SELECT model, market, CAST(sum(total_trades) AS BIGINT) AS total_trades, R4(sum(total_costs)) AS total_costs, R8(avg(cost_impact)) AS avg_cost_impact, R6(avg(turnover)) AS avg_turnover,
  R2(arg_max(final_nav, walk)) AS final_nav, count(*) AS num_walks FROM tot GROUP BY model, market
""", ("sig",))
def _(t):
    rows = t.sig.withColumn("walk", F.year("date"))
    per = portfolio.trade_totals(portfolio.costed_positions(rows, [*K, "walk"]), [*K, "walk"])
    return per.groupBy(*K).agg(
        F.sum("total_trades").alias("total_trades"), F.round(F.sum("total_costs"), 4).alias("total_costs"), F.round(F.avg("cost_impact"), 8).alias("avg_cost_impact"),
        F.round(F.avg("turnover"), 6).alias("avg_turnover"), F.round(F.max_by("final_nav", "walk"), 2).alias("final_nav"), F.count("*").alias("num_walks"))


SALES = LOG + f", nx AS (SELECT *, first_value(CASE WHEN action = 'sell' THEN date END IGNORE NULLS) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS sell_date FROM log)"


@query("J09_next_sale", "WITH " + SALES + "SELECT model, market, date, sell_date, date_diff('day', date, sell_date) AS holding_days FROM nx WHERE action = 'buy'", ("pos",))
def _(t):
    out = portfolio.next_sale(portfolio.trade_log(t.pos, K), K)
    return out.select("model", "market", "date", "sell_date", F.col("holding_days").cast("long").alias("holding_days"))


PAIRS = LOG + f", pr AS (SELECT *, lead(action) OVER ({W}) AS na, lead(price) OVER ({W}) AS sell_price FROM log), tr AS (SELECT model, market, date, price, sell_price, (sell_price - price) / price AS profit FROM pr WHERE action = 'buy' AND na = 'sell')"


@query("J10_adjacent_pairs", "WITH " + PAIRS + "SELECT model, market, date, R6(profit) AS profit FROM tr", ("pos",))
def _(t):
    out = portfolio.round_trips(portfolio.trade_log(t.pos, K), K)
    return rounded(out.select("model", "market", "date", "profit"), "profit")


@query("B08_trade_analysis", "WITH " + SALES + """
SELECT model, market, count(*) AS num_trades, CAST(count_if(action = 'buy') AS BIGINT) AS num_buys, CAST(count_if(action = 'sell') AS BIGINT) AS num_sells, R4(avg(units)) AS avg_trade_size, R4(sum(cost)) AS total_commission,
  R6(coalesce(avg(price) FILTER (action = 'buy'), 0)) AS avg_buy_price, R6(coalesce(avg(price) FILTER (action = 'sell'), 0)) AS avg_sell_price, R6(avg(date_diff('day', date, sell_date)) FILTER (action = 'buy')) AS avg_holding_days
FROM nx GROUP BY model, market
""", ("pos",))
def _(t):
    out = portfolio.trade_analysis(portfolio.trade_log(t.pos, K), K)
    return out.withColumns({"avg_trade_size": F.round("avg_trade_size", 4), "total_commission": F.round("total_commission", 4), **{c: F.round(c, 6) for c in ("avg_buy_price", "avg_sell_price", "avg_holding_days")}})


@query("B09_win_rate", "WITH " + PAIRS + """
, ks AS (SELECT DISTINCT model, market FROM log)
SELECT ks.model, ks.market, count(profit) FILTER (profit > 0) AS num_wins, count(profit) FILTER (profit < 0) AS num_losses, R6(coalesce(CAST(count(profit) FILTER (profit > 0) AS DOUBLE) / nullif(count(profit), 0), 0)) AS win_rate,
  R6(coalesce(sum(profit) FILTER (profit > 0), 0) / coalesce(abs(sum(profit) FILTER (profit < 0)), 1)) AS profit_factor, R6(coalesce(avg(profit) FILTER (profit > 0), 0)) AS avg_win, R6(coalesce(avg(profit) FILTER (profit < 0), 0)) AS avg_loss
FROM ks LEFT JOIN tr ON tr.model = ks.model AND tr.market = ks.market GROUP BY ks.model, ks.market
""", ("pos",))
def _(t):
    return rounded(portfolio.win_rate(portfolio.trade_log(t.pos, K), K), "win_rate", "profit_factor", "avg_win", "avg_loss")


@query("B10_baseline_metrics", f"""
WITH r AS (SELECT model, market, date, nav, nav / lag(nav) OVER ({W}) - 1 AS r FROM nav),
a AS (SELECT model, market, arg_max(nav, date) / arg_min(nav, date) - 1 AS c, greatest(date_diff('day', min(date), max(date)), 1) AS d, avg(r) AS m, stddev_pop(r) AS s FROM r GROUP BY model, market)
SELECT model, market, R6(c) AS cum_return, R6(pow(1 + c, 252.0 / d) - 1) AS annual_return, R6(s * sqrt(252)) AS annual_vol, R6(m / s * sqrt(252)) AS sharpe FROM a
""", ("nav",))
def _(t):
    return rounded(performance.simple_metrics(t.nav, K), "cum_return", "annual_return", "annual_vol", "sharpe")


# One text of all metrics per model and market over a value view; queries pick columns from it.
METRICS = """
q AS (SELECT model, market, quantile_cont(r, 0.05) AS var_95 FROM {ret} GROUP BY model, market),
lim AS (SELECT model, market, date_diff('day', min(date), max(date)) AS days, arg_max(nav, date) / arg_min(nav, date) - 1 AS total_return FROM {nav} GROUP BY model, market),
low AS (SELECT model, market, min((nav - peak) / peak) AS max_drawdown FROM (SELECT *, max(nav) OVER (PARTITION BY model, market ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM {nav}) GROUP BY model, market),
st AS (SELECT model, market, avg(r) AS mean, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS down, stddev_samp(r) FILTER (r < 0.02::DOUBLE / 252) AS below, skewness(r) AS skewness, kurtosis(r) AS kurtosis,
   avg(CAST(r > 0 AS INTEGER)) AS positive_days, avg(CAST(r < 0 AS INTEGER)) AS negative_days, max(r) AS best_day, min(r) AS worst_day,
   coalesce(avg(r) FILTER (r > 0), 0) AS avg_win, abs(coalesce(avg(r) FILTER (r < 0), 0)) AS avg_loss FROM {ret} GROUP BY model, market),
cv AS (SELECT model, market, any_value(var_95) AS var_95, avg(r) FILTER (r <= var_95) AS cvar_95 FROM {ret} JOIN q USING (model, market) GROUP BY model, market),
met AS (SELECT *, pow(1 + total_return, 365.25 / days) - 1 AS cagr, mean * 252 AS annual_return, sd * sqrt(252) AS annual_volatility, down * sqrt(252) AS downside_volatility,
   coalesce((mean - 0.02 / 252) / nullif(sd, 0) * sqrt(252), 0) AS sharpe_ratio, coalesce((mean - 0.02 / 252) / nullif(below, 0) * sqrt(252), 0) AS sortino_ratio,
   coalesce((pow(1 + total_return, 365.25 / days) - 1) / nullif(abs(max_drawdown), 0), 0) AS calmar_ratio
  FROM st JOIN lim USING (model, market) JOIN low USING (model, market) JOIN cv USING (model, market))
"""
MET = "WITH " + METRICS.format(ret="ret", nav="nav")


def _metrics_query(name, columns):
    picked = ", ".join(f"R6({e}) AS {c}" for c, e in columns.items())

    @query(name, MET + f"SELECT model, market, {picked} FROM met", ("nav", "ret"))
    def _(t):
        return rounded(performance.return_metrics(t.nav, K).select(*K, *columns), *columns)


def _same(*names):
    return {n: n for n in names}


_metrics_query("B11_return_metrics", {"total_return": "total_return", "cagr": "cagr", "mean_daily_return": "mean", "annual_return": "annual_return"})
_metrics_query("B12_risk_metrics", {"daily_volatility": "sd", **_same("annual_volatility", "downside_volatility", "sharpe_ratio", "sortino_ratio")})
_metrics_query("B13_drawdown_metrics", _same("max_drawdown", "calmar_ratio"))
_metrics_query("B14_tail_risk", _same("var_95", "cvar_95"))
_metrics_query("B15_shape_metrics", _same("skewness", "kurtosis"))
_metrics_query("B17_day_shares", _same("positive_days", "negative_days", "best_day", "worst_day"))
_metrics_query("B19_win_loss_profile", _same("avg_win", "avg_loss"))


@query("B28_approximate_profit_factor", MET + "SELECT model, market, R6(positive_days * avg_win / nullif((1 - positive_days) * avg_loss, 0)) AS profit_factor FROM met", ("nav", "ret"))
def _(t):
    out = performance.approximate_profit_factor(performance.return_metrics(t.nav, K))
    return rounded(out.select(*K, "profit_factor"), "profit_factor")


BENCH = """
base AS (SELECT market, date, r AS b, avg(r) OVER (PARTITION BY market) AS ball FROM ret WHERE model = 'Buy&Hold'),
pairs AS (SELECT r.model, r.market, r.date, r.r AS p, b, ball FROM ret r JOIN base USING (market, date) WHERE r.model <> 'Buy&Hold')
"""


@query("J05_inner_alignment", "WITH " + BENCH + "SELECT model, market, date, R8(p) AS p, R8(b) AS b FROM pairs", ("ret",))
def _(t):
    return rounded(performance.paired_returns(t.nav, M, "Buy&Hold").select("model", "market", "date", "p", "b"), "p", "b", places=8)


@query("B16_benchmark_metrics", MET + "," + BENCH + """
SELECT model, market, R6(covar_samp(p, b) / var_samp(b)) AS beta, R6(any_value(annual_return) - (0.02 + covar_samp(p, b) / var_samp(b) * (any_value(ball) * 252 - 0.02))) AS alpha,
  R6(avg(p - b) * 252 / (stddev_samp(p - b) * sqrt(252))) AS information_ratio, R6(avg(CAST(p > b AS INTEGER))) AS win_rate_vs_benchmark
FROM pairs JOIN met USING (model, market) GROUP BY model, market
""", ("nav", "ret"))
def _(t):
    out = performance.benchmark_metrics(t.nav, M, "Buy&Hold")
    return rounded(out, "beta", "alpha", "information_ratio", "win_rate_vs_benchmark")


@query("J06_price_lookup", "SELECT market, date, prob, close FROM pred", ("pred",))
def _(t):
    t.share_px()
    from marketloom.operators.alignment import lookup

    return lookup(t.pred.select("market", "date", "prob"), t.px.select("market", "date", "close"), ["market", "date"])


@query("J11_positional_join", """
WITH a AS (SELECT market, pred, row_number() OVER (PARTITION BY market ORDER BY date DESC) AS i FROM pred), b AS (SELECT market, date, row_number() OVER (PARTITION BY market ORDER BY date DESC) AS i FROM px)
SELECT market, date, pred FROM a JOIN b USING (market, i)
""", ("pred", "px"))
def _(t):
    t.share_px()
    from marketloom.operators.alignment import align_tail

    return align_tail(t.pred.select("market", "date", "pred"), t.px.select("market", "date"), M, ["pred"])


@query("J12_positional_join_from_start", """
WITH a AS (SELECT market, pred, row_number() OVER (PARTITION BY market ORDER BY date) AS i FROM pred), b AS (SELECT market, date, row_number() OVER (PARTITION BY market ORDER BY date) AS i FROM px)
SELECT market, date, pred FROM a JOIN b USING (market, i)
""", ("pred", "px"))
def _(t):
    t.share_px()
    from marketloom.operators.alignment import align_head

    return align_head(t.pred.select("market", "date", "pred"), t.px.select("market", "date"), M, ["pred"])


@query("W18_running_drawdown", "SELECT model, market, date, peak, R8(dd) AS dd FROM dd", ("dd",))
def _(t):
    return performance.drawdowns(t.nav, K).select(*K, "date", "peak", F.round("dd", 8).alias("dd"))


ISLANDS = f"""
isl AS (SELECT *, sum(CASE WHEN NOT (dd < 0) THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS island, lead(date) OVER ({W}) AS nxt, max(date) OVER (PARTITION BY model, market) AS fin FROM dd),
ep AS (SELECT model, market, island, min(date) AS start, arg_min(date, (dd, date)) AS trough, CASE WHEN count(nxt) = count(*) THEN max(nxt) END AS "end", any_value(peak) AS peak_value, arg_min(nav, (dd, date)) AS trough_value,
   min(dd) AS drawdown, any_value(fin) AS fin, count(*) AS n FROM isl WHERE dd < 0 GROUP BY model, market, island)
"""


@query("W19_drawdown_duration", "WITH " + ISLANDS + """
SELECT d.model, d.market, R8(abs(min(dd))) AS max_drawdown, coalesce((SELECT max(n) - 1 FROM ep WHERE ep.model = d.model AND ep.market = d.market AND ep."end" IS NOT NULL), 0) AS duration_rows FROM dd d GROUP BY d.model, d.market
""", ("dd",))
def _(t):
    return rounded(performance.longest_drawdown(t.nav, K), "max_drawdown", places=8)


@query("W20_drawdown_episodes", "WITH " + ISLANDS + """
SELECT model, market, start, trough, "end", peak_value, trough_value, R8(drawdown) AS drawdown, date_diff('day', start, coalesce("end", fin)) AS duration_days, date_diff('day', trough, "end") AS recovery_days FROM ep
""", ("dd",))
def _(t):
    e = performance.episodes(t.nav, K)
    return e.withColumns({"drawdown": F.round("drawdown", 8), "duration_days": F.col("duration_days").cast("long"), "recovery_days": F.col("recovery_days").cast("long")})


@query("W21_deep_episodes", f"""
WITH isl AS (SELECT *, sum(CASE WHEN NOT (dd * 100 < -20) THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS island, lead(date) OVER ({W}) AS nxt FROM dd),
ep AS (SELECT model, market, min(date) AS start, CASE WHEN count(nxt) = count(*) THEN max(nxt) END AS "end" FROM isl WHERE dd * 100 < -20 GROUP BY model, market, island),
r AS (SELECT *, row_number() OVER (PARTITION BY model, market ORDER BY start) AS nth FROM ep WHERE "end" IS NOT NULL)
SELECT model, market, nth, start, "end" FROM r WHERE nth <= 3
""", ("dd",))
def _(t):
    return performance.deep_episodes(t.nav, K).withColumn("nth", F.col("nth").cast("long"))


@query("B18_recovery_days", "WITH " + ISLANDS + """
SELECT model, market, R6(avg(date_diff('day', trough, "end"))) AS avg_recovery_days, max(date_diff('day', trough, "end")) AS max_recovery_days FROM ep GROUP BY model, market
""", ("dd",))
def _(t):
    r = performance.recovery(t.nav, K)
    return r.withColumns({"avg_recovery_days": F.round("avg_recovery_days", 6), "max_recovery_days": F.col("max_recovery_days").cast("long")})


@query("P23_severity_bands", "WITH " + ISLANDS + """
SELECT model, market, start, CASE WHEN drawdown * 100 > -10 THEN 'minor' WHEN drawdown * 100 > -20 THEN 'moderate' ELSE 'severe' END AS severity,
  CASE WHEN drawdown * 100 < -30 THEN 'severe' WHEN drawdown * 100 < -20 THEN 'moderate' ELSE 'minor' END AS band FROM ep
""", ("dd",))
def _(t):
    depth = F.col("drawdown") * 100
    return performance.episodes(t.nav, K).select(
        *K, "start", performance.severity(depth, -10, -20).alias("severity"), performance.drawdown_band(depth).alias("band"))


def _rolling_sql(n):
    return f"""
roll AS (SELECT model, market, date, CASE WHEN count(r) OVER w = {n} THEN avg(r) OVER w END AS mean, CASE WHEN count(r) OVER w = {n} THEN stddev_samp(r) OVER w END AS sd FROM ret WINDOW w AS ({W} ROWS {n - 1} PRECEDING)),
rp AS (SELECT model, market, date, mean * 252 AS ret, sd * sqrt(252) AS volatility, (mean - 0.02 / 252) / nullif(sd, 0) * sqrt(252) AS sharpe FROM roll)
"""


@query("W22_rolling_performance", "WITH " + _rolling_sql(252) + 'SELECT model, market, date, R6(ret) AS "return", R6(volatility) AS volatility, R6(sharpe) AS sharpe FROM rp', ("ret",))
def _(t):
    out = performance.rolling_performance(t.nav, K)
    return rounded(out.select(*K, "date", "return", "volatility", "sharpe"), "return", "volatility", "sharpe")


@query("P23_strong_sharpe", "WITH " + _rolling_sql(60) + "SELECT model, market, date, round(sharpe, 6) > 1.5 AS strong FROM rp WHERE sharpe IS NOT NULL", ("ret",))
def _(t):
    out = performance.rolling_performance(t.nav, K, 60).filter("sharpe IS NOT NULL")
    return out.select(*K, "date", (F.round("sharpe", 6) > 1.5).alias("strong"))


@query("W23_rolling_max_drawdown", """
WITH n AS (SELECT model, market, date, nav, row_number() OVER (PARTITION BY model, market ORDER BY date) AS i FROM nav),
p AS (SELECT a.model, a.market, a.date, a.i, b.nav AS x, max(b.nav) OVER (PARTITION BY a.model, a.market, a.i ORDER BY b.i ROWS UNBOUNDED PRECEDING) AS top
      FROM n a JOIN n b ON b.model = a.model AND b.market = a.market AND b.i BETWEEN a.i - 59 AND a.i WHERE a.i >= 60)
SELECT model, market, date, R6(min(x - top) / max(top)) AS max_dd FROM p GROUP BY model, market, date
""", ("nav",))
def _(t):
    d = performance.rolling_drawdown(t.nav.select(*K, "date", "nav"), K, "nav", 60)
    return rounded(d.filter("max_dd IS NOT NULL").drop("nav"), "max_dd")


@query("W25_volatility_regimes", "WITH " + _rolling_sql(60) + """
, v AS (SELECT model, market, date, round(volatility, 8) AS v FROM rp WHERE volatility IS NOT NULL),
q AS (SELECT model, market, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, quantile_cont(v, 0.95) AS c FROM v GROUP BY model, market)
SELECT model, market, date, CASE WHEN v <= a THEN 'low' WHEN v <= b THEN 'normal' ELSE 'high' END AS regime, v > c AS spike FROM v JOIN q USING (model, market)
""", ("ret",))
def _(t):
    roll = performance.rolling_performance(t.nav, K, 60).withColumn("volatility", F.round("volatility", 8))
    return performance.volatility_regimes(roll, K).select(*K, "date", "regime", "spike")


@query("W26_rank_by_date", "WITH " + _rolling_sql(60) + """
, v AS (SELECT model, market, date, round(volatility, 4) AS v, round(ret, 4) AS m FROM rp WHERE volatility IS NOT NULL)
SELECT model, market, date, rank() OVER (PARTITION BY market, date ORDER BY v) + (count(*) OVER (PARTITION BY market, date, v) - 1) / 2 AS volatility_rank,
       rank() OVER (PARTITION BY market, date ORDER BY m DESC) + (count(*) OVER (PARTITION BY market, date, m) - 1) / 2 AS return_rank FROM v
""", ("ret",))
def _(t):
    roll = performance.rolling_performance(t.nav, K, 60).withColumns({"v": F.round("volatility", 4), "m": F.round("return", 4)})
    ranked = performance.ranks_by_date(roll, ["market", "date"], "v", ascending=True).withColumnRenamed("rank", "volatility_rank")
    return performance.ranks_by_date(ranked, ["market", "date"], "m").select(*K, "date", "volatility_rank", F.col("rank").alias("return_rank"))


@query("W27_cumulative_return", f"""
WITH c AS (SELECT model, market, date, nav / first_value(nav) OVER ({W}) - 1 AS x FROM nav)
SELECT model, market, R6(arg_max(x, date)) AS final, R6(max(x)) AS highest, R6(min(x)) AS lowest FROM c GROUP BY model, market
""", ("nav",))
def _(t):
    c = performance.cumulative(t.nav, K)
    return c.groupBy(*K).agg(
        F.round(F.max_by("cumulative", "date"), 6).alias("final"), F.round(F.max("cumulative"), 6).alias("highest"), F.round(F.min("cumulative"), 6).alias("lowest"))


@query("T06_extreme_dates", """
SELECT d.model, d.market, arg_min(date, (dd, date)) AS worst_drawdown, any_value(best) AS best_day, any_value(worst) AS worst_day
FROM dd d JOIN (SELECT model, market, arg_min(date, (-r, date)) AS best, arg_min(date, (r, date)) AS worst FROM ret GROUP BY model, market) r ON r.model = d.model AND r.market = d.market GROUP BY d.model, d.market
""", ("dd", "ret"))
def _(t):
    rows = performance.drawdowns(performance.with_returns(t.nav, K), K)
    return rows.groupBy(*K).agg(
        F.min(F.struct("dd", "date"))["date"].alias("worst_drawdown"),
        F.min(F.when(F.col("r").isNotNull(), F.struct((-F.col("r")).alias("k"), "date")))["date"].alias("best_day"),
        F.min(F.when(F.col("r").isNotNull(), F.struct("r", "date")))["date"].alias("worst_day"))


MONTHS = """
ml AS (SELECT model, market, date_trunc('month', date) AS month, arg_max(nav, date) AS nav FROM nav GROUP BY 1, 2, 3),
sp AS (SELECT model, market, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM ml GROUP BY model, market),
mf AS (SELECT s.model, s.market, CAST(s.month AS DATE) AS month, last_value(nav IGNORE NULLS) OVER (PARTITION BY s.model, s.market ORDER BY s.month ROWS UNBOUNDED PRECEDING) AS nav FROM sp s LEFT JOIN ml USING (model, market, month)),
mr AS (SELECT * FROM (SELECT model, market, month, nav / lag(nav) OVER (PARTITION BY model, market ORDER BY month) - 1 AS r FROM mf) WHERE r IS NOT NULL)
"""
MATRIX = ", ".join(f"R6(max(CASE WHEN month(month) = {m} THEN r END)) AS m{m}" for m in range(1, 13))


@query("A18_monthly_matrix", "WITH " + MONTHS + f"SELECT model, market, year(month) AS year, {MATRIX} FROM mr GROUP BY model, market, year(month)", ("nav",))
def _(t):
    wide = performance.month_matrix(performance.monthly_returns(t.nav, K), K)
    return rounded(wide.withColumn("year", F.col("year").cast("long")), *[f"m{m}" for m in range(1, 13)])


@query("A19_year_returns", "WITH " + MONTHS + """
, y AS (SELECT model, market, CAST(year(month) AS VARCHAR) AS year, product(1 + r) - 1 AS r FROM mr GROUP BY 1, 2, 3)
SELECT model, market, year, R6(r) AS r FROM y UNION ALL SELECT model, market, 'Avg', R6(avg(r)) FROM y GROUP BY model, market
""", ("nav",))
def _(t):
    return rounded(performance.year_returns(performance.monthly_returns(t.nav, K), K), "r")


@query("T07_last_three_years", "WITH " + MONTHS + """
, y AS (SELECT model, market, month, r, dense_rank() OVER (PARTITION BY model, market ORDER BY year(month) DESC) AS k FROM mr)
SELECT model, market, month, R6(r) AS r FROM y WHERE k <= 3
""", ("nav",))
def _(t):
    from pyspark.sql import Window

    monthly = performance.monthly_returns(t.nav, K)
    k = F.dense_rank().over(Window.partitionBy(*K).orderBy(F.year("month").desc()))
    return rounded(monthly.withColumn("k", k).filter("k <= 3").drop("k"), "r")


NAMES = ["sharpe_ratio", "total_return", "max_drawdown"]


@query("A20_metric_pivot", MET + "SELECT market, model, " + ", ".join(f"R6({n}) AS {n}" for n in NAMES) + " FROM met", ("nav", "ret"))
def _(t):
    long = cleaning.unpivot(performance.return_metrics(t.nav, K), ["market", "model"], NAMES, name="metric")
    return rounded(performance.pivot_metrics(long, ["market", "model"], NAMES), *NAMES)


@query("A20_model_by_market", MET + "SELECT model, " + ", ".join(
    f"R6(max(CASE WHEN market = '{m}' THEN sharpe_ratio END)) AS \"{m}\"" for m in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM met GROUP BY model", ("nav", "ret"))
def _(t):
    wide = performance.pivot_metrics(performance.return_metrics(t.nav, K), ["model"], None, "market", "sharpe_ratio")
    return rounded(wide, *wide.columns[1:])


@query("A29_best_model", MET + """
SELECT market, arg_max(model, sharpe_ratio) FILTER (model <> 'Buy&Hold') AS best_model, R6(max(sharpe_ratio) FILTER (model <> 'Buy&Hold')) AS sharpe_ratio, arg_max(model, sharpe_ratio) AS best_with_benchmark FROM met GROUP BY market
""", ("nav", "ret"))
def _(t):

    m = settle(performance.return_metrics(t.nav, K))
    with_all = performance.best_model(m, M, None).select("market", F.col("best_model").alias("best_with_benchmark"))
    return rounded(performance.best_model(m, M, "Buy&Hold").join(with_all, "market"), "sharpe_ratio")


@query("T11_efficient_frontier", MET + """
, f AS (SELECT *, max(total_return) OVER (PARTITION BY market ORDER BY annual_volatility ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM met)
SELECT model, market, R6(annual_volatility) AS annual_volatility, R6(total_return) AS total_return FROM f WHERE b IS NULL OR total_return > b
""", ("nav", "ret"))
def _(t):
    m = performance.return_metrics(t.nav, K).select(*K, "annual_volatility", "total_return")
    return rounded(performance.frontier(m, M, "annual_volatility", "total_return"), "annual_volatility", "total_return")


@query("J16_common_start", """
WITH s AS (SELECT max(d) AS start FROM (SELECT market, min(date) AS d FROM px GROUP BY market))
SELECT market, date, R6(close / first_value(close) OVER (PARTITION BY market ORDER BY date) * 100) AS rebased FROM px WHERE date >= (SELECT start FROM s)
""", ("px",))
def _(t):

    px = settle(t.px.select("market", "date", F.col("close").alias("nav")))
    return rounded(performance.common_start(px, "market").select("market", "date", "rebased"), "rebased")


SUMMARY = """R1(total_return * 100) AS return_pct, R1(cagr * 100) AS cagr_pct, R1(annual_volatility * 100) AS volatility_pct, R1(max_drawdown * 100) AS max_dd_pct, R1(positive_days * 100) AS win_rate_pct,
 R2(sharpe_ratio) AS sharpe, R2(sortino_ratio) AS sortino, R2(calmar_ratio) AS calmar"""


@query("B23_performance_summary", MET + f"SELECT model, market, {SUMMARY} FROM met", ("nav", "ret"))
def _(t):
    return performance.performance_summary(performance.return_metrics(t.nav, K), K)


@query("F21_report_format", MET + "SELECT model, market, format('{:.1f}', total_return * 100) AS return_pct, format('{:.2f}', sharpe_ratio) AS sharpe FROM met", ("nav", "ret"))
def _(t):
    m = performance.return_metrics(t.nav, K)
    return m.select(*K, F.format_string("%.1f", F.col("total_return") * 100).alias("return_pct"), F.format_string("%.2f", "sharpe_ratio").alias("sharpe"))


def _weekly_metrics():
    import re

    text = METRICS.format(ret="wret", nav="wnav")
    for n in ("q", "lim", "low", "st", "cv", "met"):
        text = re.sub(rf"\b{n} AS \(", f"w{n} AS (", text)
        text = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 w{n}", text)
    return text


BOTH = MET + "," + _weekly_metrics()


def all_nav(t):
    t.share_px()
    daily = t.nav.withColumn("frequency", F.lit("daily"))
    return daily.unionByName(t.weekly_nav.withColumn("frequency", F.lit("weekly")))


@query("B24_full_matrix", BOTH + f"""
SELECT 'daily' AS frequency, model, market, {SUMMARY} FROM met UNION ALL SELECT 'weekly', model, market, {SUMMARY} FROM wmet
""", ("nav", "ret", "wret"))
def _(t):
    keys = ["frequency", *K]
    return performance.performance_summary(performance.return_metrics(all_nav(t), keys), keys)


@query("J14_daily_weekly_join", BOTH + """
SELECT model, market, R6(d.total_return) AS d_total_return, R6(d.sharpe_ratio) AS d_sharpe_ratio, R6(w.total_return) AS w_total_return, R6(w.sharpe_ratio) AS w_sharpe_ratio FROM met d JOIN wmet w USING (model, market)
""", ("nav", "ret", "wret"))
def _(t):
    m = performance.return_metrics(all_nav(t), ["frequency", *K])
    wide = performance.side_by_side(m, K, "frequency", {"daily": "d", "weekly": "w"}, ["total_return", "sharpe_ratio"])
    return rounded(wide, *[f"{p}_{c}" for p in "dw" for c in ("total_return", "sharpe_ratio")])


@query("U06_model_union", "SELECT DISTINCT model FROM (SELECT model FROM sig UNION ALL SELECT concat(model, '_w') FROM wsig) ORDER BY model", ("sig", "wsig"))
def _(t):
    t.share_px()
    daily = t.sig.select("model")
    return daily.union(t.weekly_nav.select(F.concat("model", F.lit("_w")).alias("model"))).distinct().orderBy("model")


@query("J15_base_variant_gain", """
WITH c AS (SELECT CASE WHEN month(date) % 2 = 0 THEN 'base' ELSE 'sentiment' END AS variant, market, count_if(pred = 1 AND actual = 1) AS tp, count_if(pred = 1 AND actual = 0) AS fp, count_if(pred = 0 AND actual = 1) AS fn FROM pred GROUP BY 1, 2),
f AS (SELECT variant, market, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)
SELECT v.variant, v.market, R6(v.f1) AS f1, CASE WHEN v.variant = 'base' THEN 'baseline' WHEN b.f1 > 0 THEN 'gain' ELSE 'N/A' END AS label, R6(CASE WHEN v.variant <> 'base' THEN (v.f1 - b.f1) / nullif(b.f1, 0) * 100 END) AS gain_pct
FROM f v LEFT JOIN f b ON b.variant = 'base' AND b.market = v.market
""", ("pred",))
def _(t):
    from marketloom.operators.alignment import gain_over_base

    rows = t.pred.withColumn("variant", F.when(F.month("date") % 2 == 0, "base").otherwise("sentiment"))
    m = learning.classification_metrics(rows, ["variant", "market"]).select("variant", "market", "f1")
    return rounded(gain_over_base(m, M, "base"), "f1", "gain_pct")


@query("B20_mean_tests", "WITH " + BENCH + """
, a AS (SELECT model, market, count(*) AS n, avg(p) AS mp, avg(b) AS mb, var_samp(p) AS vp, var_samp(b) AS vb, avg(p - b) AS md, stddev_samp(p - b) AS sd FROM pairs GROUP BY model, market)
SELECT model, market, n, R6((mp - mb) / sqrt((vp + vb) / n)) AS t_statistic, R6(md / (sd / sqrt(n))) AS t_paired, 2 * n - 2 AS df, n - 1 AS df_paired FROM a
""", ("ret",))
def _(t):
    pairs = performance.paired_returns(t.nav, M, "Buy&Hold")
    return rounded(performance.mean_tests(pairs, K), "t_statistic", "t_paired")


RANKS = """
v AS (SELECT model, market, 1 AS own, p AS v FROM pairs UNION ALL SELECT model, market, 0, b FROM pairs),
r AS (SELECT *, rank() OVER (PARTITION BY model, market ORDER BY v) + (count(*) OVER (PARTITION BY model, market, v) - 1) / 2 AS k, count(*) OVER (PARTITION BY model, market, v) AS t FROM v),
a AS (SELECT model, market, sum(k) FILTER (own = 1) AS r1, CAST(sum(own) AS DOUBLE) AS n1, CAST(count_if(own = 0) AS DOUBLE) AS n2, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r GROUP BY model, market),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM a),
z AS (SELECT model, market, u AS u_statistic, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u)
"""

# Student's tail by the continued fraction of the incomplete beta function, 300 steps; the normal one by its series.
TAILS = """
m AS (SELECT model, market, count(*) AS n, avg(p) AS mp, avg(b) AS mb, var_samp(p) AS vp, var_samp(b) AS vb, avg(p - b) AS md, stddev_samp(p - b) AS sd FROM pairs GROUP BY model, market),
st AS (SELECT *, (mp - mb) / sqrt((vp + vb) / n) AS t_statistic, md / (sd / sqrt(n)) AS t_paired, 2 * n - 2 AS df, n - 1 AS df_paired FROM m),
arg AS (SELECT model, market, 'mean' AS kind, df / 2.0::DOUBLE AS a, df / (df + t_statistic ** 2) AS x FROM st UNION ALL SELECT model, market, 'paired', df_paired / 2.0::DOUBLE, df_paired / (df_paired + t_paired ** 2) FROM st),
side AS (SELECT *, x > (a + 1) / (a + 2.5) AS far FROM arg),
near AS (SELECT model, market, kind, far, x, CASE WHEN far THEN 0.5 ELSE a END::DOUBLE AS p, CASE WHEN far THEN a ELSE 0.5 END::DOUBLE AS q, CASE WHEN far THEN 1 - x ELSE x END AS y FROM side),
lentz AS (SELECT model, market, kind, far, x, p, q, y, 0 AS k, 1.0::DOUBLE AS c, 1 / (1 - (p + q) * y / (p + 1)) AS d, 1 / (1 - (p + q) * y / (p + 1)) AS h FROM near
  UNION ALL SELECT model, market, kind, far, x, p, q, y, k, 1 + even / c1, 1 / (1 + even * d1), h * c1 * d1 * (1 + even / c1) / (1 + even * d1)
  FROM (SELECT *, 1 + odd / c AS c1, 1 / (1 + odd * d) AS d1 FROM (SELECT * REPLACE (k + 1 AS k), (k + 1) * (q - k - 1) * y / ((p + 2 * k + 1) * (p + 2 * k + 2)) AS odd,
        -(p + k + 1) * (p + q + k + 1) * y / ((p + 2 * k + 2) * (p + 2 * k + 3)) AS even FROM lentz WHERE k < 300))),
tail AS (SELECT model, market, kind, exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(y) + q * ln(1 - y)) / p * h AS v, far FROM lentz WHERE k = 300),
beta AS (SELECT model, market, max(CASE WHEN kind = 'mean' THEN CASE WHEN far THEN 1 - v ELSE v END END) AS p_value, max(CASE WHEN kind = 'paired' THEN CASE WHEN far THEN 1 - v ELSE v END END) AS p_paired FROM tail GROUP BY 1, 2),
norm AS (SELECT model, market, u_statistic, z, CASE WHEN z <= 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * exp(0 - pow(least(z / sqrt(2), 5), 2)) * list_sum(list_transform(range(0, 120),
  lambda k: exp((2 * k + 1) * ln(greatest(least(z / sqrt(2), 5), 1e-300)) - lgamma(k + 1.5) - ln(2) + ln(pi()) / 2))) END AS p_ranks FROM z)
"""


@query("B20_test_p_values", "WITH RECURSIVE " + BENCH + "," + RANKS + "," + TAILS + """
SELECT model, market, n, R6(t_statistic) AS t_statistic, R6(t_paired) AS t_paired, df, df_paired, u_statistic, R6(z) AS z, R6(p_value) AS p_value, R6(p_paired) AS p_paired, R6(p_ranks) AS p_ranks,
  p_value < 0.05 AS significant_mean, p_paired < 0.05 AS significant_paired, p_ranks < 0.05 AS significant_ranks FROM st JOIN beta USING (model, market) JOIN norm USING (model, market)
""", ("ret",))
def _(t):
    out = performance.significance(performance.paired_returns(t.nav, M, "Buy&Hold"), K)
    return rounded(out, "t_statistic", "t_paired", "z", "p_value", "p_paired", "p_ranks")


@query("B21_rank_test", "WITH " + BENCH + "," + RANKS + "SELECT model, market, u_statistic, R6(z) AS z FROM z", ("ret",))
def _(t):
    return rounded(performance.rank_test(performance.paired_returns(t.nav, M, "Buy&Hold"), K), "z")


def _ratio(n, x, xx):
    """Mean over deviation a year, 0 without a deviation, from count, sum and sum of squares."""
    sd = f"sqrt(greatest({xx} / {n} - ({x} / {n}) * ({x} / {n}), 0))"
    return f"CASE WHEN {sd} > 1e-12 THEN {x} / {n} / {sd} * sqrt(252) ELSE 0 END"


def _bootstrap_sql(samples=1000, seed=17):
    a, b, c = performance.DRAW_FACTORS
    steps = [f"x0 AS (SELECT model, market, p, b, k.range AS resample, ((date_diff('day', DATE '1970-01-01', date) * {a} + k.range * {b} + {seed * c % 2**32}) & {performance.WORD}) AS x FROM pair, range({samples}) k)"]
    for i in range(performance.MIX_ROUNDS):
        steps.append(f"x{i + 1} AS (SELECT model, market, p, b, resample, (xor(x, x >> 16) * {performance.MIX_FACTOR}) & {performance.WORD} AS x FROM x{i})")
    times = " + ".join(f"CAST(xor(x, x >> 16) >= {bound} AS INTEGER)" for bound in performance.DRAW_BOUNDS)
    return f"""
WITH pair AS (SELECT m.model, m.market, m.date, m.r AS p, h.r AS b FROM ret m JOIN ret h ON h.market = m.market AND h.date = m.date AND h.model = 'Buy&Hold' WHERE m.model <> 'Buy&Hold'),
{", ".join(steps)},
c AS (SELECT model, market, resample, p, b, CAST({times} AS DOUBLE) AS c FROM x{performance.MIX_ROUNDS}),
s AS (SELECT model, market, resample, sum(c) AS c, sum(c * p) AS p, sum(c * p * p) AS pp, sum(c * b) AS b, sum(c * b * b) AS bb FROM c GROUP BY 1, 2, 3),
d AS (SELECT model, market, round({_ratio('c', 'p', 'pp')} - {_ratio('c', 'b', 'bb')}, 10) AS diff FROM s),
q AS (SELECT model, market, quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi, avg(CASE WHEN diff <= 0 THEN 1.0 ELSE 0.0 END) AS le, avg(CASE WHEN diff >= 0 THEN 1.0 ELSE 0.0 END) AS ge FROM d GROUP BY 1, 2),
w AS (SELECT model, market, {_ratio('count(*)', 'sum(p)', 'sum(p * p)')} AS sm, {_ratio('count(*)', 'sum(b)', 'sum(b * b)')} AS sb FROM pair GROUP BY 1, 2)
SELECT model, market, R6(sm) AS sharpe_model, R6(sb) AS sharpe_benchmark, R6(sm - sb) AS difference, R6(lo) AS ci_lower, R6(hi) AS ci_upper, R6(2 * CASE WHEN sm - sb > 0 THEN le ELSE ge END) AS p_value,
  lo > 0 OR hi < 0 AS significant FROM w JOIN q USING (model, market)
"""


@query("B22_bootstrap_sharpe", _bootstrap_sql(), ("ret",))
def _(t):
    out = performance.bootstrap_sharpe(performance.paired_returns(t.nav, M, "Buy&Hold"), K)
    return rounded(out, *[c for c in out.columns if c not in (*K, "significant")])


@query("B25_return_density", """
WITH s AS (SELECT model, market, min(r) AS lo, max(r) AS hi, count(*) AS n, stddev_samp(r) AS sd, avg(r) AS mu FROM ret GROUP BY model, market),
g AS (SELECT *, range AS point, lo + range * (hi - lo) / 199 AS x, sd * pow(n, -0.2) AS h FROM s, range(200))
SELECT g.model, g.market, point, R6(any_value(x)) AS x, R6(sum(exp(-0.5 * ((x - r) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))) AS density, R6(any_value(exp(-0.5 * ((x - mu) / sd) ** 2) / (sd * sqrt(2 * pi())))) AS normal
FROM g JOIN ret ON ret.market = g.market AND ret.model = g.model GROUP BY g.model, g.market, point
""", ("ret",))
def _(t):
    d = density.kernel_density(t.ret.select(*K, "r"), K)
    return rounded(d.withColumn("point", F.col("point").cast("long")), "x", "density", "normal")


def _quantile_sql(p):
    """The rational approximation of the normal quantile, in SQL."""
    def poly(coefficients, x, last=""):
        out = f"{coefficients[0]!r}::DOUBLE"
        for c in coefficients[1:]:
            out = f"({out} * {x} + ({c!r}::DOUBLE))"
        return f"({out} * {x} + {last})" if last else out

    tail = f"{poly(significance.C, 't')} / {poly(significance.D, 't', '1')}"
    return f"CASE WHEN {p} < 0.02425 THEN {tail} WHEN {p} > 1 - 0.02425 THEN -({tail}) ELSE {poly(significance.A, 'r')} * q / {poly(significance.B, 'r', '1')} END"


@query("B26_normal_plot", f"""
WITH o AS (SELECT model, market, r AS ordered, row_number() OVER (PARTITION BY model, market ORDER BY r, date) AS nth, CAST(count(*) OVER (PARTITION BY model, market) AS DOUBLE) AS n FROM ret),
e AS (SELECT *, CASE WHEN nth = n THEN pow(0.5::DOUBLE, 1 / n) WHEN nth = 1 THEN 1 - pow(0.5::DOUBLE, 1 / n) ELSE (nth - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM o),
f AS (SELECT *, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS r, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM e)
SELECT model, market, nth, R8(ordered) AS ordered, R6({_quantile_sql('p')}) AS theoretical FROM f
""", ("ret",))
def _(t):
    out = performance.normal_plot(t.ret, K)
    return out.select(*K, F.col("nth").cast("long").alias("nth"), F.round("ordered", 8).alias("ordered"), F.round("theoretical", 6).alias("theoretical"))


@query("X04_strategy_registry", RSI_SIGNAL + """
, all_ AS (SELECT 'Strength' AS strategy, market, date, signal FROM s UNION ALL SELECT model, market, date, signal FROM sig WHERE model <> 'Prob')
SELECT strategy, market, date, signal FROM all_
""", ("px", "sig"))
def _(t):
    t.share_px()
    from marketloom.operators.strategies import Strategies

    strategies = Strategies()
    strategies.add("Buy&Hold", lambda px: px.select("market", "date", F.lit(1).alias("signal")))
    strategies.add("Trend", lambda px: px.select("market", "date", series.cross_signal("close", ordered(M)).alias("signal")))
    strategies.add("Strength", lambda px: strength_signal(t))
    return strategies.signals(t.px)


@query("X05_signal_callback", "SELECT market, date, CASE WHEN prob > 0.6 THEN 1 ELSE 0 END AS signal FROM pred", ("pred",))
def _(t):
    from marketloom.operators.strategies import signals_from

    return signals_from(t.pred, lambda prob: (prob > 0.6).cast("int")).select("market", "date", "signal")
