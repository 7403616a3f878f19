"""Performance, risk, drawdown, comparison and significance of value series.

Every function takes a long table of series keyed by columns, so all models, markets and frequencies are one job.
A series has one row per key and day; windows over one series are bounded by the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketloom.functions.significance import normal_p, student_p, with_normal_quantile
from marketloom.operators.series import ordered, trailing, until_now
from marketloom.operators.statistics import average_rank
from marketloom.session import settle

DAYS = 252
RISK_FREE = 0.02
ROOT = math.sqrt(DAYS)


def _safe(n, d) -> Column:
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def rolling_drawdown(df: DataFrame, keys: Sequence[str], c: str, rows: int, date: str = "date", out: str = "max_dd") -> DataFrame:
    """Add the least (x − running maximum) inside each full window over the window's maximum; null for a window with a gap.

    A stretch of rows has a summary: maximum, minimum and least drop. Two neighbouring stretches merge to the larger maximum,
    the smaller minimum, and the least of both drops and of the second's minimum below the first's maximum. Rows fall into
    blocks of the window's length, so a window is the end of one block and the start of the next: running windows over a
    block from either side give both summaries, and each row merges two of them, whatever the window's length.
    """
    w = ordered(list(keys), date)
    x = F.col("_x")
    placed = df.withColumns({"_i": F.row_number().over(w) - 1, "_x": F.col(c).cast("double")}).withColumn("_b", F.floor(F.col("_i") / rows))
    block = Window.partitionBy(*keys, "_b")
    start, end = block.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0), block.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    after = block.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.withColumns({"_h_top": F.max(x).over(start), "_h_low": F.min(x).over(start), "_h_n": F.count(x).over(start)})
    heads = heads.withColumn("_h_drop", F.min(x - F.col("_h_top")).over(start))
    # From the back: a row's drop is the least value after it in the block less its own.
    tails = heads.withColumns({"_t_top": F.max(x).over(end), "_t_n": F.count(x).over(end), "_under": F.least(F.min(x).over(after) - x, F.lit(0.0))})
    tails = tails.withColumn("_t_drop", F.min("_under").over(end))
    tail = F.when(F.col("_i") % rows != rows - 1, F.lag(F.struct(F.col("_t_top").alias("top"), F.col("_t_drop").alias("drop"), F.col("_t_n").alias("n")), rows - 1).over(w))
    met = tails.withColumn("_tail", tail)
    n = F.col("_h_n") + F.coalesce("_tail.n", F.lit(0))
    drop = F.least("_h_drop", "_tail.drop", F.col("_h_low") - F.col("_tail.top"))
    whole = F.when((F.col("_i") >= rows - 1) & (n == rows), drop / F.greatest("_h_top", "_tail.top"))
    return met.withColumn("_out", whole).select(*[k for k in df.columns if k != out], F.col("_out").alias(out))


def with_returns(nav: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the row return ``r``; the first row of a series keeps a null."""
    return nav.withColumn("r", F.col("nav") / F.lag("nav").over(ordered(keys)) - 1)


def drawdowns(nav: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the running maximum and the relative drawdown."""
    return nav.withColumn("peak", F.max("nav").over(until_now(ordered(keys)))).withColumn(
        "dd", (F.col("nav") - F.col("peak")) / F.col("peak"))


def cumulative(nav: DataFrame, keys: Sequence[str]) -> DataFrame:
    return nav.withColumn("cumulative", F.col("nav") / F.first("nav").over(ordered(keys)) - 1)


def _islands(dd: DataFrame, keys: Sequence[str], under: Column) -> DataFrame:
    """Number the stretches where ``under`` holds, with the date of the next row and the final date."""
    w = ordered(keys)
    return (
        dd.withColumn("_under", under)
        .withColumn("_island", F.sum((~F.col("_under")).cast("int")).over(until_now(w)))
        .withColumn("_next", F.lead("date").over(w))
        .withColumn("_final", F.max("date").over(Window.partitionBy(*keys))))


def episodes(nav: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drawdown episodes; one still open at the end has no end and no recovery, and lasts to the final date."""
    rows = _islands(drawdowns(nav, keys), keys, F.col("dd") < 0).filter("_under")
    low = F.min(F.struct("dd", "date", "nav"))
    last = F.max(F.struct("date", "_next"))
    one = rows.groupBy(*keys, "_island").agg(
        F.min("date").alias("start"), low.alias("_low"), last.alias("_last"), F.min_by("peak", "date").alias("peak_value"),
        F.first("_final").alias("_final"))
    end = F.col("_last._next")
    return one.select(
        *keys, "start", F.col("_low.date").alias("trough"), end.alias("end"), "peak_value", F.col("_low.nav").alias("trough_value"),
        F.col("_low.dd").alias("drawdown"), F.datediff(F.coalesce(end, F.col("_final")), "start").alias("duration_days"),
        F.datediff(end, "_low.date").alias("recovery_days"))


def longest_drawdown(nav: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deepest drawdown and the longest closed run of rows below the maximum, counted from its first row."""
    runs = _islands(drawdowns(nav, keys), keys, F.col("dd") < 0).groupBy(*keys, "_island", "_under").agg(
        F.min("dd").alias("_dd"), (F.count("*") - 1).alias("_rows"), F.max_by(F.col("_next").isNotNull(), "date").alias("_closed"))
    counted = F.max(F.when(F.col("_under") & F.col("_closed"), F.col("_rows")))
    return runs.groupBy(*keys).agg(
        F.abs(F.min("_dd")).alias("max_drawdown"), F.coalesce(counted, F.lit(0)).alias("duration_rows"))


def deep_episodes(nav: DataFrame, keys: Sequence[str], depth: float = -20.0, first: int = 3) -> DataFrame:
    """First closed stretches with a drawdown (in percent) below ``depth``; the end is the first row past it."""
    rows = _islands(drawdowns(nav, keys), keys, F.col("dd") * 100 < depth).filter("_under")
    one = rows.groupBy(*keys, "_island").agg(F.min("date").alias("start"), F.max(F.struct("date", "_next"))["_next"].alias("end"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("start"))
    return one.filter("end IS NOT NULL").withColumn("nth", nth).filter(F.col("nth") <= first).select(*keys, "nth", "start", "end")


def severity(depth: Column, mild: float, grave: float) -> Column:
    """Band of a drawdown in percent: minor above ``mild``, moderate above ``grave``, else severe."""
    return F.when(depth > mild, "minor").when(depth > grave, "moderate").otherwise("severe")


def drawdown_band(depth: Column) -> Column:
    """Band of a model's deepest drawdown in percent: severe below −30, moderate below −20."""
    return F.when(depth < -30, "severe").when(depth < -20, "moderate").otherwise("minor")


def rolling_performance(nav: DataFrame, keys: Sequence[str], rows: int = DAYS, rf: float = RISK_FREE) -> DataFrame:
    """Annual return, volatility and Sharpe over the last ``rows`` returns; null before the window is full."""
    w = ordered(keys)
    frame = trailing(w, rows)
    full = F.count("r").over(frame) == rows
    mean, std = F.avg("r").over(frame), F.stddev_samp("r").over(frame)
    return with_returns(nav, keys).filter("r IS NOT NULL").withColumns({
        "return": F.when(full, mean * DAYS), "volatility": F.when(full, std * ROOT),
        "sharpe": F.when(full, F.try_divide(mean - rf / DAYS, std) * ROOT)})


def volatility_regimes(rolling: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Low, normal or high by the quartiles of each series, and spikes over its 95th percentile."""
    known = rolling.filter("volatility IS NOT NULL")
    q = F.percentile("volatility", F.array(F.lit(0.25), F.lit(0.75), F.lit(0.95))).over(Window.partitionBy(*keys))
    v = F.col("volatility")
    return (
        known.withColumn("_q", q)
        .withColumn("regime", F.when(v <= F.col("_q")[0], "low").when(v <= F.col("_q")[1], "normal").otherwise("high"))
        .withColumn("spike", v > F.col("_q")[2]).drop("_q"))


def ranks_by_date(df: DataFrame, keys: Sequence[str], value: str, ascending: bool = False) -> DataFrame:
    """Average rank of the models on each date; volatility ranks ascending, the others descending."""
    return df.filter(F.col(value).isNotNull()).withColumn("rank", average_rank(keys, value, ascending))


def common_start(nav: DataFrame, series: str, keys: Sequence[str] = ()) -> DataFrame:
    """Series cut to the latest of their first dates and rebased to 100 there."""
    starts = nav.groupBy(*keys, series).agg(F.min("date").alias("_s")).groupBy(*keys).agg(F.max("_s").alias("_start"))
    if keys:
        cut = nav.join(starts, list(keys)).filter("date >= _start").drop("_start")
    else:
        cut = nav.filter(F.col("date") >= starts.scalar())
    return cut.withColumn("rebased", F.col("nav") / F.first("nav").over(ordered([*keys, series])) * 100)


def return_metrics(nav: DataFrame, keys: Sequence[str], rf: float = RISK_FREE, confidence: float = 0.95) -> DataFrame:
    """Return, risk, drawdown, tail and shape metrics of every series, from one partitioning by key."""
    daily = rf / DAYS
    var = F.percentile("r", F.lit(1 - confidence)).over(Window.partitionBy(*keys))
    rows = drawdowns(with_returns(nav, keys), keys).withColumn("_var", var)
    r = F.col("r")
    one = rows.groupBy(*keys).agg(
        F.min_by("nav", "date").alias("_first"), F.max_by("nav", "date").alias("_last"), F.datediff(F.max("date"), F.min("date")).alias("_days"),
        F.count("r").alias("n"), F.avg("r").alias("mean_daily_return"), F.stddev_samp("r").alias("daily_volatility"),
        F.stddev_samp(F.when(r < 0, r)).alias("_down"), F.stddev_samp(F.when(r < daily, r)).alias("_below"), F.count_if(r < daily).alias("_n_below"),
        F.min("dd").alias("max_drawdown"), F.first("_var").alias("var_95"), F.avg(F.when(r <= F.col("_var"), r)).alias("cvar_95"),
        F.skewness("r").alias("_g1"), F.kurtosis("r").alias("_g2"),
        F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("positive_days"),
        F.avg(F.when(r.isNotNull(), (r < 0).cast("double"))).alias("negative_days"),
        F.max("r").alias("best_day"), F.min("r").alias("worst_day"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"), F.abs(F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0))).alias("avg_loss"))
    n, mean, std = F.col("n").cast("double"), F.col("mean_daily_return"), F.col("daily_volatility")
    years = F.col("_days") / 365.25
    sortino = F.when(F.col("_n_below") == 0, F.lit(float("inf"))).otherwise(_safe(mean - daily, F.col("_below")) * ROOT)
    return (
        one.withColumn("total_return", F.col("_last") / F.col("_first") - 1)
        .withColumn("cagr", F.when(F.col("_days") > 0, F.pow(1 + F.col("total_return"), 1 / F.when(F.col("_days") > 0, years)) - 1).otherwise(0.0))
        .withColumns({
            "annual_return": mean * DAYS, "annual_volatility": std * ROOT, "downside_volatility": F.col("_down") * ROOT,
            "sharpe_ratio": _safe(mean - daily, std) * ROOT, "sortino_ratio": sortino,
            "calmar_ratio": _safe(F.col("cagr"), F.abs("max_drawdown")),
            "skewness": F.col("_g1") * F.try_divide(F.sqrt(n * (n - 1)), n - 2),
            "kurtosis": F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)})
        .drop("_first", "_last", "_days", "_down", "_below", "_n_below", "_g1", "_g2"))


def paired_returns(nav: DataFrame, keys: Sequence[str], benchmark: str, model: str = "model") -> DataFrame:
    """Returns of every other model beside the benchmark's on the same key and date, without a self-join.

    ``p_all`` is the mean over all returns of the model. A (key, date) group holds one row per model.
    """
    own = F.when(F.col(model) == benchmark, F.col("r"))
    rows = with_returns(nav, [model, *keys]).filter("r IS NOT NULL").select(
        model, *keys, "date", F.col("r").alias("p"), F.avg("r").over(Window.partitionBy(model, *keys)).alias("p_all"),
        F.max(own).over(Window.partitionBy(*keys, "date")).alias("b"))
    return rows.filter((F.col(model) != benchmark) & F.col("b").isNotNull())


def benchmark_metrics(nav: DataFrame, keys: Sequence[str], benchmark: str, rf: float = RISK_FREE, model: str = "model") -> DataFrame:
    """Beta, alpha, information ratio and share of days above the benchmark; alpha uses the means of all returns."""
    active = F.col("p") - F.col("b")
    one = paired_returns(nav, keys, benchmark, model).groupBy(model, *keys).agg(
        F.try_divide(F.covar_samp("p", "b"), F.var_samp("b")).alias("beta"), F.first("p_all").alias("_p"),
        (_safe(F.avg(active) * DAYS, F.stddev_samp(active) * ROOT)).alias("information_ratio"),
        F.avg((F.col("p") > F.col("b")).cast("double")).alias("win_rate_vs_benchmark"))
    mean = with_returns(nav.filter(F.col(model) == benchmark), keys).groupBy(*keys).agg(F.avg("r").alias("_b"))
    return one.join(mean, list(keys)).withColumn(
        "alpha", F.col("_p") * DAYS - (rf + F.col("beta") * (F.col("_b") * DAYS - rf))).drop("_p", "_b")


def side_by_side(metrics: DataFrame, keys: Sequence[str], by: str, sides: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """Columns of two kinds of rows next to each other, one aggregate instead of a self-join; keys need both kinds."""
    def of(kind: str, c: str) -> Column:
        return F.max(F.when(F.col(by) == kind, F.col(c)))

    wide = metrics.groupBy(*keys).agg(
        F.count_distinct(by).alias("_kinds"), *[of(kind, c).alias(f"{p}_{c}") for kind, p in sides.items() for c in columns])
    return wide.filter(F.col("_kinds") == len(sides)).drop("_kinds")


def recovery(nav: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and longest recovery in days over closed episodes."""
    return episodes(nav, keys).groupBy(*keys).agg(
        F.avg("recovery_days").alias("avg_recovery_days"), F.max("recovery_days").alias("max_recovery_days"))


def simple_metrics(nav: DataFrame, keys: Sequence[str], rf: float = 0.0) -> DataFrame:
    """Cumulative and annual return with trading over calendar days as exponent, population volatility, Sharpe."""
    one = with_returns(nav, keys).groupBy(*keys).agg(
        (F.max_by("nav", "date") / F.min_by("nav", "date") - 1).alias("cum_return"),
        F.greatest(F.datediff(F.max("date"), F.min("date")), F.lit(1)).alias("_days"),
        F.avg("r").alias("_mean"), F.stddev_pop("r").alias("_std"))
    return one.select(
        *keys, "cum_return", (F.pow(1 + F.col("cum_return"), F.lit(float(DAYS)) / F.col("_days")) - 1).alias("annual_return"),
        (F.col("_std") * ROOT).alias("annual_vol"), (F.try_divide(F.col("_mean") - rf / DAYS, "_std") * ROOT).alias("sharpe"))


def approximate_profit_factor(metrics: DataFrame) -> DataFrame:
    win = F.col("positive_days")
    return metrics.withColumn("profit_factor", F.try_divide(win * F.col("avg_win"), (1 - win) * F.col("avg_loss")))


def monthly_returns(nav: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return of each month from the last value of the month; an empty month repeats the value before it."""
    last = nav.groupBy(*keys, F.trunc("date", "month").alias("month")).agg(F.max_by("nav", "date").alias("nav"))
    w = Window.partitionBy(*keys).orderBy("month")
    upto = F.coalesce(F.add_months(F.lead("month").over(w), -1), F.col("month"))
    every = last.withColumn("_upto", upto).select(
        *keys, "nav", F.explode(F.sequence("month", "_upto", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return every.withColumn("r", F.col("nav") / F.lag("nav").over(w) - 1).filter("r IS NOT NULL").drop("nav")


def month_matrix(monthly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Years by months."""
    wide = monthly.withColumn("_m", F.month("month")).groupBy(*keys, F.year("month").alias("year")).pivot("_m", list(range(1, 13)))
    out = wide.agg(F.first("r"))
    return out.select(*keys, "year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


def year_returns(monthly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compounded return per year, and the mean over years in a row labelled Avg."""
    years = monthly.groupBy(*keys, F.year("month").cast("string").alias("year")).agg((F.exp(F.sum(F.ln(1 + F.col("r")))) - 1).alias("r"))
    mean = years.groupBy(*keys).agg(F.avg("r").alias("r")).withColumn("year", F.lit("Avg"))
    return years.unionByName(mean)


def pivot_metrics(long: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None, name: str = "metric", value: str = "value") -> DataFrame:
    """One column per name, all that there are or the listed ones; a listed name without rows is an error."""
    rows = settle(long.select(*keys, name, value))
    there = sorted(r[0] for r in rows.select(name).distinct().collect() if r[0] is not None)  # they become columns
    if missing := set(names or ()) - set(there):
        raise ValueError(f"no rows for {sorted(missing)}")
    return rows.groupBy(*keys).pivot(name, list(names or there)).agg(F.first(value))


def best_model(metrics: DataFrame, keys: Sequence[str], benchmark: str | None, score: str = "sharpe_ratio", model: str = "model") -> DataFrame:
    """Model with the highest score per key, without the benchmark where one is named; of equal ones the last by name."""
    rows = metrics if benchmark is None else metrics.filter(F.col(model) != benchmark)
    return rows.groupBy(*keys).agg(F.max_by(model, F.when(F.col(score).isNotNull(), F.struct(score, model))).alias("best_model"), F.max(score).alias(score))


def frontier(metrics: DataFrame, keys: Sequence[str], risk: str, gain: str) -> DataFrame:
    """Models with more return than every model of lower risk."""
    before = F.max(gain).over(Window.partitionBy(*keys).orderBy(risk).rowsBetween(Window.unboundedPreceding, -1))
    return metrics.withColumn("_best", before).filter(F.col("_best").isNull() | (F.col(gain) > F.col("_best"))).drop("_best")


def mean_tests(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled two-sample t of the means and one-sample t of the differences, with their degrees of freedom."""
    d = F.col("p") - F.col("b")
    n = F.col("n")
    pooled = (F.col("_vp") + F.col("_vb")) / 2
    return (
        pairs.groupBy(*keys).agg(
            F.count("*").alias("n"), F.avg("p").alias("_mp"), F.avg("b").alias("_mb"), F.var_samp("p").alias("_vp"), F.var_samp("b").alias("_vb"),
            F.avg(d).alias("_md"), F.stddev_samp(d).alias("_sd"))
        .withColumn("t_statistic", F.try_divide(F.col("_mp") - F.col("_mb"), F.sqrt(pooled * 2 / n)))
        .withColumn("t_paired", F.try_divide(F.col("_md"), F.col("_sd") / F.sqrt(n)))
        .select(*keys, "n", "t_statistic", "t_paired", (2 * n - 2).alias("df"), (n - 1).alias("df_paired")))


def rank_test(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mann–Whitney U of the model against the benchmark, and its z with tie and continuity correction."""
    both = pairs.select(*keys, F.inline(F.array(
        F.struct(F.lit(1).alias("own"), F.col("p").alias("v")), F.struct(F.lit(0).alias("own"), F.col("b").alias("v")))))
    ties = F.count("*").over(Window.partitionBy(*keys, "v"))
    ranked = both.withColumn("_rank", average_rank(keys, "v")).withColumn("_t", ties.cast("double"))
    one = ranked.groupBy(*keys).agg(
        F.sum(F.when(F.col("own") == 1, F.col("_rank"))).alias("_r1"), F.sum("own").alias("n1"), F.count_if(F.col("own") == 0).alias("n2"),
        F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("u_statistic")
    sd = F.sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - F.col("_ties") / ((n1 + n2) * (n1 + n2 - 1))))
    return (
        one.withColumn("u_statistic", F.col("_r1") - n1 * (n1 + 1) / 2)
        .withColumn("z", F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, sd))
        .select(*keys, "u_statistic", "z"))


def significance(pairs: DataFrame, keys: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """The three tests with p-values and flags."""
    both = mean_tests(pairs, keys).join(rank_test(pairs, keys), list(keys))
    out = both.withColumns({
        "p_value": student_p("t_statistic", F.col("df").cast("double")), "p_paired": student_p("t_paired", F.col("df_paired").cast("double")),
        "p_ranks": normal_p("z")})
    return out.withColumns({f"significant_{n}": F.col(p) < 1 - confidence for n, p in (("mean", "p_value"), ("paired", "p_paired"), ("ranks", "p_ranks"))})


# Fixed values of the draws: factors of date, resample and seed, and the factor of a mixing round, all in 32 bits.
DRAW_FACTORS, MIX_FACTOR, MIX_ROUNDS, WORD = (2_246_822_519, 2_654_435_769, 3_266_489_917), 73_244_475, 3, (1 << 32) - 1
#: A row stands in a resample as often as the first place of this list its draw lies below: Poisson's distribution of mean 1.
DRAW_BOUNDS = tuple(int(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) * (1 << 32)) for k in range(12))


def resample_counts(day: np.ndarray, resample: np.ndarray, seed: int) -> np.ndarray:
    """How often the row of a day stands in a resample; (day, resample)."""
    a, b, c = DRAW_FACTORS
    word = np.uint64(WORD)
    x = (day.astype(np.uint64)[:, None] * np.uint64(a) + resample.astype(np.uint64)[None, :] * np.uint64(b) + np.uint64(seed * c & WORD)) & word
    for _ in range(MIX_ROUNDS):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIX_FACTOR)) & word
    return np.searchsorted(np.array(DRAW_BOUNDS, np.uint64), x ^ (x >> np.uint64(16)), side="right")


def bootstrap_sharpe(pairs: DataFrame, keys: Sequence[str], samples: int = 1000, confidence: float = 0.95, seed: int = 17) -> DataFrame:
    """Paired bootstrap of the Sharpe difference: interval, two-tailed p and flag per key.

    A row's count in a resample is drawn from a hash of its day, the resample and the seed, apart from all other rows. So
    no series gathers: a task adds up counts, values and squares of its rows per resample, and an aggregate the tasks'
    sums. All series see the same days drawn.
    """
    keys, sums = list(keys), ["c", "p", "pp", "b", "bb"]
    rows = pairs.filter(F.col("p").isNotNull() & F.col("b").isNotNull()).select(
        F.to_json(F.struct(*keys)).alias("key"), F.unix_date("date").cast("long").alias("day"), F.col("p").cast("double").alias("p"), F.col("b").cast("double").alias("b"))

    def add_up(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            key = batch.column("key").dictionary_encode()
            of, day, p, b = key.indices.to_numpy(), *(batch.column(c).to_numpy() for c in ("day", "p", "b"))
            for k, name in enumerate(key.dictionary.to_pylist()):
                at = np.flatnonzero(of == k)
                for lo in range(0, len(at), 1024):
                    own = at[lo: lo + 1024]
                    counts = resample_counts(day[own], np.arange(samples), seed).astype(float)
                    part = np.stack([np.ones(len(own)), p[own], p[own] ** 2, b[own], b[own] ** 2]) @ counts
                    total[name] = total[name] + part if name in total else part
        for name, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * samples), pa.array(np.arange(samples)), *map(pa.array, part)], ["key", "resample", *sums])

    drawn = rows.mapInArrow(add_up, "key string, resample long, " + ", ".join(f"{c} double" for c in sums)).groupBy("key", "resample").agg(*[F.sum(c).alias(c) for c in sums])

    def ratio(n, x: str, xx: str) -> Column:
        mean = F.try_divide(F.col(x), n)
        sd = F.sqrt(F.greatest(F.try_divide(F.col(xx), n) - mean * mean, F.lit(0.0)))
        return F.when(sd > 1e-12, mean / sd * ROOT).otherwise(0.0)

    diff = F.round(ratio(F.col("c"), "p", "pp") - ratio(F.col("c"), "b", "bb"), 10)
    alpha = 1 - confidence
    whole = pairs.groupBy(*keys).agg(
        F.count_if(F.col("p").isNotNull() & F.col("b").isNotNull()).alias("n"), F.sum("p").alias("p"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum("b").alias("b"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    whole = whole.select(*keys, F.to_json(F.struct(*keys)).alias("key"), ratio(F.col("n"), "p", "pp").alias("sharpe_model"), ratio(F.col("n"), "b", "bb").alias("sharpe_benchmark"))
    one = drawn.select("key", diff.alias("diff")).groupBy("key").agg(
        F.percentile("diff", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_ci"),
        F.avg((F.col("diff") <= 0).cast("double")).alias("_le"), F.avg((F.col("diff") >= 0).cast("double")).alias("_ge"))
    observed = F.col("sharpe_model") - F.col("sharpe_benchmark")
    return whole.join(one, "key").select(
        *keys, "sharpe_model", "sharpe_benchmark", observed.alias("difference"), F.col("_ci")[0].alias("ci_lower"), F.col("_ci")[1].alias("ci_upper"),
        (2 * F.when(observed > 0, F.col("_le")).otherwise(F.col("_ge"))).alias("p_value")
    ).withColumn("significant", (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0))


def normal_plot(returns: DataFrame, keys: Sequence[str], value: str = "r") -> DataFrame:
    """Ordered values beside normal quantiles at the median order positions."""
    n = F.count("*").over(Window.partitionBy(*keys)).cast("double")
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(value, "date"))
    edge = F.pow(F.lit(0.5), 1 / n)
    place = F.when(i == n, edge).when(i == 1, 1 - edge).otherwise((i - 0.3175) / (n + 0.365))
    placed = returns.select(*keys, i.alias("nth"), place.alias("_p"), F.col(value).alias("ordered"))
    return with_normal_quantile(placed, "_p", "theoretical").drop("_p")


def performance_summary(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Report table: percentages with one decimal, ratios with two."""
    percent = {"return_pct": "total_return", "cagr_pct": "cagr", "volatility_pct": "annual_volatility", "max_dd_pct": "max_drawdown", "win_rate_pct": "positive_days"}
    ratio = {"sharpe": "sharpe_ratio", "sortino": "sortino_ratio", "calmar": "calmar_ratio"}
    return metrics.select(
        *keys, *[F.round(F.col(c) * 100, 1).alias(n) for n, c in percent.items()], *[F.round(c, 2).alias(n) for n, c in ratio.items()])
