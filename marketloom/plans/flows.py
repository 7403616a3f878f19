"""The three end-to-end flows, each one plan over all markets, indicators, models and strategies.

Stages hand DataFrames to each other; nothing is written in between unless a stage is read more than once, and then
it is checkpointed in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.operators import boosting, cleaning, documents, indicators, learning, logistic, performance, portfolio, sentiment, series, technical, weekly
from marketloom.operators.series import ordered
from marketloom.session import settle

KEYS = ["market"]


def price_features(prices: DataFrame, sessions: DataFrame, series_long: DataFrame | None = None, names: Sequence[str] = (),
                   mature_share: float = 0.5) -> DataFrame:
    """Raw prices to the open-day feature panel, with lagged indicators and their ages when given.

    ``prices`` has market, date, close, vwap, volume, turnover; ``sessions`` the trading days; ``series_long`` the
    columns indicator, date, value.
    """
    days = series.date_spine(prices, KEYS)
    flagged = cleaning.activity_flags(days, sessions)
    mature = series.maturity_cut(flagged, KEYS, "has_trade", 60, mature_share).drop("trade_frequency")
    filled = cleaning.zero_fill(mature, ["volume", "turnover"])
    w = ordered(KEYS)
    filled = filled.withColumns({c: series.forward_fill(c, w) for c in ("close", "vwap")})
    opened, _ = cleaning.split_by(series.day_gap(filled, KEYS), "is_open")
    panel = opened.drop("is_open")
    if series_long is not None:
        panel = indicators.join_wide(panel, lagged_indicators(series_long), names)
        panel = technical.with_ages(panel, list(names))
    return technical.technical_features(panel)


def lagged_indicators(series_long: DataFrame) -> DataFrame:
    """Indicators on every calendar day, filled forward and lagged by their publication lag."""
    keys = ["indicator"]
    spine = series.date_spine(series_long, keys)
    daily = settle(spine.withColumn("value", series.forward_fill("value", ordered(keys))))
    return indicators.shifted(daily, keys, indicators.detected_frequency(daily, keys)).select("indicator", "date", "value")


def clean_and_filter(docs: DataFrame, rules: Sequence[documents.Pattern], keyword: str, title: str = "title", content: str = "content") -> DataFrame:
    """Documents cleaned by the rules, then kept when title or content holds the keyword; in one pass."""
    return documents.clean(docs, rules, content).filter(text.has_keyword(title, content, keyword))


def market_sentiment(scored: DataFrame, sources: dict[str, Sequence[str]], published: str = "publish_date") -> DataFrame:
    """Scored documents to daily sentiment features per market; invalid scores go, effect starts the day after."""
    valid = scored.filter(sentiment.valid_scores())
    rows = sentiment.market_rows(valid, sources).withColumn("effective_date", F.date_add(published, 1))
    # Decay and daily means both read the documents, so the few columns they need are kept once.
    shared = settle(rows.select("market", "effective_date", "supply", "demand", "strength"))
    return sentiment.daily_sentiment(shared)


def walk_forward(panel: DataFrame, features: Sequence[str], steps: int = 60, split: learning.Split = learning.DAILY) -> DataFrame:
    """Feature panel to out-of-sample probabilities, predictions and labels per market, walk and date."""
    rows = panel.dropna(how="any").withColumn("y", learning.label())
    walks = learning.scaled(learning.assign_walks(rows, KEYS, split), [*KEYS, "walk"], features)
    seq, columns = logistic.sequence_summaries(walks, [*KEYS, "walk", "role"], features, steps)
    out = logistic.walk_probabilities(seq, [*KEYS, "walk"], columns)
    return out.withColumn("pred", learning.decide())


def weekly_walk_forward(panel: DataFrame, features: Sequence[str], steps: int = 12, split: learning.Split = learning.WEEKLY) -> DataFrame:
    """Daily feature panel to out-of-sample probabilities of weeks: rolled up, technical columns made anew, weekly walks."""
    return walk_forward(weekly.panel(panel, KEYS), features, steps, split)


def error_rows(predictions: DataFrame, daily: DataFrame | None = None, weekly_too: bool = True) -> DataFrame:
    """Daily and weekly predictions (market, date, close, prob, pred, actual) with all inputs of the error model and its target.

    ``daily`` holds the sentiment features per market and effective_date; days without any have zeros. A week takes the
    last prediction, rolls its features up by their rules, and rises if its last close is above the last week's.
    """
    rows = predictions.select("market", "date", "close", "prob", "pred", "actual")
    if daily is not None:
        rows = sentiment.merge_same_day(rows, daily, learning.SENTIMENT_INPUTS)
    both = rows.withColumn("frequency", F.lit("daily"))
    if weekly_too:
        week = weekly.roll_up(rows.drop("actual"), KEYS).withColumn("frequency", F.lit("weekly"))
        rise = (F.col("close") > F.lag("close").over(ordered(KEYS))).cast("int")
        both = both.unionByName(week.withColumn("actual", rise).filter("actual IS NOT NULL"))
    mean = "sentiment_mean" if daily is not None else None
    if mean:
        both = both.withColumn(mean, (F.col("sentiment_supply") + F.col("sentiment_demand")) / 2)
    return learning.error_features(both, sentiment=mean).withColumn("wrong", (F.col("pred") != F.col("actual")).cast("int"))


def reverse_errors(rows: DataFrame, features: Sequence[str], keys: Sequence[str] = ("market", "frequency"),
                   settings: boosting.Settings = boosting.Settings()) -> DataFrame:
    """Rows of :func:`error_rows` with an error probability and the reversed decision.

    Each key has an error model of its own, fitted on the first 60 % of its rows; its threshold is chosen on the next
    20 %, and both are applied to the rows after the first part, which carry their ``part``.
    """
    keys = list(keys)
    rows = settle(learning.chronological_split(rows, keys))
    model = boosting.fit(rows.filter("part = 'train'"), keys, ["date"], features, "wrong", settings)
    later = settle(boosting.probabilities(rows.filter("part <> 'train'"), keys, features, model, settings))
    best = learning.best_threshold(later.filter("part = 'val'"), keys).select(*keys, "threshold")
    return learning.reverse(later.join(best, keys), F.col("threshold"))


def backtest(signals: DataFrame, keys: Sequence[str] = ("model", "market"), benchmark: str | None = "Buy&Hold", **costs) -> DataFrame:
    """Signals with prices to all metrics of every series, with the comparison to the benchmark where there is one."""
    nav = settle(portfolio.nav_costed(signals, list(keys), **costs).select(*keys, "date", "nav"))
    metrics = performance.return_metrics(nav, list(keys)).join(performance.recovery(nav, list(keys)), list(keys), "left")
    if benchmark is None:
        return metrics
    rest = [k for k in keys if k != "model"]
    return metrics.join(performance.benchmark_metrics(nav, rest, benchmark), list(keys), "left")


def strategy_signals(predictions: DataFrame, rules: dict[str, Callable[[DataFrame], Column]], prices: DataFrame) -> DataFrame:
    """Signals of several rules on one prediction table, in long form, beside a hold benchmark, with prices."""
    entries = [F.struct(F.lit(n).alias("model"), rule(predictions).cast("double").alias("signal")) for n, rule in rules.items()]
    entries.append(F.struct(F.lit("Buy&Hold").alias("model"), F.lit(1.0).alias("signal")))
    rows = predictions.select("market", "date", F.inline(F.array(*entries)))
    return rows.join(prices.select("market", "date", "close"), ["market", "date"])
