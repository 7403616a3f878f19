"""Roll-up of a daily panel to ISO weeks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators import technical

# How each column of the daily panel is rolled up; unlisted columns take the last value of the week.
RULES = {
    "close": "last", "vwap": "mean", "volume": "sum", "turnover": "sum", "cum_turnover": "last", "gap_days": "min",
    "doc_count": "sum", "sentiment_supply": "weighted", "sentiment_demand": "weighted", "max_policy": "max", "avg_policy": "mean",
}
LEAST_DAYS = 3


def roll_up(df: DataFrame, keys: Sequence[str], rules: dict[str, str] = RULES, weight: str = "doc_count",
            least_days: int = LEAST_DAYS) -> DataFrame:
    """One row per key and week, dated on its last day; weeks with fewer days than ``least_days`` go."""
    def rule(c: str):
        kind = rules.get(c, "last")
        if kind == "weighted":
            return F.coalesce(F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(weight)), F.lit(0.0))
        return {"last": lambda: F.max_by(c, "date"), "mean": lambda: F.avg(c), "sum": lambda: F.sum(c),
                "min": lambda: F.min(c), "max": lambda: F.max(c)}[kind]()

    values = [c for c in df.columns if c not in keys and c != "date"]
    week = F.trunc("date", "week").alias("_week")
    return (
        df.groupBy(*keys, week)
        .agg(F.max("date").alias("date"), F.count("*").alias("_days"), *[rule(c).alias(c) for c in values])
        .filter(F.col("_days") >= least_days).drop("_days", "_week"))


#: Columns that a week does not take over from its days: they are made anew from the weekly prices and volumes.
RECALCULATED = ("log_return", "return_5d", "bb_width", "volume_sma_20", "rsi_14", "dow_sin", "dow_cos", "month_sin", "month_cos")


def panel(daily: DataFrame, keys: Sequence[str] = ("market",), **kwargs) -> DataFrame:
    """Weekly feature panel of a daily one: rolled up, with the technical columns recalculated on weeks."""
    kept = daily.drop(*RECALCULATED)
    return technical.technical_features(roll_up(kept, list(keys), **kwargs), keys)
