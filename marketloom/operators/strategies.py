"""Strategy registry and signal callbacks: DataFrame and column functions instead of a class per strategy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators import portfolio
from marketloom.operators.cleaning import union_all

Strategy = Callable[[DataFrame], DataFrame]


class Strategies:
    """Named functions from prices to (keys, date, signal); all of them are valued in one job."""

    def __init__(self) -> None:
        self._known: dict[str, Strategy] = {}

    def add(self, name: str, strategy: Strategy) -> None:
        if name in self._known:
            raise ValueError(f"strategy {name} is registered already")
        self._known[name] = strategy

    def signals(self, prices: DataFrame) -> DataFrame:
        """Long signals of all strategies."""
        return union_all([fn(prices).withColumn("strategy", F.lit(name)) for name, fn in self._known.items()])

    def values(self, prices: DataFrame, keys: Sequence[str] = ("market",), whole_units: bool = False, **options) -> DataFrame:
        """Values of all strategies, frictionless or in whole units."""
        rows = self.signals(prices).join(prices.select(*keys, "date", "close"), [*keys, "date"])
        value = portfolio.nav_whole_units if whole_units else portfolio.nav_frictionless
        return value(rows, ["strategy", *keys], **options)


def signals_from(predictions: DataFrame, rule: Callable[[Column], Column], column: str = "prob") -> DataFrame:
    """Signals from a rule on a prediction column."""
    return predictions.withColumn("signal", rule(F.col(column)))
