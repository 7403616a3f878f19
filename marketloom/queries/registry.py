"""Registry of named queries, each a function of :class:`Tables` plus, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from marketloom.operators import portfolio, weekly
from marketloom.plans import views
from marketloom.queries import view_sql
from marketloom.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables and the views on them, read lazily for one session and folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def px(self) -> DataFrame:
        return views.price_panel(self)

    def share_px(self) -> "Tables":
        """Checkpoint the price panel, for queries that use it more than once."""
        self.__dict__["px"] = settle(self.px)
        return self

    @cached_property
    def cal(self) -> DataFrame:
        return views.calendar(self.px)

    @cached_property
    def panel(self) -> DataFrame:
        return views.calendar_panel(self.px)

    @cached_property
    def ind(self) -> DataFrame:
        return views.indicators(self.table("lineitem"))

    @cached_property
    def scored(self) -> DataFrame:
        return views.scored_documents(self.table("documents"))

    @cached_property
    def pred(self) -> DataFrame:
        return views.predictions(self.px)

    @cached_property
    def sig(self) -> DataFrame:
        return views.signals(self.px)

    @cached_property
    def nav(self) -> DataFrame:
        return views.nav(self.sig)

    @cached_property
    def ret(self) -> DataFrame:
        return views.returns(self.nav)

    @cached_property
    def weekly_nav(self) -> DataFrame:
        week = weekly.roll_up(self.px.select("market", "date", "close"), ["market"])
        return views.nav(views.signals(week))

    @cached_property
    def pos(self) -> DataFrame:
        return portfolio.costed_positions(self.sig, ["model", "market"])


def query(name: str, oracle: str | None = None, uses: tuple[str, ...] = ()):
    """Register a function ``Tables -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = view_sql.with_views(oracle, uses)
        return fn

    return register
