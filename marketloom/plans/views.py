"""Views on the driver's tables: price panel, calendar, indicators, scored documents, predictions, values.

Everything that grows with the input is aggregated here, with map-side combine, to one row per key and day.
From then on a series has at most one row per calendar day, so a window over one series is bounded by the
calendar (36,525 rows in a century) however many orders or line items a market holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators import portfolio
from marketloom.session import settle


def _cents(column: str) -> F.Column:
    return F.round(F.col(column) * 100).cast("long")


def price_panel(t) -> DataFrame:
    """Price panel per market (region) and day.

    Sums are additive, so orders are reduced per (customer, day) before the customer lookup: a customer or
    market with a third of all orders reaches the lookup as at most one row per day.
    """
    items = t.table("lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("q"), F.sum(_cents("l_extendedprice")).alias("t"))
    per_customer = (
        t.table("orders")
        .join(items, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.sum(_cents("o_totalprice")).alias("c"), F.count("*").alias("n"), F.sum("q").alias("q"), F.sum("t").alias("t")))
    customers = (
        t.table("customer")
        .join(t.table("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(t.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
        .select("c_custkey", F.col("r_name").alias("market")))
    return (
        per_customer.join(customers, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy("market", "date")
        .agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("t").alias("t"))
        .select(
            "market", "date",
            (F.floor(F.col("c").cast("double") / F.col("n")) / 100000).alias("close"),
            (F.floor(F.col("t").cast("double") / F.col("q")) / 100).alias("vwap"),
            F.col("q").alias("volume"),
            (F.col("t").cast("double") / 100).alias("turnover")))


#: Days of the year on which the fixtures' markets are closed: new year, labour day and three days of a national holiday.
HOLIDAYS = ("01-01", "05-01", "10-01", "10-02", "10-03")


def is_session(date: str = "date") -> Column:
    """Monday to Friday, but for holidays."""
    return (F.weekday(date) < 5) & ~F.date_format(date, "MM-dd").isin(*HOLIDAYS)


def calendar(px: DataFrame) -> DataFrame:
    """Every day between the first and last trade, the sessions open."""
    return (
        px.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
        .select(F.explode(F.sequence("lo", "hi")).alias("date"))
        .withColumn("is_open", is_session()))


def calendar_panel(px: DataFrame) -> DataFrame:
    """Panel with one row per market and calendar day, activity flags and zero-filled activity."""
    px = settle(px)
    low, high = px.agg(F.min("date")).scalar(), px.agg(F.max("date")).scalar()
    grid = (
        px.select("market").distinct().select("market", F.explode(F.sequence(low, high)).alias("date"))
        .withColumn("is_open", is_session()))
    return (
        grid.join(px, ["market", "date"], "left")
        .select(
            "market", "date", "close", "vwap",
            F.coalesce("volume", F.lit(0.0)).alias("volume"),
            F.coalesce("turnover", F.lit(0.0)).alias("turnover"),
            "is_open",
            F.col("volume").isNotNull().alias("has_trade"),
            (F.col("is_open") & F.col("volume").isNull()).alias("is_quiet")))


def indicators(lineitem: DataFrame) -> DataFrame:
    """Monthly, quarterly and daily indicators; one pass over the items, reduced per day and flag first."""
    daily = (
        lineitem.groupBy(F.col("l_shipdate").cast("date").alias("day"), "l_returnflag", "l_linestatus")
        .agg(F.sum(_cents("l_extendedprice")).alias("c"), F.count("*").alias("n")))

    def series(name: F.Column, date: F.Column) -> DataFrame:
        return (
            daily.groupBy(name.alias("indicator"), date.alias("date"))
            .agg((F.floor(F.sum("c").cast("double") / F.sum("n")) / 100).alias("value")))

    return (
        series(F.concat(F.lit("M_"), "l_returnflag"), F.trunc("day", "month"))
        .unionByName(series(F.concat(F.lit("Q_"), "l_linestatus"), F.trunc("day", "quarter")))
        .unionByName(series(F.lit("D_ALL"), F.col("day"))))


def scored_documents(documents: DataFrame) -> DataFrame:
    """Documents with a source, publish date and three scores, all fixed functions of the id."""
    i = F.col("doc_id")
    return documents.select(
        "doc_id", "text", "lang", "n_chars",
        F.when(i % 3 == 0, "national").when(i % 3 == 1, "regional_a").otherwise("regional_b").alias("source"),
        F.date_add(F.lit("1995-01-02").cast("date"), (i * 37 % 2400).cast("int")).alias("publish_date"),
        ((i * 7919 % 301).cast("double") - 150).alias("supply"),
        ((i * 104729 % 301).cast("double") - 150).alias("demand"),
        (i * 1299709 % 151).cast("double").alias("strength"))


def probability() -> F.Column:
    days = F.datediff(F.col("date"), F.lit("1995-01-01").cast("date"))
    return ((days * 31 + F.length("market") * 17) % 1000).cast("double") / 1000


def predictions(px: DataFrame) -> DataFrame:
    """Model probability, 0.5-threshold prediction, actual direction and close, from the second day on."""
    w = Window.partitionBy("market").orderBy("date")
    return (
        px.select("market", "date", "close", F.lag("close").over(w).alias("prev"), probability().alias("prob"))
        .filter(F.col("prev").isNotNull())
        .select(
            "market", "date", "prob",
            F.when(F.col("prob") > 0.5, 1).otherwise(0).alias("pred"),
            F.when(F.col("close") > F.col("prev"), 1).otherwise(0).alias("actual"),
            "close"))


def signals(px: DataFrame) -> DataFrame:
    """Three models per market in long form: always long, close above its 20-row mean, probability above 0.5.

    The test prices are independent draws, on which buying low pays without limit, so the models trade a price damped
    to a hundredth.
    """
    w20 = Window.partitionBy("market").orderBy("date").rowsBetween(-19, 0)
    units = F.sum(F.round(F.col("close") * 100000).cast("long")).over(w20).cast("double") / 100000
    above = (F.count("close").over(w20) == 20) & (units < F.col("close") * 20)
    wide = px.select("market", "date", "close", above.alias("above"), probability().alias("prob"))
    kinds = F.array(
        F.struct(F.lit("Buy&Hold").alias("model"), F.lit(1).alias("signal")),
        F.struct(F.lit("Trend").alias("model"), F.when(F.col("above"), 1).otherwise(0).alias("signal")),
        F.struct(F.lit("Prob").alias("model"), F.when(F.col("prob") > 0.5, 1).otherwise(0).alias("signal")))
    traded = (100 + F.col("close") / 100).alias("close")
    return wide.select(F.explode(kinds).alias("s"), "market", "date", traded).select("s.model", "market", "date", "close", "s.signal")


def nav(sig: DataFrame) -> DataFrame:
    """Frictionless value per model and market, in cents."""
    return (
        portfolio.nav_frictionless(sig, ["model", "market"], capital=1_000_000.0)
        .select("model", "market", "date", F.round("nav", 2).alias("nav")))


def returns(nav_: DataFrame, keys=("model", "market")) -> DataFrame:
    """Row returns of a value series; the first row of a series has none and is dropped."""
    w = Window.partitionBy(*keys).orderBy("date")
    return (
        nav_.withColumn("r", F.col("nav") / F.lag("nav").over(w) - 1)
        .filter(F.col("r").isNotNull()).select(*keys, "date", "nav", "r"))
