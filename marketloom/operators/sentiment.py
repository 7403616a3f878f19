"""Document scores to daily market sentiment: labels, weighting, decay, pressure, momentum, merge with prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.scan import decayed_sum
from marketloom.operators.series import ordered, trailing

# Score limits and the labels of each band, closed on the upper side.
LIMITS = {"supply": (-150, 150), "demand": (-150, 150), "strength": (0, 150)}
SUPPLY_BANDS = ((-110, "Extreme supply restriction"), (-75, "Strong supply restriction"), (-25, "Supply reduction"),
                (25, "Neutral supply impact"), (75, "Supply increase"), (110, "Strong supply expansion"))
SUPPLY_LAST = "Extreme supply expansion"
DEMAND_BANDS = ((-110, "Extreme demand restriction"), (-75, "Strong demand restriction"), (-25, "Demand reduction"),
                (25, "Neutral demand impact"), (75, "Demand increase"), (110, "Strong demand expansion"))
DEMAND_LAST = "Extreme demand expansion"
STRENGTH_BANDS = ((25, "Informational policy"), (50, "Encouraged/voluntary policy"), (75, "Binding guidance"))
STRENGTH_LAST = "Mandatory enforcement"
HALF_LIFE_DAYS = 7


def valid_scores(limits: dict[str, tuple[float, float]] = LIMITS) -> Column:
    """All scores present, numeric and inside their limits."""
    out = F.lit(True)
    for name, (low, high) in limits.items():
        out = out & F.coalesce(F.expr(f"try_cast({name} AS DOUBLE)").between(low, high), F.lit(False))
    return out


def price_effect(supply, demand) -> Column:
    """Label of demand − supply; a net of exactly 25 falls through to the last branch."""
    net = F.col(demand) - F.col(supply)
    return (
        F.when(F.abs(net) < 25, "neutral price impact").when(net > 75, "strong upward price pressure")
        .when(net > 25, "moderate upward price pressure").when(net < -75, "strong downward price pressure")
        .otherwise("moderate downward price pressure"))


def enforcement_phrase(strength) -> Column:
    s = F.col(strength)
    return (
        F.when(s > 75, "with mandatory enforcement").when(s > 50, "with binding guidance")
        .when(s > 25, "with voluntary measures").otherwise("as informational guidance"))


def market_rows(df: DataFrame, sources: dict[str, Sequence[str]], source: str = "source") -> DataFrame:
    """One row per document and market that listens to its source; other sources go.

    The whitelist is a literal, so no lookup table is joined.
    """
    listening: dict[str, list[str]] = {}
    for market, names in sources.items():
        for name in names:
            listening.setdefault(name, []).append(market)
    entries = [x for n, ms in listening.items() for x in (F.lit(n), F.array(*[F.lit(m) for m in ms]))]
    return df.withColumn("market", F.explode(F.try_element_at(F.create_map(*entries), F.col(source))))


def daily_weighted(df: DataFrame, keys: Sequence[str] = ("market", "effective_date")) -> DataFrame:
    """Supply and demand weighted by strength + 1, strongest and mean strength, and documents per day.

    Plain sums, so a day or market with very many documents is combined map-side.
    """
    w = F.col("strength") + 1
    return df.groupBy(*keys).agg(
        (F.sum(F.col("supply") * w) / F.sum(w)).alias("sentiment_supply"),
        (F.sum(F.col("demand") * w) / F.sum(w)).alias("sentiment_demand"),
        F.max("strength").alias("max_policy"), F.avg("strength").alias("avg_policy"), F.count("*").alias("doc_count"))


DECAYED = {"supply": "supply_decayed", "demand": "demand_decayed", "strength": "policy_decayed"}


def decayed_influence(df: DataFrame, keys: Sequence[str] = ("market",), half_life: float = HALF_LIFE_DAYS,
                      dates: DataFrame | None = None) -> DataFrame:
    """Decayed sums of all documents up to and including each date.

    Documents are summed per date first. Without ``dates`` the dates are those that have documents; with it, each
    wanted (key, date) gets a row, as a zero added to the same scan.
    """
    daily = df.groupBy(*keys, "effective_date").agg(*[F.sum(c).alias(c) for c in DECAYED])
    if dates is not None:
        wanted = dates.select(*keys, "effective_date").withColumn("_wanted", F.lit(1))
        daily = (
            daily.withColumn("_wanted", F.lit(0)).unionByName(wanted, allowMissingColumns=True)
            .groupBy(*keys, "effective_date")
            .agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in DECAYED], F.max("_wanted").alias("wanted")))
    out = decayed_sum(
        daily, keys, F.unix_date("effective_date"), {o: F.col(c) for c, o in DECAYED.items()}, 0.5 ** (1 / half_life))
    if dates is not None:
        out = out.filter("wanted = 1")
    return out.select(*keys, "effective_date", *DECAYED.values())


def pressure(df: DataFrame) -> DataFrame:
    d, s, p = F.col("sentiment_demand"), F.col("sentiment_supply"), F.col("max_policy") / 100
    return df.withColumn("market_pressure", (d - s) * p).withColumn("pressure_magnitude", (F.abs(d) + F.abs(s)) * p)


def momentum(df: DataFrame, keys: Sequence[str] = ("market",), date: str = "effective_date") -> DataFrame:
    """News shock over 7 document days and change of the 3-day means; rows are days with documents."""
    w = ordered(keys, date)
    out = df.withColumn("news_shock", F.col("doc_count") / (F.avg("doc_count").over(trailing(w, 7)) + 0.1))
    for source, name in (("market_pressure", "pressure_momentum"), ("sentiment_supply", "supply_momentum"),
                         ("sentiment_demand", "demand_momentum")):
        out = out.withColumn("_m", F.avg(source).over(trailing(w, 3))).withColumn(name, F.col("_m") - F.lag("_m").over(w))
    return out.drop("_m")


def daily_sentiment(df: DataFrame, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """All daily features per market from documents with a market and an effective date."""
    daily = daily_weighted(df).join(decayed_influence(df, half_life=half_life), ["market", "effective_date"])
    return momentum(pressure(daily))


def merge_same_day(prices: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Prices with the features of the same date, zero elsewhere; features dated on closed days match no row."""
    f = features.select("market", F.col("effective_date").alias("date"), *columns)
    return prices.join(f, ["market", "date"], "left").fillna(0, subset=list(columns))


def merge_as_of(prices: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Prices with the last features at or before each date, null before the first."""
    right = features.select("market", F.col("effective_date").alias("date"), F.struct(*columns).alias("_f"), F.lit(0).alias("_side"))
    left = prices.withColumn("_side", F.lit(1))
    w = Window.partitionBy("market").orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True)
    known = both.withColumn("_f", F.last("_f", ignorenulls=True).over(w)).filter("_side = 1")
    return known.select(*prices.columns, "_f.*")
