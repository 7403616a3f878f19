"""Strategy valuation in closed form: frictionless, with costs, and in whole units.

Signals act one row later. A trip is a stretch of held rows; value inside a trip follows the price ratio to its
entry, and the cash before a trip is the capital times the product of the factors of the trips before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.series import lagged, ordered, reversed_until_now, until_now


def held(acting: Column, w) -> Column:
    """1 after a lagged signal of exactly 1, 0 after 0, the last of the two otherwise, 0 at the start."""
    state = F.when(acting == 1, 1).when(acting == 0, 0)
    return F.coalesce(F.last(state, ignorenulls=True).over(until_now(w)), F.lit(0))


def nav_frictionless(df: DataFrame, keys: Sequence[str], capital: float = 1_000_000.0, signal: str = "signal",
                     price: str = "close") -> DataFrame:
    """Value without costs in fractional units: enters on a lagged signal of 1, leaves on 0."""
    w = ordered(keys)
    step = F.when(F.lag("_held").over(w) == 1, F.ln(F.col(price) / F.lag(price).over(w))).otherwise(0.0)
    return (
        df.withColumn("_acting", lagged(signal, w))
        .withColumn("_held", held(F.col("_acting"), w))
        .withColumn("_step", step)
        .withColumn("nav", capital * F.exp(F.sum("_step").over(until_now(w))))
        .drop("_acting", "_held", "_step"))


def costed_positions(df: DataFrame, keys: Sequence[str], capital: float = 1_000_000.0, cost: float = 0.001,
                     slippage: float = 0.0005, signal: str = "signal", price: str = "close") -> DataFrame:
    """Value, units and trade columns with proportional cost and slippage.

    Any lagged signal above 0 holds a full position, 0 leaves it. Buying with cash K leaves c²·K uninvested, so the
    value at price p is K·(c² + (1−c)/(1+s)·p/p_buy) and a sale yields K·(c² + (1−c)²·(1−s)/(1+s)·p/p_buy).
    """
    c, s = cost, slippage
    w = ordered(keys)
    p = F.col(price)
    rows = (
        df.filter(p.isNotNull() & F.col(signal).isNotNull())
        .withColumn("_in", (lagged(F.col(signal).cast("double"), w, 0.0) > 0).cast("int"))
        .withColumn("_was", lagged("_in", w))
        .withColumn("_buy", (F.col("_in") == 1) & (F.col("_was") == 0))
        .withColumn("_sell", (F.col("_in") == 0) & (F.col("_was") == 1))
        .withColumn("_entry", F.last(F.when(F.col("_buy"), p), ignorenulls=True).over(until_now(w))))
    ratio = p / F.col("_entry")
    done = F.when(F.col("_sell"), F.ln(c * c + (1 - c) ** 2 * (1 - s) / (1 + s) * ratio)).otherwise(0.0)
    rows = rows.withColumn("_done", done).withColumn("_cash", capital * F.exp(F.sum("_done").over(until_now(w))))
    marked = F.when(F.col("_in") == 1, c * c + (1 - c) / (1 + s) * ratio).otherwise(1.0)
    units = F.col("_cash") * (1 - c) / (F.col("_entry") * (1 + s))
    rows = (
        rows.withColumn("nav", F.col("_cash") * marked)
        .withColumn("units", F.when(F.col("_in") == 1, units).otherwise(0.0))
        .withColumn("action", F.when(F.col("_buy"), "buy").when(F.col("_sell"), "sell")))
    traded = F.when(F.col("_buy"), F.col("units")).when(F.col("_sell"), F.lag("units").over(w))
    at = F.when(F.col("_buy"), p * (1 + s)).when(F.col("_sell"), p * (1 - s))
    return (
        rows.withColumn("trade_units", traded).withColumn("trade_price", at)
        .withColumn("trade_cost", F.col("trade_units") * F.col("trade_price") * c)
        .drop("_in", "_was", "_buy", "_sell", "_entry", "_done", "_cash"))


def nav_costed(df: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    out = costed_positions(df, keys, **options)
    return out.drop("units", "action", "trade_units", "trade_price", "trade_cost")


def _cash_of_trips(trips: DataFrame, keys: Sequence[str], capital: float) -> DataFrame:
    """Cash before and after each trip (_trip, _offers, _sell), and the place and price of its entry (none if never affordable).

    A series has at most a trip for two rows, so its trips are one array, folded in order.
    """
    series = trips.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_trip", "_offers", "_sell"))).alias("_trips"))
    none = F.array().cast("array<struct<_trip:bigint,_cash:double,_after:double,_entry:double,_from:bigint>>")

    def step(acc, trip):
        cash = acc["cash"]
        entry = F.get(F.filter(trip["_offers"], lambda offer: offer["p"] <= cash), F.lit(0))
        gained = F.floor(cash / entry["p"]) * (trip["_sell"] - entry["p"])
        after = cash + F.coalesce(gained, F.lit(0.0))
        row = F.struct(trip["_trip"].alias("_trip"), cash.alias("_cash"), after.alias("_after"), entry["p"].alias("_entry"), entry["i"].alias("_from"))
        return F.struct(after.alias("cash"), F.concat(acc["done"], F.array(row)).alias("done"))

    start = F.struct(F.lit(float(capital)).alias("cash"), none.alias("done"))
    return series.select(*keys, F.inline(F.aggregate("_trips", start, step, lambda acc: acc["done"])))


def nav_whole_units(df: DataFrame, keys: Sequence[str], capital: float = 1_000_000.0, signal: str = "signal",
                    price: str = "close") -> DataFrame:
    """Value in whole units: a buy takes the floor of cash over price and keeps the rest as cash.

    Where cash buys no unit, the series stays out and tries again on the next row that asks for a position. The floor
    makes cash depend on the trips before, so the trips of a series, one row each, are folded in order. A trip offers
    the fold only those prices that are lower than all before: the first affordable price is always one of them.
    """
    keys = list(keys)
    w = ordered(keys)
    p = F.col(price)
    opened = (F.col("_in") == 1) & (F.col("_was") == 0)
    rows = (
        df.withColumn("_acting", lagged(signal, w))
        .withColumn("_in", held(F.col("_acting"), w))
        .withColumn("_was", lagged("_in", w))
        .withColumn("_nth", F.row_number().over(w).cast("long"))
        .withColumn("_trip", F.sum(opened.cast("int")).over(until_now(w))))
    asked = F.when((F.col("_in") == 1) & (F.col("_acting") == 1), p)
    earlier = Window.partitionBy(*keys, "_trip").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    lower = asked < F.coalesce(F.min(asked).over(earlier), F.lit(float("inf")))
    offers = F.array_sort(F.collect_list(F.when(F.col("_lower"), F.struct(F.col("_nth").alias("i"), p.cast("double").alias("p")))))
    trips = (
        rows.filter("_trip > 0").withColumn("_lower", lower).groupBy(*keys, "_trip")
        .agg(offers.alias("_offers"), F.max(F.when((F.col("_in") == 0) & (F.col("_was") == 1), p.cast("double"))).alias("_sell")))
    cash = _cash_of_trips(trips, keys, capital)
    inside = (F.col("_in") == 1) & (F.col("_nth") >= F.col("_from"))
    return (
        rows.join(cash, [*keys, "_trip"], "left")
        .withColumn("nav", F.when(inside, F.col("_cash") + F.floor(F.col("_cash") / F.col("_entry")) * (p - F.col("_entry")))
                    .when(F.col("_in") == 1, F.col("_cash")).otherwise(F.coalesce("_after", F.lit(float(capital)))))
        .drop("_acting", "_in", "_was", "_nth", "_trip", "_cash", "_after", "_entry", "_from"))


def trade_log(positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``costed_positions`` on which a trade happened."""
    return positions.filter(F.col("action").isNotNull()).select(
        *keys, "date", "action", F.col("trade_units").alias("units"), F.col("trade_price").alias("price"),
        F.col("trade_cost").alias("cost"))


def trade_totals(positions: DataFrame, keys: Sequence[str], capital: float = 1_000_000.0) -> DataFrame:
    """Trades, total cost, cost over capital, turnover and final value per key, in one pass over the positions."""
    moved = F.abs(F.col("units") - F.lag("units").over(ordered(keys)))
    return (
        positions.withColumn("_moved", moved).groupBy(*keys)
        .agg(F.count("action").alias("total_trades"),
             F.coalesce(F.sum("trade_cost"), F.lit(0.0)).alias("total_costs"),
             F.coalesce(F.try_divide(F.sum("_moved"), 2 * F.avg("units")), F.lit(0.0)).alias("turnover"),
             F.max_by("nav", "date").alias("final_nav"))
        .withColumn("cost_impact", F.col("total_costs") / capital))


def next_sale(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each buy the first later sale and the days held (null without one)."""
    sale = F.last(F.when(F.col("action") == "sell", F.col("date")), ignorenulls=True).over(reversed_until_now(keys))
    return (
        trades.withColumn("sell_date", sale).filter(F.col("action") == "buy")
        .withColumn("holding_days", F.datediff("sell_date", "date")))


def round_trips(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Buys directly followed by a sale, with the relative profit."""
    w = ordered(keys)
    return (
        trades.withColumn("next_action", F.lead("action").over(w)).withColumn("sell_price", F.lead("price").over(w))
        .filter((F.col("action") == "buy") & (F.col("next_action") == "sell"))
        .withColumn("profit", (F.col("sell_price") - F.col("price")) / F.col("price")))


def trade_analysis(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, mean size, commission, mean prices and mean holding days per key."""
    buy, sell = F.col("action") == "buy", F.col("action") == "sell"
    sale = F.last(F.when(sell, F.col("date")), ignorenulls=True).over(reversed_until_now(keys))
    days = F.when(buy, F.datediff(sale, F.col("date")))
    return trades.withColumn("_days", days).groupBy(*keys).agg(
        F.count("*").alias("num_trades"), F.count_if(buy).alias("num_buys"), F.count_if(sell).alias("num_sells"),
        F.avg("units").alias("avg_trade_size"), F.sum("cost").alias("total_commission"),
        F.coalesce(F.avg(F.when(buy, F.col("price"))), F.lit(0.0)).alias("avg_buy_price"),
        F.coalesce(F.avg(F.when(sell, F.col("price"))), F.lit(0.0)).alias("avg_sell_price"),
        F.avg("_days").alias("avg_holding_days"))


def win_rate(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Win share, profit factor (loss sum 1 when there is none) and mean win and loss over round trips.

    A key that never completed a trip keeps a row of zeros.
    """
    w = ordered(keys)
    paired = (F.col("action") == "buy") & (F.lead("action").over(w) == "sell")
    profit = F.when(paired, (F.lead("price").over(w) - F.col("price")) / F.col("price"))
    won, lost = F.col("_p") > 0, F.col("_p") < 0
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        trades.withColumn("_p", profit).groupBy(*keys)
        .agg(F.count_if(won).alias("num_wins"), F.count_if(lost).alias("num_losses"), F.count("_p").alias("_n"),
             zero(F.sum(F.when(won, F.col("_p")))).alias("_w"), F.sum(F.when(lost, F.col("_p"))).alias("_l"),
             zero(F.avg(F.when(won, F.col("_p")))).alias("avg_win"),
             zero(F.avg(F.when(lost, F.col("_p")))).alias("avg_loss"))
        .withColumn("win_rate", zero(F.try_divide(F.col("num_wins"), F.col("_n"))))
        .withColumn("profit_factor", F.col("_w") / F.coalesce(F.abs("_l"), F.lit(1.0)))
        .drop("_n", "_w", "_l"))
