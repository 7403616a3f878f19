"""Scans along a series in blocks, so that one long series spreads over tasks.

A scan carries a state from row to row. Positions fall into blocks of up to 512; within a block a window gives the state from
the block's own rows, partitioned by (key, block). Each block is reduced to one total by an aggregate that combines map-side;
the totals, a 512th of the rows, are scanned the same way, and what they carry into a block joins back by (key, block). No
step partitions rows by the key alone; the last level does so for totals of 512³ positions each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType

from marketloom.session import settle

LONGEST = 512
#: Exponents of e: a rescaled sum stays below the first, weights below the second are beneath double precision.
ROOM, WEIGHTLESS = 460, 42
LEVELS = 3


def whole_position(df: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, Column]:
    """(rows, integer position): days of a date, an integer as it is, and for other types the row's place in its key."""
    kind = df.schema[order].dataType
    if isinstance(kind, DateType):
        return df, F.unix_date(order)
    if isinstance(kind, IntegralType):
        return df, F.col(order)
    from marketloom.operators.ordering import positions

    return positions(df, list(keys), [order], "_at"), F.col("_at")


def _joined(rows: DataFrame, carried: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on columns that may be null."""
    named = carried.withColumnsRenamed({c: f"_j{i}" for i, c in enumerate(on)})
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(named[f"_j{i}"]) for i, c in enumerate(on)])
    return rows.join(named, same, "left").drop(*[f"_j{i}" for i in range(len(on))])


def steps_of(decay: float) -> int:
    """Positions of a block: as many as a rescaled sum can take."""
    return LONGEST if decay == 1 else max(1, min(LONGEST, int(ROOM / -math.log(decay))))


def _decayed_before(totals: DataFrame, keys: list[str], names: list[str], decay: float, levels: int) -> DataFrame:
    """(keys, _b, names): per block the decayed sum of the totals of all blocks before it."""
    rate = math.inf if decay == 0 else -math.log(decay)
    reach = None if rate == 0 else math.ceil(WEIGHTLESS / rate)
    if reach is not None and reach <= 8:
        # Only a few blocks back still weigh: each total is handed on to the blocks it reaches.
        later = F.array(*[
            F.struct((F.col("_b") + j).alias("_b"), *[(F.col(n) * decay ** j).alias(n) for n in names]) for j in range(1, reach + 1)])
        return totals.select(*keys, F.inline(later)).groupBy(*keys, "_b").agg(*[F.sum(n).alias(n) for n in names])
    if levels == 0:
        earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        past = [F.aggregate(
            F.collect_list(F.struct(F.col("_b").alias("b"), F.col(n).alias("s"))).over(earlier), F.lit(0.0),
            lambda acc, x: acc + x["s"] * F.pow(F.lit(decay), (F.col("_b") - x["b"]).cast("double"))).alias(n) for n in names]
        return totals.select(*keys, "_b", *past)
    size = steps_of(decay)
    rows = settle(totals.withColumnRenamed("_b", "_q").withColumn("_b", F.floor(F.col("_q") / size)))
    step = (F.col("_q") - F.col("_b") * size).cast("double")
    scale = F.pow(F.lit(decay), -step)
    above = rows.groupBy(*keys, "_b").agg(*[F.sum(F.col(n) * scale).alias(n) for n in names])
    carried = _decayed_before(above, keys, names, decay ** size, levels - 1).withColumnsRenamed({n: f"_c_{n}" for n in names})
    inside = Window.partitionBy(*keys, "_b").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"_s_{n}": F.coalesce(F.sum(F.col(n) * scale).over(inside), F.lit(0.0)) for n in names})
    both = _joined(own, carried, [*keys, "_b"])
    return both.select(*keys, F.col("_q").alias("_b"), *[
        ((F.col(f"_s_{n}") + F.coalesce(f"_c_{n}", F.lit(0.0))) * F.pow(F.lit(decay), step)).alias(n) for n in names])


def decayed_sum(df: DataFrame, keys: Sequence[str], position: Column, values: dict[str, Column], decay: float) -> DataFrame:
    """Add, per output name, ``y(t) = decay^(t - t') · y(t') + x(t)`` along each key, for any decay from 0 to 1.

    ``position`` is an integer step (row number or day number), unique within a key. Null values count as 0.
    """
    if not 0 <= decay <= 1:
        raise ValueError(f"decay must lie between 0 and 1: {decay}")
    keys, names = list(keys), list(values)
    if decay == 0:
        return df.withColumns({n: F.coalesce(v.cast("double"), F.lit(0.0)) for n, v in values.items()})
    size = steps_of(decay)
    placed = df.withColumns({"_p": position.cast("long"), **{f"_x_{n}": F.coalesce(v.cast("double"), F.lit(0.0)) for n, v in values.items()}})
    placed = settle(placed.withColumn("_b", F.floor(F.col("_p") / size)))
    step = (F.col("_p") - F.col("_b") * size).cast("double")
    scale = F.pow(F.lit(decay), -step)
    totals = placed.groupBy(*keys, "_b").agg(*[F.sum(F.col(f"_x_{n}") * scale).alias(n) for n in names])
    carried = _decayed_before(totals, keys, names, decay ** size, LEVELS - 1).withColumnsRenamed({n: f"_c_{n}" for n in names})
    running = Window.partitionBy(*keys, "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({f"_s_{n}": F.sum(F.col(f"_x_{n}") * scale).over(running) for n in names})
    both = _joined(own, carried, [*keys, "_b"])
    kept = [c for c in df.columns if c not in names]
    return both.select(*kept, *[
        ((F.col(f"_s_{n}") + F.coalesce(f"_c_{n}", F.lit(0.0))) * F.pow(F.lit(decay), step)).alias(n) for n in names])


def running_sum(df: DataFrame, keys: Sequence[str], position: Column, values: dict[str, Column]) -> DataFrame:
    """Add the sums of all values up to and including each row; null values count as 0."""
    return decayed_sum(df, keys, position, values, 1.0)


def _last_before(totals: DataFrame, keys: list[str], names: list[str], levels: int) -> DataFrame:
    """(keys, _b, names): per block the last non-null total of the blocks before it."""
    if levels == 0:
        earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*keys, "_b", *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in names])
    rows = settle(totals.withColumnRenamed("_b", "_q").withColumn("_b", F.floor(F.col("_q") / LONGEST)))
    above = rows.groupBy(*keys, "_b").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_q"))).alias(n) for n in names])
    carried = _last_before(above, keys, names, levels - 1).withColumnsRenamed({n: f"_c_{n}" for n in names})
    inside = Window.partitionBy(*keys, "_b").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({n: F.last(n, ignorenulls=True).over(inside) for n in names})
    both = _joined(own, carried, [*keys, "_b"])
    return both.select(*keys, F.col("_q").alias("_b"), *[F.coalesce(n, f"_c_{n}").alias(n) for n in names])


def filled_forward(df: DataFrame, keys: Sequence[str], position: Column, columns: Sequence[str]) -> DataFrame:
    """Columns with nulls replaced by the last value before them along each key; leading nulls stay."""
    keys, names = list(keys), list(columns)
    placed = settle(df.withColumn("_p", position.cast("long")).withColumn("_b", F.floor(F.col("_p") / LONGEST)))
    totals = placed.groupBy(*keys, "_b").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_p"))).alias(n) for n in names])
    carried = _last_before(totals, keys, names, LEVELS - 1).withColumnsRenamed({n: f"_c_{n}" for n in names})
    running = Window.partitionBy(*keys, "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({n: F.last(n, ignorenulls=True).over(running) for n in names})
    return _joined(own, carried, [*keys, "_b"]).select(*[F.coalesce(c, f"_c_{c}").alias(c) if c in names else c for c in df.columns])
