"""Positions, quantiles and batches over a whole table, without one task holding a whole group.

Rows are range-partitioned by (key, value), so a key with a third of all rows spreads over as many partitions as its
share of the data. The partitioned rows are checkpointed, which fixes their places; the number of rows per partition
and key, a summary of at most one row per partition and key present there, then gives every partition its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import settle


def _placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in global order: partition number and place inside the partition."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    low_bits = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return settle(ranged.select("*", F.spark_partition_id().alias("_part"), low_bits.alias("_place")))


def _before(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a key in the partitions before, and in all of them."""
    w = Window.partitionBy(*keys).orderBy("_part")
    earlier = F.coalesce(F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return totals.withColumn("_before", earlier).withColumn("_total", F.sum("_rows").over(Window.partitionBy(*keys)))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "position") -> DataFrame:
    """1-based position inside each key by ``order``, whose columns identify a row of the key."""
    placed = _placed(df, [*keys, *order])
    totals = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    return (
        placed.join(_before(totals, keys), [*keys, "_part"])
        .withColumn(out, F.col("_before") + F.col("_place") - F.col("_first") + 1)
        .drop("_part", "_place", "_rows", "_first", "_before", "_total"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "q", weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, as an array per key.

    Equal values collapse to one counted row map-side; only the partitions that hold a wanted rank are summed up.
    ``weight`` names the count of a row where values have been counted before, one row per key and value.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull())
    counted = known.select(*keys, value, F.col(weight).alias("_n")) if weight else known.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = _placed(counted, [*keys, value])
    totals = _before(placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_rows")), keys)

    def rank(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(float(p))

    wanted = [F.floor(rank(p)) for p in probs] + [F.ceil(rank(p)) for p in probs]
    hit = F.lit(False)
    for r in wanted:
        hit = hit | ((r >= F.col("_before")) & (r < F.col("_before") + F.col("_rows")))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_place")) + F.col("_before")
    rows = (
        placed.join(totals.filter(hit), [*keys, "_part"])
        .withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_n")))

    def at(r: Column) -> Column:
        return F.max(F.when((r >= F.col("_from")) & (r < F.col("_upto")), F.col(value)))

    found = rows.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        *[at(F.floor(rank(p))).alias(f"_lo{i}") for i, p in enumerate(probs)],
        *[at(F.ceil(rank(p))).alias(f"_hi{i}") for i, p in enumerate(probs)])
    blend = [
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (rank(p) - F.floor(rank(p)))
        for i, p in enumerate(probs)]
    return found.select(*keys, F.array(*blend).alias(out))


def batches(df: DataFrame, order: Sequence[str], size: int, out: str = "batch") -> DataFrame:
    """Number of the fixed-size batch each row falls into, in the global order of a row-identifying column list."""
    placed = _placed(df, order)
    # One row per partition: the running total is over that summary, never over the rows.
    totals = placed.groupBy("_part").agg(F.count("*").alias("_rows")).withColumn("_all", F.lit(0))
    return (
        placed.join(_before(totals, ["_all"]).select("_part", "_before"), "_part")
        .withColumn(out, F.floor((F.col("_before") + F.col("_place")) / size)).drop("_part", "_place", "_before"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key in the given order, as an aggregate.

    ``min_by`` combines map-side, so a key with a third of all rows reaches the shuffle as one row per task; a ranking
    window would send all its copies to one task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows of each key; Spark limits each task to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows from position ``start`` up to before ``stop`` of each key, counted from 0, negative ones from the end.

    A head or tail alone is a top-k with Spark's early limit; other slices number the rows of a key over its partitions.
    """
    if start in (None, 0) and stop is not None and stop >= 0:
        return top_per_key(df, keys, [F.asc(c) for c in order], stop, "_rank").drop("_rank")
    if stop is None and start is not None and start < 0:
        return top_per_key(df, keys, [F.desc(c) for c in order], -start, "_rank").drop("_rank")
    placed = positions(df, keys, order, "_at")
    if (start or 0) < 0 or (stop or 0) < 0:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
        placed = placed.join(sizes, list(keys))
    bound = lambda n: F.lit(n) if n >= 0 else F.greatest(F.col("_size") + n, F.lit(0))
    at = F.col("_at") - 1
    inside = F.lit(True) if start is None else at >= bound(start)
    return placed.filter(inside if stop is None else inside & (at < bound(stop))).select(df.columns)
