"""Alignment of tables by key, date or position, and comparison with a base row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(rows: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values for every row; a row without a value stops the job with its key.

    One left join does both: the check is an expression on the joined row, not a second pass.
    """
    found = values.withColumn("_found", F.lit(True))
    key = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    checked = rows.join(found, list(keys), "left").withColumn(
        "_ok", F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no value for "), key)).cast("boolean")).otherwise(True))
    return checked.filter("_ok").drop("_ok", "_found")


def _align(values: DataFrame, dates: DataFrame, keys: Sequence[str], columns: Sequence[str], descending: bool) -> DataFrame:
    order = F.col("date").desc() if descending else F.col("date").asc()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    left = values.withColumn("_nth", nth).select(*keys, "_nth", *columns)
    right = dates.withColumn("_nth", nth).select(*keys, "_nth", "date")
    return right.join(left, [*keys, "_nth"]).drop("_nth")


def align_tail(values: DataFrame, dates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Values put on the last dates of each key by position. Prefer a join by date; this keeps results stored without."""
    return _align(values, dates, keys, columns, True)


def align_head(values: DataFrame, dates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Values put on the first dates of each key by position, cut to the shorter side."""
    return _align(values, dates, keys, columns, False)


def gain_over_base(metrics: DataFrame, keys: Sequence[str], base: str, variant: str = "variant", score: str = "f1") -> DataFrame:
    """Gain in percent of each variant over the base of the same key, labelled baseline, gain or N/A."""
    b = F.max(F.when(F.col(variant) == base, F.col(score))).over(Window.partitionBy(*keys))
    is_base = F.col(variant) == base
    return (
        metrics.withColumn("_b", b)
        .withColumn("label", F.when(is_base, "baseline").when(F.col("_b") > 0, "gain").otherwise("N/A"))
        .withColumn("gain_pct", F.when(~is_base, F.try_divide(F.col(score) - F.col("_b"), F.col("_b")) * 100)).drop("_b"))
