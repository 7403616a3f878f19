"""Exponentially weighted means and the strength index on the block scan of :mod:`marketloom.operators.scan`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.scan import decayed_sum, running_sum, whole_position


def ewm_mean(df: DataFrame, keys: Sequence[str], columns: dict[str, str], alpha: float, min_rows: int = 1,
             date: str = "date") -> DataFrame:
    """Recursive exponentially weighted mean, seeded with the first value of each series.

    ``columns`` maps output to input names; the inputs are null on the same leading rows (the first difference, say)
    and these rows stay null. Interior gaps are to be filled beforehand.
    """
    probe = next(iter(columns.values()))
    placed, position = whole_position(df, keys, date)
    seen = running_sum(placed, keys, position, {"_nth": F.col(probe).isNotNull().cast("int")}).withColumn("_nth", F.col("_nth").cast("long"))
    inputs = {
        out: F.coalesce(F.when(F.col("_nth") == 1, F.col(c)).otherwise(F.col(c) * alpha), F.lit(0.0))
        for out, c in columns.items()}
    # Rows before the first value share a place; they add nothing.
    scanned = decayed_sum(seen, keys, F.col("_nth") - 1, inputs, 1 - alpha)
    ready = (F.col("_nth") >= min_rows) & F.col(probe).isNotNull()
    return scanned.withColumns({out: F.when(ready, F.col(out)) for out in columns}).drop("_nth", "_at")


def relative_strength(gain, loss, zero_loss: str = "null") -> Column:
    """100 − 100 / (1 + gain / loss). A zero loss gives null, or with ``zero_loss='full'`` 100 when there was a gain."""
    gain, loss = F.col(gain), F.col(loss)
    plain = 100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0)))
    return plain if zero_loss == "null" else F.when((loss == 0) & (gain > 0), 100.0).otherwise(plain)
