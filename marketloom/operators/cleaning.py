"""Row and column cleaning: coercion, calendar flags, fills, selection by schema, audits."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def coerce(df: DataFrame, numbers: Sequence[str] = (), dates: dict[str, str] | None = None) -> DataFrame:
    """Numbers with bad text become null; dates must follow their format and fail otherwise."""
    cols = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in numbers}
    cols |= {c: F.to_date(c, f) for c, f in (dates or {}).items()}
    return df.withColumns(cols)


def between_dates(df: DataFrame, low: str, high: str, date: str = "date") -> DataFrame:
    """Closed date range; literal dates reach the Parquet scan as pushed filters."""
    return df.filter(F.col(date).between(F.lit(low).cast("date"), F.lit(high).cast("date")))


def activity_flags(df: DataFrame, sessions: DataFrame, volume: str = "volume") -> DataFrame:
    """Open (date is a session), traded (volume known) and quiet (open without volume) flags.

    The session list is one row per trading day, so the lookup side is bounded by the calendar.
    """
    marked = sessions.select("date").distinct().withColumn("_session", F.lit(True))
    return (
        df.join(marked, "date", "left")
        .withColumn("is_open", F.col("_session").isNotNull())
        .withColumn("has_trade", F.col(volume).isNotNull())
        .withColumn("is_quiet", F.col("is_open") & F.col(volume).isNull())
        .drop("_session"))


def split_by(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """Rows where the flag holds, and the others."""
    return df.filter(F.col(flag)), df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0.0, subset=list(columns))


def columns_except(df: DataFrame, excluded: Iterable[str]) -> list[str]:
    excluded = set(excluded)
    return [c for c in df.columns if c not in excluded]


def columns_ending(df: DataFrame, suffix: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffix)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def bands(value: Column, edges: Sequence[tuple[float, str]], last: str, closed: bool = True) -> Column:
    """First label whose edge is not below the value (``closed``), or above it; ``last`` past every edge."""
    out = None
    for edge, label in edges:
        hit = value <= edge if closed else value < edge
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(last)


def null_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, nulls, zeros and null percentage per column, from one aggregate."""
    def is_zero(c: str) -> Column:
        return F.count_if(F.col(c) == 0) if isinstance(df.schema[c].dataType, T.NumericType) else F.lit(0).cast("long")

    one = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)],
        *[is_zero(c).alias(f"_z{i}") for i, c in enumerate(columns)])
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("nulls"), F.col(f"_z{i}").alias("zeros"))
        for i, c in enumerate(columns)])
    return one.select(F.col("_rows").alias("n_rows"), F.inline(entries)).withColumn(
        "null_pct", 100 * F.try_divide("nulls", "n_rows"))


def calendar_audit(df: DataFrame, keys: Sequence[str], date: str = "date", rows: Column | None = None) -> DataFrame:
    """Date range, expected days, missing and duplicate dates per key.

    Rows are first counted per (key, date), so duplicates of one date never meet in one distinct set. ``rows`` is the
    count to sum where the input is already partly counted.
    """
    per_day = df.groupBy(*keys, date).agg((F.count("*") if rows is None else F.sum(rows)).alias("_n"))
    return per_day.groupBy(*keys).agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        (F.datediff(F.max(date), F.min(date)) + 1).cast("long").alias("expected_days"),
        (F.datediff(F.max(date), F.min(date)) + 1 - F.count("*")).cast("long").alias("missing_days"),
        (F.sum("_n") - F.count("*")).alias("duplicate_dates"))


def share_where(df: DataFrame, keys: Sequence[str], **conditions: Column) -> DataFrame:
    """Percentage of rows meeting each condition, per key."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        *[(100 * F.avg(F.when(c, 1.0).otherwise(0.0))).alias(n) for n, c in conditions.items()])


def value_counts(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count and share of each value, overall or per key; the total is its own small aggregate."""
    counted = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    total = df.groupBy(*keys).agg(F.count("*").alias("_total"))
    if keys:
        return counted.join(total, list(keys)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")
    return counted.withColumn("share", F.col("n") / total.scalar())


def null_counts_by_year(df: DataFrame, columns: Sequence[str], keys: Sequence[str], date: str = "date") -> DataFrame:
    return df.groupBy(*keys, F.year(date).cast("long").alias("year")).agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long without a join."""
    return df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
