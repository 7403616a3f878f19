"""Sinks: panels, summary tables, metrics, predictions and the results registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_panel(df: DataFrame, path: str, by: Sequence[str] = ("market",), mode: str = "overwrite") -> None:
    """Parquet with one folder per key; rows of a key are spread over date ranges before the write.

    Range partitioning on (key, date) keeps files sorted for pruning and splits a key with many rows over tasks.
    """
    order = [*by, *[c for c in ("date",) if c in df.columns and c not in by]]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy(*by).parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for report tables of a row per model.

    Only the finished rows move to the one writing task; the work before keeps its partitions.
    """
    df.repartition(1).write.mode("overwrite").option("header", "true").csv(path)


def write_metrics(df: DataFrame, keys: Sequence[str], path: str) -> None:
    """One JSON object per row, null and infinite metrics included as text-safe values."""
    values = [c for c in df.columns if c not in keys]
    metrics = F.struct(*[F.col(c) for c in values])
    df.select(F.to_json(F.struct(*keys, metrics.alias("metrics")), {"ignoreNullFields": "false"}).alias("value")).write.mode(
        "overwrite").text(path)


PREDICTION_KEYS = ("model", "market", "frequency", "walk", "date")


def write_predictions(df: DataFrame, path: str) -> None:
    """Prediction store keyed by date, so probability, prediction and label need no join by position."""
    df.select(*PREDICTION_KEYS, "prob", "pred", "actual").write.mode("overwrite").partitionBy("model", "frequency").parquet(path)


def latest_results(registry: DataFrame, keys: Sequence[str], stamp: str = "ts") -> DataFrame:
    """Current row per key of an append-only registry, as an aggregate over (stamp, row)."""
    rest = [c for c in registry.columns if c not in keys]
    newest = registry.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(stamp), F.to_json(F.struct(*rest)))).alias("_row"))
    return newest.select(*keys, "_row.*").select(*registry.columns)


def metric(name: str, columns: Sequence[str], plain: str | None = None) -> Column:
    """Test value of a metric, else the plain one (under its own name if that differs), else 0."""
    present = [F.col(c) for c in (f"test_{name}", plain or name) if c in columns]
    return F.coalesce(*present, F.lit(0.0))
