"""Distributions of scores and features: summaries, histograms, outliers, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.cleaning import unpivot
from marketloom.operators.ordering import exact_quantiles
from marketloom.session import settle


def counted(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, value, n): how often each value stands under a key, nulls included.

    All statistics below derive from this table. It combines map-side, is written once, and has a row per distinct value,
    so the rows themselves are read once whatever is asked of them.
    """
    return settle(long.groupBy(*keys, value).agg(F.count("*").alias("n")))


def _moments(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Number, mean, sample deviation, least and greatest value per key."""
    v, n = F.col(value).cast("double"), F.when(F.col(value).isNotNull(), F.col("n")).otherwise(0)
    sums = counts.groupBy(*keys).agg(
        F.sum(n).alias("n"), (F.sum(v * n) / F.nullif(F.sum(n), F.lit(0))).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    # Squares around the mean, from the counted values, as sums of squares would lose what they have in common.
    around = _joined(counts, sums.select(*keys, F.col("mean").alias("_mean")), keys).groupBy(*keys).agg(F.sum(n * F.pow(v - F.col("_mean"), F.lit(2.0))).alias("_ss"))
    std = F.when(F.col("n") > 1, F.sqrt(F.col("_ss") / (F.col("n") - 1)))
    return _joined(sums, around, keys).withColumn("std", std).drop("_ss")


def _joined(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join by keys; without any, every row meets the single row of the other side."""
    if keys:
        return a.join(b, list(keys))
    row = b.select(F.struct(*b.columns).alias("_r")).scalar()
    return a.withColumn("_r", row).select(*a.columns, *[F.col(f"_r.{c}").alias(c) for c in b.columns])


def summary(long: DataFrame, keys: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    """Mean, sample deviation, least, greatest and median per key of a long table."""
    counts = counted(long, keys, value)
    middle = exact_quantiles(counts, keys, value, [0.5], weight="n")
    return _joined(_moments(counts, keys, value), middle, keys).withColumn("median", F.col("q")[0]).drop("q")


def five_numbers(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, sample deviation, least, quartiles, greatest and the 1.5·IQR limits per key."""
    return _five_numbers(counted(long, keys, value), keys, value)


def _five_numbers(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    q = exact_quantiles(counts, keys, value, [0.25, 0.5, 0.75], weight="n")
    iqr = F.col("q75") - F.col("q25")
    return (
        _joined(_moments(counts, keys, value).drop("n"), q, keys)
        .withColumns({f"q{p}": F.col("q")[i] for i, p in enumerate((25, 50, 75))}).drop("q")
        .withColumn("low", F.col("q25") - 1.5 * iqr).withColumn("high", F.col("q75") + 1.5 * iqr))


def outliers(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Count, share, range and mean of the values outside the 1.5·IQR limits per key."""
    counts = counted(long, keys, value)
    limits = _five_numbers(counts, keys, value).select(*keys, "low", "high")
    out = F.coalesce((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")), F.lit(False))
    picked, times = F.when(out, F.col(value)), F.when(out, F.col("n")).otherwise(0)
    return _joined(counts, limits, keys).groupBy(*keys).agg(
        F.sum(times).alias("n_outliers"), (100 * F.sum(times) / F.sum("n")).alias("outlier_pct"),
        F.min(picked).alias("least"), F.max(picked).alias("greatest"), F.try_divide(F.sum(picked * F.col("n")), F.sum(times)).alias("mean_outlier"))


def histogram(long: DataFrame, keys: Sequence[str], bins: int, closed: str = "left", value: str = "value") -> DataFrame:
    """Counts in equal bins between least and greatest value of each key, with the bin edges.

    ``closed='right'`` puts an edge value into the lower bin (the least value into the first), ``'left'`` into the
    upper one (the greatest into the last).
    """
    return _histogram(counted(long, keys, value), keys, bins, closed, value)


def _histogram(counts: DataFrame, keys: Sequence[str], bins: int, closed: str, value: str) -> DataFrame:
    span = counts.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.coalesce(F.try_divide(F.col(value) - F.col("lo"), width), F.lit(0.0))
    if closed == "right":
        bin_ = F.least(F.greatest(F.ceil(place), F.lit(1)), F.lit(bins))
    else:
        bin_ = F.least(F.floor(place), F.lit(bins - 1)) + 1
    binned = _joined(counts, span, keys).groupBy(*keys, bin_.alias("bin")).agg(
        F.sum("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return binned.select(
        *keys, "bin", "n", (F.col("lo") + (F.col("bin") - 1) * width).alias("from"), (F.col("lo") + F.col("bin") * width).alias("to"))


def distribution(long: DataFrame, keys: Sequence[str], bins: int, closed: str = "left", value: str = "value") -> DataFrame:
    """Histogram and five-number summary of each key in one table."""
    counts = counted(long, keys, value)
    return _joined(_histogram(counts, keys, bins, closed, value).select(*keys, "bin", F.col("n").alias("count")), _five_numbers(counts, keys, value), keys)


def correlations(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every ordered pair of columns, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.groupBy(*keys).agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    entries = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            entries.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"_{i}").alias("corr")))
    return wide.select(*keys, F.inline(F.array(*entries)))


def beta_parts(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.covar_samp(a, b).alias("covariance"), F.var_samp(b).alias("variance"),
        F.try_divide(F.covar_samp(a, b), F.var_samp(b)).alias("beta"))


def grid_counts(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(x) / width).alias("cell_x"), F.floor(F.col(y) / width).alias("cell_y")).agg(F.count("*").alias("n"))


def average_rank(keys: Sequence[str], value, ascending: bool = True) -> Column:
    """Rank with the mean of tied positions."""
    v = F.col(value) if isinstance(value, str) else value
    order = Window.partitionBy(*keys).orderBy(v.asc() if ascending else v.desc())
    return F.rank().over(order) + (F.count("*").over(Window.partitionBy(*keys, v)) - 1) / 2


__all__ = [
    "average_rank", "beta_parts", "correlations", "counted", "distribution", "five_numbers", "grid_counts", "histogram", "outliers", "summary", "unpivot"]
