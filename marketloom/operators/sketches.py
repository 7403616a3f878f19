"""Quantile sketches that add up: counts of values by geometric buckets, per key and batch.

Bucket i holds the magnitudes above γ^(i - 1) up to γ^i with γ = (1 + a) / (1 - a); its value stands for them with a relative error of at
most a. Ranks are exact up to the bucket: the sketch's quantile lies within a of the row of that rank. Counts are whole
numbers, so merged sketches of batches equal the sketch of all rows to the last row, in any order and grouping. A key has at
most ln(largest / smallest magnitude) / ln γ rows, whatever its number of values.

Beside :func:`ordering.exact_quantiles`, which reads all values, this reads sketches alone: a day's batch is sketched once and
stored, and any span of days is a sum of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ACCURACY = 0.005
#: Magnitudes below count as zero.
LEAST = 1e-9


def _log_gamma(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError(f"accuracy must lie between 0 and 1: {accuracy}")
    return math.log((1 + accuracy) / (1 - accuracy))


def bucket_of(value: Column, accuracy: float = ACCURACY) -> tuple[Column, Column]:
    """(sign, bucket) of a value."""
    size = F.abs(value)
    some = size >= LEAST
    sign = F.when(~some, 0).when(value > 0, 1).otherwise(-1)
    return sign, F.when(some, F.ceil(F.ln(size) / _log_gamma(accuracy))).otherwise(F.lit(0)).cast("int")


def sketch(long: DataFrame, keys: Sequence[str], value: str = "value", accuracy: float = ACCURACY) -> DataFrame:
    """(keys, sign, bucket, n, least, greatest): sketch of the values per key; nulls and not-a-numbers do not count."""
    known = long.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sign, bucket = bucket_of(F.col(value).cast("double"), accuracy)
    v = F.col(value).cast("double")
    return known.groupBy(*keys, sign.alias("sign"), bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"))


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of several batches as one."""
    return parts.groupBy(*keys, "sign", "bucket").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def store(part: DataFrame, path: str, batch: int) -> None:
    """Write a batch's sketch; the same batch again replaces it."""
    part.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stored(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    return merged(spark.read.parquet(path), keys)


def quantiles(sketched: DataFrame, keys: Sequence[str], probs: Sequence[float], accuracy: float = ACCURACY, out: str = "q") -> DataFrame:
    """(keys, n, out): per key the values at the ranks floor(p (n - 1)); the least and the greatest value are exact."""
    keys, log_gamma = list(keys), _log_gamma(accuracy)
    order = Window.partitionBy(*keys).orderBy("sign", F.col("sign") * F.col("bucket"))
    whole = Window.partitionBy(*keys)
    rows = sketched.withColumn("_upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("n").over(whole))
    # The middle of a bucket in the harmonic sense, within the bucket's own least and greatest value.
    middle = F.col("sign") * 2 * F.exp(F.col("bucket") * log_gamma) / (math.exp(log_gamma) + 1)
    value = F.least(F.greatest(middle, F.col("least")), F.col("greatest"))

    def at(p: float) -> Column:
        rank = F.floor(F.lit(float(p)) * (F.col("_n") - 1))
        inside = (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("n"))
        exact = F.when(rank == 0, F.col("least")).when(rank == F.col("_n") - 1, F.col("greatest")).otherwise(value)
        return F.max(F.when(inside, exact))

    return rows.groupBy(*keys).agg(F.max("_n").alias("n"), F.array(*[at(p) for p in probs]).alias(out))
