"""Market price files: delimited text in GB18030 with metadata and footer rows around the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.session import allow_charsets

# Column order of a price file; the sixth column repeats the fifth.
COLUMNS = ("date", "close", "vwap", "volume_tons", "turnover_cny", "turnover_again", "cum_turnover_cny")
RAW = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def scan_prices(spark: SparkSession, path: str, encoding: str = "GB18030", date_format: str = "yyyy/MM/dd",
                market: str = "market") -> DataFrame:
    """Typed prices of all markets below ``path``, one folder per market.

    Header, metadata and footer rows go because their first field is no date; a position in the file means nothing
    once a large file is split among tasks.
    """
    allow_charsets(spark)
    rows = (
        spark.read.schema(T.StructType([*RAW.fields, T.StructField(market, T.StringType())]))
        .option("encoding", encoding).option("mode", "PERMISSIVE").csv(path))
    day = F.to_date(F.try_to_timestamp("date", F.lit(date_format)))
    numbers = [c for c in COLUMNS[1:] if c != "turnover_again"]
    return (
        rows.withColumn("date", day).filter(F.col("date").isNotNull())
        .select(market, "date", *[F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in numbers]))
