"""Indicator files: one two-column text file per indicator, and scans driven by a manifest or a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import allow_charsets


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[A-Za-z0-9.]+$", 1)


def scan_indicators(spark: SparkSession, path: str, encoding: str = "GBK", name: Column | None = None) -> DataFrame:
    """All indicator files in one scan, the file name as the indicator; metadata and footer rows have no date."""
    allow_charsets(spark)
    rows = (
        spark.read.schema("date string, value string").option("encoding", encoding).csv(path)
        .withColumn("indicator", file_stem(F.col("_metadata.file_path")) if name is None else name))
    return (
        rows.withColumn("date", F.to_date(F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))))
        .filter(F.col("date").isNotNull())
        .select("indicator", "date", F.expr("try_cast(value AS DOUBLE)").alias("value")))


def manifest(spark: SparkSession, path: str) -> list[str]:
    """File names listed in a manifest, one per line; a short list by nature."""
    lines = spark.read.text(path).select(F.trim("value").alias("name")).filter("length(name) > 0")
    return [r["name"] for r in lines.orderBy("name").collect()]


def scan_listed(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Parquet files of a manifest, each keyed by its name."""
    return _with_stem(spark.read.parquet(*[f"{folder}/{n}" for n in names]), folder)


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet files below a folder, keyed by the entry directly below it."""
    return _with_stem(spark.read.option("recursiveFileLookup", "true").parquet(folder), folder)


def _with_stem(df: DataFrame, folder: str) -> DataFrame:
    tail = folder.rstrip("/").rsplit("/", 1)[-1]
    entry = F.regexp_extract(F.col("_metadata.file_path"), rf"/{tail}/([^/]+)", 1)
    return df.select("*", F.regexp_replace(entry, r"\.parquet$", "").alias("stem"))
