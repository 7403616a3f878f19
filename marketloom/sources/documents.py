"""JSON document scans and sinks, crawl-log statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()

CLEANING = T.StructType([
    T.StructField("original_length", _L), T.StructField("cleaned_length", _L), T.StructField("chars_removed", _L),
    T.StructField("patterns_applied", T.ArrayType(_S)), T.StructField("cleaned_at", _S)])

FILTERING = T.StructType([
    T.StructField("matched_keyword", _S), T.StructField("filter_timestamp", _S),
    T.StructField("was_cleaned", T.BooleanType()), T.StructField("chars_removed_in_cleaning", _L)])

DOCUMENT = T.StructType([
    *[T.StructField(n, _S) for n in ("doc_id", "url", "title", "content", "section", "publish_date", "doc_number")],
    T.StructField("view_count", _L), T.StructField("content_length", _L),
    *[T.StructField(n, _S) for n in ("content_hash", "scraped_at", "source", "source_detail", "source_name_cn", "source_name_en")],
    T.StructField("_cleaning_metadata", CLEANING), T.StructField("_filter_metadata", FILTERING)])


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths that exist on their file system; the others are skipped rather than failing the scan."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        matches = p.getFileSystem(conf).globStatus(p)
        if matches is not None and len(matches) > 0:
            found.append(path)
    return found


def scan_jsonl(spark: SparkSession, paths: Sequence[str], schema: T.StructType = DOCUMENT) -> DataFrame:
    """JSON lines with a fixed schema. Source and section come from the last two folders where the line has none.

    A line that is not JSON goes to ``_bad_line`` instead of stopping the job.
    """
    with_bad = T.StructType([*schema.fields, T.StructField("_bad_line", _S)])
    found = existing_paths(spark, paths)
    if not found:
        return spark.createDataFrame([], with_bad)
    rows = (
        spark.read.schema(with_bad).option("recursiveFileLookup", "true").option("columnNameOfCorruptRecord", "_bad_line")
        .json(found).withColumn("_file", F.col("_metadata.file_path")))
    folders = F.split("_file", "/")
    named = lambda i: F.regexp_replace(F.element_at(folders, i), "^[a-z_]+=", "")
    return (
        rows.withColumn("source", F.coalesce("source", named(-3)))
        .withColumn("section", F.coalesce("section", named(-2))).drop("_file"))


def scan_batches(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """Numbered batch files, each one JSON array, with the batch number and the position inside the batch."""
    rows = spark.read.text(pattern, wholetext=True)
    parsed = rows.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"batch_(\d+)", 1).cast("long").alias("batch_num"),
        F.from_json("value", T.ArrayType(schema)).alias("docs"))
    return parsed.select("batch_num", F.posexplode("docs").alias("pos", "doc")).select("batch_num", "pos", "doc.*")


def write_jsonl(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """JSON lines in UTF-8, one folder per value of ``by``.

    Rows of a folder gather in files of the advisory partition size, so the number of files grows with the bytes, not with tasks
    times folders. Spark splits what is larger, so a folder with most of the rows spreads over tasks.
    """
    if by:
        df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).json(path)
    else:
        df.write.mode(mode).json(path)


def run_statistics(log: DataFrame, section: str, status: str = "status") -> DataFrame:
    """Successful, failed and skipped pages per section of a crawl log."""
    return log.groupBy(section).agg(*[
        F.count_if(F.col(status) == s).alias(s) for s in ("success", "failed", "skipped")])
