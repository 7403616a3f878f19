"""Windows over a stream of events: tumbling, sliding, sessions. No event is ever too late.

Each micro-batch is reduced to partial windows, which are written under the batch's number; partial windows of one window
add up, and partial sessions that overlap become one. So the result does not depend on how many files the events lie in,
in which order these arrive or how many a trigger takes, no state is held in memory, and a batch repeated after a failure
replaces its own folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def timed(events: DataFrame) -> DataFrame:
    """Event times as instants; times without a zone count in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _totals(events: DataFrame, keys: Sequence[str], window: Column, *spread: Column) -> DataFrame:
    rows = timed(events).groupBy(window.alias("window"), *keys, *spread).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def tumbling(events: DataFrame, keys: Sequence[str], width: str = "1 day") -> DataFrame:
    return _totals(events, keys, F.window("ts", width))


def sliding(events: DataFrame, keys: Sequence[str], width: str = "7 days", slide: str = "1 day") -> DataFrame:
    return _totals(events, keys, F.window("ts", width, slide))


def sessions(events: DataFrame, keys: Sequence[str], gap: str = "30 minutes") -> DataFrame:
    """Partial sessions within a day, so the events of a hot key spread over its days; :func:`merged_sessions` joins them.

    Events a gap or more apart are of different sessions; a session window of a microsecond less says the same.
    """
    shorter = F.session_window("ts", f"{gap} -1 microseconds")
    return _totals(events, keys, shorter, F.to_date("ts").alias("_day")).withColumn("end", F.col("end") + F.expr("interval 1 microsecond"))


def summed_windows(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial windows added up."""
    return parts.groupBy("start", "end", *keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def merged_sessions(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sessions from partial ones that end a gap after their last event: those that overlap are one, those that only touch are two.

    Partial sessions merge within the day they start on, by (key, day). Only a day's first session can reach back over
    midnight; how days hang together follows from a row per key and day.
    """
    keys = list(keys)
    rows = summed_windows(parts, keys).withColumn("_day", F.to_date("start"))
    inside = Window.partitionBy(*keys, "_day").orderBy("start", "end")
    reached = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col("start") >= reached), 1).otherwise(0)
    nth = F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    daily = rows.withColumn("_opens", opens).withColumn("_nth", nth).groupBy(*keys, "_day", "_nth").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    days = daily.groupBy(*keys, "_day").agg(F.min("start").alias("_first"), F.max("end").alias("_last"), F.max("_nth").alias("_sessions"))
    along = Window.partitionBy(*keys).orderBy("_day")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    back = F.coalesce(F.col("_first") < F.max("_last").over(earlier), F.lit(False)).cast("int")
    days = days.withColumn("_back", back)
    days = days.withColumn("_before", F.coalesce(F.sum(F.col("_sessions") - F.col("_back")).over(earlier), F.lit(0)))
    days = days.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_day").alias("_on"), "_back", "_before")
    same = daily["_day"] == days["_on"]
    for i, k in enumerate(keys):
        same = same & daily[k].eqNullSafe(days[f"_k{i}"])
    chain = F.col("_before") + F.col("_nth") - F.col("_back")
    return daily.join(days, same).withColumn("_chain", chain).groupBy(*keys, "_chain").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.sum("total").alias("total")).drop("_chain")


def run_available(spark: SparkSession, path: str, schema: T.StructType, build: Callable[[DataFrame, Sequence[str]], DataFrame], output: str,
                  checkpoint: str, keys: Sequence[str], merge: Callable[[DataFrame, Sequence[str]], DataFrame] = summed_windows,
                  files_per_batch: int = 100, folders: int = 100) -> DataFrame:
    """Take in all files present that were not taken before, and return the windows of all events up to now.

    When more than ``folders`` batches have been written since the last time, they are merged into one folder, so the
    partial windows read are those of the windows there are and of a bounded number of batches.
    """
    def write(batch: DataFrame, number: int) -> None:
        build(batch, keys).write.mode("overwrite").parquet(f"{output}/batch={number}")

    query = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        .writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return merge(partial_windows(spark, output, keys, merge, folders), keys)


def partial_windows(spark: SparkSession, output: str, keys: Sequence[str], merge: Callable[[DataFrame, Sequence[str]], DataFrame],
                    folders: int) -> DataFrame:
    """All partial windows: of the newest merged folder and of the batches after it; merges again when these are many.

    A merged folder counts once it is whole; what it holds is deleted after that, and a leftover of a run that ended in
    between is passed over by its number.
    """
    fs, base = folder_of(spark, output)
    numbers = {kind: sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(base) if f.getPath().getName().startswith(f"{kind}=") and (
        kind == "batch" or fs.exists(f.getPath().suffix("/_SUCCESS")))) for kind in ("batch", "merged")}
    newest = numbers["merged"][-1] if numbers["merged"] else -1
    later = [n for n in numbers["batch"] if n > newest]
    used = [f"{output}/merged={newest}"] * (newest >= 0) + [f"{output}/batch={n}" for n in later]
    parts = spark.read.parquet(*used)
    if len(later) <= folders:
        return parts
    merge(parts, keys).write.mode("overwrite").parquet(f"{output}/merged={later[-1]}")
    for path in used:
        fs.delete(base.suffix("/" + path.rsplit("/", 1)[1]), True)
    return spark.read.parquet(f"{output}/merged={later[-1]}")


def folder_of(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where
