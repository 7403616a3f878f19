"""Sessions of a stream with event-time state.

Keys and days fall into slots by hash. State is kept per slot: one Arrow table of the sessions of its keys and days that are still
open, so calls, timers and state reads cost per slot, not per key. A timer fires when the watermark passes the end of the first
of them; what is over is put out once and leaves the state, so state holds what lies within the watermark's delay, however long the
stream. Events older than the watermark meet no open session; they come out beside the closed ones as late partial sessions.
Results add up: closed, late and open partial sessions merge by :func:`windows.merged_sessions` into those of all events, in
whatever files, order and batches these arrived. A batch repeated after a failure restores its state and replaces its folder.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from marketloom.streaming import windows

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
PART = ["start_us", "end_us", "n", "valued", "total"]
#: ``valued`` counts the events with a value; the total of none is null.
STATE = "start_us long, end_us long, n long, valued long, total double"
#: Slots of the state. Another number later is no harm, since partial sessions of one key in two slots add up.
SLOTS = 1024
#: Rows of a slot that wait before they are merged into what it holds.
WAITING = 100_000


def joined(parts: pd.DataFrame, by: Sequence[str]) -> pd.DataFrame:
    """Overlapping partial sessions of equal ``by`` as one; those that only touch stay apart."""
    size = len(parts)
    if not size:
        return parts
    key = np.zeros(size, np.int64)
    for name in by:
        codes, values = pd.factorize(parts[name], use_na_sentinel=False)
        key = pd.factorize(key * len(values) + codes)[0]
    order = np.lexsort((parts["start_us"].to_numpy(), key))
    parts, key = parts.iloc[order], key[order]
    start, reached = parts["start_us"].to_numpy(), parts["end_us"].groupby(key).cummax().to_numpy()
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] >= reached[:-1])]))
    sums = {c: np.add.reduceat(parts[c].to_numpy(), first) for c in ("n", "valued", "total")}
    return parts.iloc[first].assign(end_us=reached[np.append(first[1:], size) - 1], **sums)


def _names(keys: int) -> list[str]:
    """Names of the key columns in tasks; those of the stream need not be names that pandas keeps."""
    return [f"key{i}" for i in range(keys)]


class OpenSessions(StatefulProcessor):
    """Open sessions of a slot; puts out those that the watermark has passed, and late ones at once. Key columns are text."""

    def __init__(self, keys: int, gap_us: int):
        self.names, self.gap = _names(keys), gap_us

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "parts binary")

    def _held(self) -> pd.DataFrame:
        if not self.open.exists():
            return pd.DataFrame(columns=[*self.names, "day", *PART])
        return _table(self.open.get()[0]).to_pandas()

    def _keep(self, parts: pd.DataFrame) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(parts):
            fields = [*[(k, pa.string()) for k in self.names], ("day", pa.int64()), *[(c, pa.int64()) for c in PART[:-1]], (PART[-1], pa.float64())]
            table, sink = pa.Table.from_pandas(parts, pa.schema(fields), preserve_index=False).replace_schema_metadata(), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            self.open.update((sink.getvalue().to_pybytes(),))
            self.handle.registerTimer(-(-int(parts["end_us"].min()) // 1000))
        else:
            self.open.clear()

    def _out(self, kind: str, parts: pd.DataFrame) -> pd.DataFrame:
        return parts.assign(kind=kind)[[*self.names, "kind", *PART]].reset_index(drop=True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        by = [*self.names, "day", "late"]
        parts, new = self._held().assign(late=False), []
        for batch in rows:
            us = batch["us"].to_numpy(np.int64)
            new.append(batch[self.names].assign(
                day=batch["day"].to_numpy(np.int64), start_us=us, end_us=us + self.gap, n=np.int64(1),
                valued=batch["valued"].to_numpy(np.int64), total=batch["value"].to_numpy(np.float64), late=us < passed))
            if sum(map(len, new)) >= max(WAITING, len(parts)):
                parts, new = joined(pd.concat([x for x in (parts, *new) if len(x)]), by), []
        if new:
            parts = joined(pd.concat([x for x in (parts, *new) if len(x)]), by)
        late = parts["late"].to_numpy(bool)
        self._keep(parts[~late].drop(columns="late"))
        if late.any():
            yield self._out("late", parts[late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = self._held()
        over = held["end_us"].to_numpy(np.int64) <= passed
        self._keep(held[~over])
        if over.any():
            yield self._out("closed", held[over])

    def close(self) -> None:
        pass


def _table(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _spans(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parts.select(F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"), *keys, "n", "total")


def _typed(parts: DataFrame, keys: Sequence[str], kinds: Mapping[str, str], *more: str) -> DataFrame:
    """Keys of their own types; no total where no event has a value."""
    return parts.select(
        *[F.col(c).cast(kinds.get(k, "string")).alias(k) for c, k in zip(_names(len(keys)), keys)], *more, "start_us", "end_us", "n",
        F.when(F.col("valued") > 0, F.col("total")).alias("total"))


def open_sessions(spark: SparkSession, checkpoint: str, keys: Sequence[str], kinds: Mapping[str, str] | None = None) -> DataFrame:
    """The partial sessions in the state of the last batch. ``kinds`` has the SQL types of the keys, which are text without."""
    keys, names = list(keys), _names(len(keys))
    held = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint).select("value.parts")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["parts"]:
                yield from _table(raw.as_py()).select([*names, *PART]).to_batches()

    return _spans(_typed(held.mapInArrow(read, ", ".join(f"{c} string" for c in names) + f", {STATE}"), keys, kinds or {}), keys)


def run_available(spark: SparkSession, path: str, schema: T.StructType, output: str, checkpoint: str, keys: Sequence[str],
                  gap_minutes: int = 30, delay: str = "1 hour", files_per_batch: int = 100, slots: int = SLOTS) -> DataFrame:
    """Take in all files present that were not taken before; (start, end, keys, n, total) of the sessions of all events.

    ``output`` keeps a folder per batch with the closed and the late partial sessions by ``kind``.
    """
    keys, names, gap = list(keys), _names(len(keys)), gap_minutes * 60_000_000
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        events = windows.timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))
        # Rows pass on their time as a number: the operator keeps late ones, which it would drop by a time column. Keys pass as text,
        # in which pandas keeps nulls apart from whole numbers.
        day = F.unix_date(F.to_date("ts")).cast("long")
        rows = events.withWatermark("ts", delay).select(
            F.pmod(F.xxhash64(*keys, day), F.lit(slots)).cast("int").alias("slot"), *[F.col(k).cast("string").alias(c) for c, k in zip(names, keys)],
            day.alias("day"), F.unix_micros("ts").alias("us"), F.col("value").isNotNull().cast("long").alias("valued"),
            F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
        named = ", ".join(f"{c} string" for c in names)
        parts = rows.filter("us IS NOT NULL").groupBy("slot").transformWithStateInPandas(
            OpenSessions(len(keys), gap), f"{named}, kind string, {STATE}", "Append", "EventTime")

        def write(batch: DataFrame, number: int) -> None:
            _typed(batch, keys, kinds, "kind").write.mode("overwrite").parquet(f"{output}/batch={number}")

        query = parts.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)
    done = _spans(spark.read.parquet(output), keys)
    return windows.merged_sessions(done.unionByName(open_sessions(spark, checkpoint, keys, kinds)), keys)
