"""Incremental work: resume by log, checkpointed document scoring, run summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.ordering import first_per_key
from marketloom.operators.sentiment import LIMITS, valid_scores
from marketloom.streaming import seen

SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in LIMITS])
#: Bytes of text that a scorer gets at a time.
PIECE = 4 << 20


def pending(items: DataFrame, log: DataFrame, key: str = "url") -> DataFrame:
    """Items whose key a progress log at hand does not hold yet; a log kept over runs is a :class:`seen.SeenKeys`."""
    return items.join(log.select(key), key, "left_anti")


def progress(done: DataFrame, section: str, key: str = "url") -> DataFrame:
    """Log rows for finished items."""
    return done.select(key, F.lit(section).alias("section"), F.current_timestamp().alias("logged_at"))


def pieces(batch: pa.RecordBatch, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes of text, views of the batch; a row alone may be larger."""
    text = [c for c in batch.columns if any(is_kind(c.type) for is_kind in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary))]
    size = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in text), np.full(batch.num_rows, 8 * batch.num_columns))
    ends = np.cumsum(size)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - size[begin] + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def scored_by(score: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Turn a function from a batch of documents to their three scores into a DataFrame step.

    The function gets pandas batches inside tasks and may call whatever scores a document; it must keep row order. Only a few MB
    of text are pandas at a time, whatever rows Arrow's batches hold, and the documents pass on as the Arrow columns they came in.
    """
    def step(df: DataFrame) -> DataFrame:
        schema = T.StructType([*df.schema.fields, *SCORES.fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch):
                    docs = piece.to_pandas()
                    for name in docs.select_dtypes("datetimetz"):
                        docs[name] = docs[name].dt.tz_localize(None)
                    scores = score(docs)
                    found = [pa.Array.from_pandas(scores[name], type=pa.float64()) for name in SCORES.names]
                    yield pa.RecordBatch.from_arrays([*piece.columns, *found], names=schema.names)

        return df.mapInArrow(run, schema)

    return step


def score_documents(spark: SparkSession, source: str, schema: T.StructType, output: str, checkpoint: str,
                    scorer: Callable[[DataFrame], DataFrame], files_per_batch: int = 50, key: str = "doc_id") -> None:
    """Score new documents batch by batch until none are left.

    The stream's checkpoint remembers the files read. Each batch drops documents that an earlier one has scored, found in the
    store of seen keys below ``output``, splits off rejected scores, and overwrites the folder of its own number, so a batch
    repeated after a failure or a lost executor leaves no second copy. No state grows in memory, and a batch reads only
    those buckets and runs of the store that may hold its keys. A batch that scores nothing adds no run.
    """
    done = seen.SeenKeys(spark, f"{output}/seen", key, schema[key].dataType.simpleString())

    def write(batch: DataFrame, number: int) -> None:
        # Lines that are no documents have no key: they are rejected as they are, once per line.
        broken = batch.filter(F.col(key).isNull())
        fresh = first_per_key(batch.filter(F.col(key).isNotNull()), [key], [F.xxhash64(*[c for c in batch.columns if c != key])])
        scored = scorer(done.unseen(fresh, number)).withColumn("_ok", valid_scores()).persist()
        try:
            scored.filter("_ok").drop("_ok").write.mode("overwrite").parquet(f"{output}/scored/batch={number}")
            rejected = scored.filter("NOT _ok").drop("_ok").unionByName(broken, allowMissingColumns=True)
            rejected.write.mode("overwrite").parquet(f"{output}/rejected/batch={number}")
        finally:
            scored.unpersist()
        kind = schema[key].dataType.simpleString()
        added = spark.read.schema(f"`{key}` {kind}").parquet(f"{output}/scored/batch={number}")
        if not added.isEmpty():
            done.add(added, number)

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
    query = (
        reader.json(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
    query.awaitTermination()


def run_summary(log: DataFrame, keys: Sequence[str] = (), status: str = "status", seconds: str = "seconds") -> DataFrame:
    """Documents, successes, failures, success rate and seconds per successful document of a run log."""
    ok = F.count_if(F.col(status) == "ok")
    return log.groupBy(*keys).agg(
        F.count("*").alias("total_documents"), ok.alias("processed"), (F.count("*") - ok).alias("failed"),
        (ok / F.greatest(F.count("*"), F.lit(1))).alias("success_rate"), (F.sum(seconds) / F.greatest(ok, F.lit(1))).alias("avg_seconds"))
