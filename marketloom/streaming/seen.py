"""Store of the keys that earlier batches have finished.

Keys fall into buckets by hash. Each batch adds a run, its keys per bucket in order, with a Bloom filter per bucket in an index
beside. A later batch looks its keys up in the filters of their buckets and reads only the bucket files of runs that may hold
one of them. Runs merge in tiers: when ``FAN`` neighbouring runs of a tier stand, they become one run of the next, so a bucket
has a number of runs that grows with the logarithm of the batches, and a key is written again once per tier.

A run is named after the first and the last batch it covers and counts once its index is whole. A batch that is repeated
after a failure replaces its own run and does not look into it; merging takes only earlier runs, deletes them after the merged run
counts, and passes over leftovers, which a longer run covers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.streaming.windows import folder_of

BUCKETS, FAN, BITS_PER_KEY, PROBES = 64, 8, 10, 5
_RUN = re.compile(r"run=(\d+)-(\d+)$")


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """(probe, key): the bits of each hash."""
    one, two = h.view(np.uint64), (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.stack([(one + np.uint64(i) * two) >> np.uint64(7) for i in range(PROBES)]) % np.uint64(bits)


def _filter(h: np.ndarray) -> bytes:
    bits = max(64, 1 << (len(h) * BITS_PER_KEY - 1).bit_length())
    rows = np.zeros(bits, dtype=bool)
    rows[_places(h, bits).ravel().astype(np.int64)] = True
    return np.packbits(rows, bitorder="little").tobytes()


def _may_hold(h: np.ndarray, raw: bytes) -> np.ndarray:
    held = np.frombuffer(raw, np.uint8)
    at = _places(h, 8 * len(held)).astype(np.int64)
    return ((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


class SeenKeys:
    """The store below ``root``; ``key`` is the name and ``kind`` the SQL type of the key column."""

    def __init__(self, spark: SparkSession, root: str, key: str, kind: str = "string", buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.root, self.key, self.kind, self.buckets, self.fan = spark, root, key, kind, buckets, fan
        self.fs, self.where = folder_of(spark, root)

    def _hash(self) -> Column:
        return F.xxhash64(F.col(self.key).cast(self.kind))

    def _bucket(self) -> Column:
        return F.pmod(self._hash(), F.lit(self.buckets)).cast("int")

    def runs(self) -> list[tuple[int, int]]:
        """(first, last batch) of the runs that count, those that a longer run covers left out."""
        index = self.where.suffix("/index")
        if not self.fs.exists(index):
            return []
        found = []
        for f in self.fs.listStatus(index):
            name = _RUN.search(f.getPath().toString())
            if name and self.fs.exists(f.getPath().suffix("/_SUCCESS")):
                found.append((int(name[1]), int(name[2])))
        return sorted(r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found))

    def _keys(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{self.key} {self.kind}").option("recursiveFileLookup", "true").parquet(*paths)

    def _index(self, runs: list[tuple[int, int]]) -> DataFrame:
        """(bucket, run, filter) of some runs."""
        return self.spark.read.schema("bucket int, run string, filter binary").parquet(*[f"{self.root}/index/run={lo}-{hi}" for lo, hi in runs])

    def _write(self, keys: DataFrame, lo: int, hi: int) -> None:
        """Keys, then filters; a run counts with the last."""
        path, name = f"{self.root}/keys/run={lo}-{hi}", f"{lo}-{hi}"
        rows = keys.filter(F.col(self.key).isNotNull()).select(F.col(self.key).cast(self.kind).alias(self.key)).distinct().withColumn("bucket", self._bucket())
        rows.repartition("bucket").sortWithinPartitions("bucket", self.key).write.mode("overwrite").partitionBy("bucket").parquet(path)

        def build(table: pa.Table) -> pa.Table:
            return pa.table({"bucket": table["bucket"].slice(0, 1), "run": [name], "filter": pa.array([_filter(table["h"].to_numpy())], pa.binary())})

        made = self.spark.read.schema(f"{self.key} {self.kind}, bucket int").parquet(path).select("bucket", self._hash().alias("h"))
        made.groupBy("bucket").applyInArrow(build, "bucket int, run string, filter binary").write.mode("overwrite").parquet(f"{self.root}/index/run={name}")

    def candidates(self, batch: DataFrame, runs: list[tuple[int, int]]) -> list[tuple[int, str]]:
        """(bucket, run) that may hold a key of the batch, by the filters; at most buckets times runs."""
        if not runs:
            return []
        rows = batch.filter(F.col(self.key).isNotNull()).select(self._bucket().alias("bucket"), self._hash().alias("h"))

        def look_up(keys: pa.Table, filters: pa.Table) -> pa.Table:
            h = keys["h"].to_numpy() if keys.num_rows else np.empty(0, np.int64)
            hit = [bool(len(h)) and bool(_may_hold(h, raw).any()) for raw in filters["filter"].to_pylist()]
            return filters.select(["bucket", "run"]).filter(pa.array(hit, pa.bool_()))

        found = rows.groupBy("bucket").cogroup(self._index(runs).groupBy("bucket")).applyInArrow(look_up, "bucket int, run string")
        return [(r.bucket, r.run) for r in found.collect()]

    def unseen(self, batch: DataFrame, number: int | None = None) -> DataFrame:
        """Rows whose key no other batch than ``number`` has added. Rows without a key are unseen."""
        runs = [r for r in self.runs() if number is None or r[1] < number]
        paths = [f"{self.root}/keys/run={run}/bucket={bucket}" for bucket, run in self.candidates(batch, runs)]
        if not paths:
            return batch
        held = self._keys(paths)
        return batch.join(held.select(F.col(self.key).alias("_seen")), F.col(self.key).cast(self.kind) == F.col("_seen"), "left_anti")

    def add(self, keys: DataFrame, number: int) -> None:
        """The keys a batch has finished; again for the same number replaces them. Merges earlier runs where due."""
        self._write(keys, number, number)
        self._merge(number)

    def _tiers(self, runs: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
        """Neighbouring runs of one tier, ``fan`` at a time."""
        group: list[tuple[int, int]] = []
        for run in runs:
            tier = lambda r: int(np.log(r[1] - r[0] + 1) / np.log(self.fan) + 1e-9)
            if group and tier(group[-1]) != tier(run):
                group = []
            group.append(run)
            if len(group) == self.fan:
                yield group
                group = []

    def _merge(self, number: int) -> None:
        while group := next(self._tiers([r for r in self.runs() if r[1] < number]), None):
            lo, hi = group[0][0], group[-1][1]
            paths = [p for a, b in group if self.fs.exists(self.where.suffix(p := f"/keys/run={a}-{b}"))]
            self._write(self._keys([self.root + p for p in paths]), lo, hi)
            for a, b in group:
                for part in ("index", "keys"):
                    self.fs.delete(self.where.suffix(f"/{part}/run={a}-{b}"), True)
