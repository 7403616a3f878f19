"""Staged tables, connected components and vectorised word hashes shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.session import fresh_path

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and reread: cuts lineage, survives lost executors, and gives the planner true sizes.

    Written with zstd: these tables carry whole texts or sketches, and the folder's space and network are what they cost.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; null gives an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest reachable node as root, for every node of ``edges`` (a, b).

    Alternating large-star and small-star steps: edges of a component are redrawn to ever smaller neighbours until each
    node hangs on its root, in a number of rounds that grows with the logarithm of the component. A hub's neighbours are
    only reduced by ``min`` and joined, never gathered. Null ends and loops are left out; no edges give no rows.
    """
    cur = staged(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        n, total = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = (n, total)
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, cur = cur, staged(low.select("u", F.col("m").alias("v")).union(moved).distinct(), "edges")
        release(before)


# --- word hashes in numpy ------------------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
_FOLD[65:91] += np.uint64(32)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            values = np.full(size, base, dtype=np.uint64)
            values[0] = 1
            _powers[name] = np.cumprod(values, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class Block:
    """Words of some texts: 64-bit hash with A-Z folded, start and end byte, and the text each word is of."""

    def __init__(self, texts: Sequence[bytes]):
        self.data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        gap = np.ones(len(self.data) + 2, dtype=np.int8)
        gap[1:-1] = _SPACE[self.data]
        turn = np.diff(gap)
        self.start, self.end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        up, down = _power(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_FOLD[self.data] * up[: len(self.data)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        #: words of text i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.start, at)


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches in slices, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def blocks(texts: Sequence[str | None], most: int = 1 << 20) -> Iterator[tuple[int, Block, int]]:
    """(position of the first text, its block, number of texts), cut by bytes so that memory stays bounded by a text."""
    begin, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > most:
            yield begin, Block(held), len(held)
            begin, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield begin, Block(held), len(held)
