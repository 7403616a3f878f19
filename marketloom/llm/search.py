"""Ranked lexical search of many items at once, with common subexpressions evaluated once per document.

Items share terms, so the sums that their scores consist of share parts. Per block of items the shared term sets are mined:
first terms that stand in exactly the same items, then, round by round, pairs of neighbouring symbols in the order of their
frequency that recur in two or more items. Each set becomes a node over terms and earlier nodes, items become sums of nodes and
of the terms left over: a graph in which whatever two items share is added up once.

Documents are read once per block and reduced to the block's terms: length, term numbers and occurrences, written to the
shared folder. From this table come the counts that weights need, and in a second pass the scores: a task takes a slice of
documents, fills one accumulator of the slice per node in the order of the graph, sums items from them, and keeps the ten best
of each item. Only these travel; they are reduced by (item, part of the documents) and then by item. No row is put out per
item and document, and no postings list is shuffled, however many documents hold a term.

Blocks of items are bounded by bytes, so driver and broadcast hold one block's terms and graph; all arithmetic but the logarithm
is in 64-bit integers.

Defined cases: null and empty texts have no terms and do not count; items without an id or without a term have no rows; an id on
several rows counts with its smallest text; rows of documents are ranked one by one, repeated ids included; equal scores
stand by ascending doc_id, rows without one last; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import slices, staged
from marketloom.llm.contamination import normalised_words

BEST, BLOCK_BYTES = 10, 1 << 20
#: Symbols of an item between which a shared pair is looked for, parts an item's best rows are first reduced by.
NEARBY, PARTS = 8, 32
_SLICE = 1024

Symbol = tuple[int, int]


def shared_sets(items: Sequence[Counter]) -> tuple[list[list[int]], list[list[int]]]:
    """(nodes, items) as lists of symbols: a number below that of terms is a term, others are nodes in order of creation.

    A term that an item repeats stands in it as often; its first, second, ... occurrence are different symbols while sets
    are mined, so that nodes hold repeats as well.
    """
    terms = 1 + max((t for item in items for t in item), default=-1)
    codes: dict[Symbol, int] = {}
    held: list[set[int]] = [{codes.setdefault((t, i), len(codes)) for t, n in item.items() for i in range(n)} for item in items]
    nodes: list[list[int]] = []
    first_node = len(codes)

    def node(parts: list[int], where: Sequence[int]) -> None:
        nodes.append(parts)
        for i in where:
            held[i].difference_update(parts)
            held[i].add(first_node + len(nodes) - 1)

    stands = defaultdict(list)
    for i, item in enumerate(held):
        for s in item:
            stands[s].append(i)
    alike = defaultdict(list)
    for s, where in stands.items():
        if len(where) > 1:
            alike[tuple(where)].append(s)
    for where, parts in alike.items():
        if len(parts) > 1:
            node(sorted(parts), where)
    while True:
        often = Counter(s for item in held for s in item)
        near: Counter = Counter()
        rows = [sorted((s for s in item if often[s] > 1), key=lambda s: (-often[s], s)) for item in held]
        for row in rows:
            near.update((x, y) for i, x in enumerate(row) for y in row[i + 1: i + 1 + NEARBY])
        used: set[int] = set()
        chosen = {}
        for (x, y), n in sorted(near.items(), key=lambda p: (-p[1], p[0])):
            if n < 2:
                break
            if x not in used and y not in used:
                used |= {x, y}
                chosen[x, y] = []
        if not chosen:
            break
        partner = {x: y for x, y in chosen}
        for i, item in enumerate(held):
            for x in item:
                if partner.get(x) in item:
                    chosen[x, partner[x]].append(i)
        for (x, y), where in chosen.items():
            node([x, y], where)
    term_of = {c: t for (t, _), c in codes.items()}

    def plain(symbols) -> list[int]:
        return sorted(term_of[s] if s < first_node else terms + s - first_node for s in symbols)

    return [plain(n) for n in nodes], [plain(item) for item in held]


def additions(nodes: Sequence[Sequence[int]], items: Sequence[Sequence[int]]) -> int:
    """Vectors added up per slice of documents."""
    return sum(map(len, nodes)) + sum(map(len, items))


def _postings(documents: DataFrame, id_col: str, text_col: str, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times): length in terms and the block's terms of every text that has any term."""
    wanted = documents.sparkSession.sparkContext.broadcast(number)  # terms of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = wanted.value
        for batch in slices(batches):
            lengths, sizes, terms, times = [], [0], [], []
            for text in batch.column(1).to_pylist():
                words = normalised_words(text)
                found = Counter(map(of.get, words))
                found.pop(None, None)
                lengths.append(len(words))
                terms += found.keys()
                times += found.values()
                sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))], ["doc_id", "n", "terms", "times"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>").filter("n > 0")


class Evaluation:
    """Accumulators of the nodes over slices of documents, and the best documents of each item."""

    def __init__(self, nodes: list[list[int]], items: list[list[int]], weight: np.ndarray, n: int, length: int, best: int):
        self.nodes, self.items, self.weight, self.n, self.length, self.best = nodes, items, weight, n, length, best
        none = np.empty(0, np.int64)
        self.kept = [(none, none, np.empty(0, bool)) for _ in items]

    def scores(self, lengths: np.ndarray, owner: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Score of each item and document of a slice; (owner, terms, times) are the postings of the slice."""
        m = 100 - 75 + 75 * lengths * self.n // self.length
        parts = self.weight[terms] * (1_000_000_000 * times // (1000 * times + 8 * m[owner]))
        order = np.argsort(terms, kind="stable")
        owner, parts = owner[order], parts[order]
        bounds = np.searchsorted(terms[order], np.arange(len(self.weight) + 1))
        sums: list[np.ndarray] = []

        def total(symbols: list[int]) -> np.ndarray:
            out = np.zeros(len(lengths), dtype=np.int64)
            for s in symbols:
                if s >= len(self.weight):
                    out += sums[s - len(self.weight)]
                else:
                    lo, hi = bounds[s], bounds[s + 1]
                    out[owner[lo:hi]] += parts[lo:hi]  # a document stands once under a term
            return out

        for node in self.nodes:
            sums.append(total(node))
        return np.array([total(item) for item in self.items], dtype=np.int64).reshape(len(self.items), len(lengths))

    def add(self, ids: np.ndarray, missing: np.ndarray, scores: np.ndarray) -> None:
        size = scores.shape[1]
        enough = np.partition(scores, size - self.best, axis=1)[:, size - self.best] if size > self.best else np.zeros(len(scores), np.int64)
        for i, (row, bound) in enumerate(zip(scores, enough)):
            score, doc, none = self.kept[i]
            bound = max(1, bound, score[-1] if len(score) == self.best else 0)
            new = np.flatnonzero(row >= bound)
            if len(new):
                score, doc, none = np.concatenate((score, row[new])), np.concatenate((doc, ids[new])), np.concatenate((none, missing[new]))
                order = np.lexsort((doc, none, -score))[: self.best]
                self.kept[i] = score[order], doc[order], none[order]

    def result(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _, _ in self.kept]
        item = np.repeat(np.arange(len(sizes)), sizes)
        score, doc, none = (np.concatenate([k[j] for k in self.kept]) if sizes else np.empty(0, kind) for j, kind in enumerate((np.int64, np.int64, bool)))
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=none), pa.array(score, pa.int64())], ["item", "doc_id", "score"])


def _best(rows: DataFrame, keys: list, best: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def _block(documents: DataFrame, items: list, kind: str, id_col: str, text_col: str, best: int) -> DataFrame:
    spark = documents.sparkSession
    number: dict[bytes, int] = {}
    bags = [Counter(number.setdefault(t, len(number)) for t in normalised_words(text)) for _, text in items]
    nodes, sums = shared_sets(bags)
    rows = staged(_postings(documents, id_col, text_col, number), "postings")
    n, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(len(number), dtype=np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # terms of the block
        weight[r.term] = math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1)))
    graph = spark.sparkContext.broadcast((nodes, sums, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Evaluation(*graph.value, n, length, best)
        for batch in slices(batches, _SLICE):
            terms, times = (batch.column(i) for i in (2, 3))
            owner = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy())
            scores = state.scores(batch.column(1).to_numpy(), owner, terms.flatten().to_numpy(), times.flatten().to_numpy())
            ids = batch.column(0)
            state.add(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), scores)
        yield state.result()

    found = rows.mapInArrow(run, "item int, doc_id long, score long")
    found = _best(found, ["item", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))], best).drop("rank")
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(items)], f"item int, item_id {kind}")
    return _best(found, ["item"], best).join(names, "item").select("item_id", "rank", "doc_id", "score")


def ranked(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
           item_text: str = "text", best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents of each item with a score above 0."""
    asked = items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).groupBy(F.col(item_id).alias("item_id")).agg(
        F.min(F.col(item_text).cast("string")).alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    out = documents.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for i in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).orderBy("item_id").collect()  # about block_bytes
        if rows:
            out = out.union(_block(documents, [tuple(r) for r in rows], kind, id_col, text_col, best))
    return out
