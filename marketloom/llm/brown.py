"""Brown class-based n-gram scores.

Exchange clustering gives every word of the training texts a class, in three steps. Units, the most frequent words and buckets of
the last letters for all others, are exchanged one by one on the driver and seed the classes. Then all frequent words
(``head``, whose counts travel to the tasks anyway) move to the class of highest likelihood, given how often each class stands before them. Last,
all other words move in the same way in Spark: a table holds per word its counts by class before it, a sweep picks classes in the
tasks against the present table of class transitions, and the table is added up anew. Words move in halves, so that two that
depend on one another do not change places for ever, and sweeps end when the likelihood no longer rises. Only words that
training has not seen take the class of their last letters.

As history, the word before, frequent words stand for their class, all others for the class of their last letters, which a task
knows without a join; both are functions of the word, so the model is a proper one:

    P(w | v) = mix * T(class w | history v) * (c(w) + a) / (N_class + a (V_class + 1)) + (1 - mix) * (c(w) + a) / (N + a (V + 1))

The factor c(w) + a is common to both terms, so a text's score is the sum of log10(c(w) + a), shared with the unigram
base score, plus a sum that depends on the classes alone. Counts cover every training text. Words beyond the frequent ones meet
their counts and classes in one join on the word's 64-bit hash. The end of a text is a token of a class of its own.

Defined cases: null and empty texts consist of their end alone; a null id counts as the id of empty text (held out);
repeated rows are scored row by row and counted as often as they stand; other columns are ignored; without training texts
every word is unknown; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import Block, blocks, id_crc, release, staged

ALPHA, HEAD, UNITS, BUCKETS, CLASSES, SWEEPS, MIX = 0.1, 65_536, 512, 255, 32, 8, 0.7
#: Sweeps over the frequent and over all other words; each moves half of them.
HEAD_SWEEPS, TAIL_SWEEPS = 12, 6
BLOCK = 1 << 20


def buckets_of(block: Block) -> np.ndarray:
    """Bucket of each word's last three bytes."""
    length = block.end - block.start
    code = block.data[block.end - 1].astype(np.int64) * 7919
    code += np.where(length > 1, block.data[block.end - 2], 0) * np.int64(104_729)
    code += np.where(length > 2, block.data[block.end - 3], 0) * np.int64(1_299_709)
    return code % BUCKETS


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of word hashes, combined per batch."""
    for batch in batches:
        found = [(block.hash, buckets_of(block)) for _, block, _ in blocks(batch.column(0).to_pylist(), BLOCK)]
        if found:
            hashes, first, counts = np.unique(np.concatenate([h for h, _ in found]), return_index=True, return_counts=True)
            bucket = np.concatenate([b for _, b in found])[first]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(bucket, pa.int32()), pa.array(counts, pa.int64())], ["h", "b", "c"])


def word_counts(training: DataFrame) -> DataFrame:
    """(h, b, c): every word of the texts by hash, its bucket and count."""
    return training.select("text").mapInArrow(_count_words, "h long, b int, c long").groupBy("h").agg(F.first("b").alias("b"), F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (ascending), counts and buckets of the most frequent words, at most ``most``, cut where a bound of the count falls."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("long")
    histogram = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # 64 rows per doubling
    bound, held = None, 0
    for lev, n in histogram:
        if held + n > most:
            break
        bound, held = lev, held + n
    if bound is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    rows = counts.filter(level >= bound).select("h", "c", "b").toArrow()
    h, c, b = rows.column(0).to_numpy().astype(np.int64).view(np.uint64), rows.column(1).to_numpy(), rows.column(2).to_numpy()
    order = np.argsort(h)
    return h[order], c[order], b[order].astype(np.int64)


def unit_ids(block: Block, known: np.ndarray) -> np.ndarray:
    """Unit of each word: a listed word's place plus one, else its bucket's."""
    bucket = len(known) + 1 + buckets_of(block)
    if not len(known):
        return bucket
    at = np.minimum(np.searchsorted(known, block.hash), len(known) - 1)
    return np.where(known[at] == block.hash, 1 + at, bucket)


def _with_ends(block: Block, unit: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of the block's texts in order, each text closed by unit 0, and the unit before each (0 at a start)."""
    current = np.insert(unit, block.first[1: count + 1], 0)
    previous = np.concatenate(([0], current[:-1]))
    return current, previous


def exchange(bigrams: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of each unit; unit 0 keeps a class of its own.

    Each step takes one unit out of its class and puts it where the log-likelihood of the class bigrams is highest.
    """
    n = len(bigrams)
    left, right = bigrams.sum(0), bigrams.sum(1)
    order = np.argsort(-(left + right), kind="stable")
    order = order[order != 0]
    of = np.zeros(n, dtype=np.int64)
    of[order] = 1 + np.arange(n - 1) % (classes - 1)
    table = np.zeros((classes, classes))
    np.add.at(table, (of[:, None].repeat(n, 1), of[None, :].repeat(n, 0)), bigrams)

    def xlogx(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)

    for _ in range(sweeps):
        changed = 0
        for u in order:
            if left[u] + right[u] == 0:
                continue
            old, self_ = of[u], bigrams[u, u]
            out = np.bincount(of, weights=bigrams[u], minlength=classes)
            into = np.bincount(of, weights=bigrams[:, u], minlength=classes)
            out[old] -= self_
            into[old] -= self_
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= self_
            rows, cols = table.sum(1), table.sum(0)
            # Gain in the bigram likelihood when the unit's counts are added to row and column of each class.
            gain = (xlogx(table + out[None, :]) - xlogx(table)).sum(1) + (xlogx(table.T + into[None, :]) - xlogx(table.T)).sum(1)
            own = np.arange(classes)
            cell = table[own, own]
            gain += xlogx(cell + out + into + self_) - xlogx(cell + out) - xlogx(cell + into) + xlogx(cell)
            gain -= xlogx(rows + right[u]) - xlogx(rows) + xlogx(cols + left[u]) - xlogx(cols)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            table[new] += out
            table[:, new] += into
            table[new, new] += self_
            of[u] = new
            changed += new != old
        if not changed:
            break
    return of


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of the classes given the histories, up to what no exchange changes; table is (history, class)."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum())


#: Counts for which the gain of an entry is read off a table.
SMALL = 16


def _added(held: np.ndarray, most: int) -> np.ndarray:
    """x log x of each cell with 1 to ``most`` more, less that of the cell; (more - 1, cell)."""
    more = np.arange(1, most + 1, dtype=float).reshape(-1, *[1] * held.ndim)
    return _xlogx(held[None] + more) - _xlogx(held)[None]


def moved(word: np.ndarray, before: np.ndarray, n: np.ndarray, of: np.ndarray, table: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The class of highest likelihood for each word that is free to move, all others as they are.

    ``word`` (ascending), ``before`` and ``n`` list how often the history class stands before the word; every word has a
    row. Each word is taken out of its class first; class 0 is the end of a text. Most entries are of small counts: what
    these add to a cell is worked out once for all words.
    """
    if not len(word):
        return of.copy()
    out, columns = of.copy(), table.sum(0)
    cells, wholes = _added(table, SMALL), _added(columns, SMALL)

    def gained(held: np.ndarray, ready: np.ndarray, at: np.ndarray | None, more: np.ndarray, own: np.ndarray) -> np.ndarray:
        """What each class gains by the counts, the words' own class without them."""
        rows = held if at is None else held[at]
        small = more <= SMALL
        gain = np.empty((len(more), held.shape[-1]))
        gain[small] = ready[more[small] - 1] if at is None else ready[more[small] - 1, at[small]]
        many = more[~small].astype(float)[:, None]
        there = np.broadcast_to(rows, gain.shape)[~small] if at is None else rows[~small]
        gain[~small] = _xlogx(there + many) - _xlogx(there)
        mine = np.broadcast_to(rows, gain.shape)[np.arange(len(more)), own]
        gain[np.arange(len(more)), own] = _xlogx(mine) - _xlogx(np.maximum(mine - more, 0))
        return gain

    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    size = np.add.reduceat(n, first)
    step = 1 << 10  # words at a time, so that a task or the driver holds few megabytes
    for lo in range(0, len(first), step):
        begin, end = first[lo], first[lo + step] if lo + step < len(first) else len(word)
        names, starts = word[first[lo: lo + step]], first[lo: lo + step] - begin
        gain = np.add.reduceat(gained(table, cells, before[begin:end], n[begin:end], of[word[begin:end]]), starts, axis=0)
        gain -= gained(columns, wholes, None, size[lo: lo + step], of[names])
        gain[:, 0] = -np.inf
        # A word stays unless another class is better by more than rounding.
        stay = gain[np.arange(len(names)), of[names]]
        best = np.argmax(gain, axis=1)
        better = gain[np.arange(len(names)), best] > stay + 1e-9 * (1 + np.abs(stay))
        out[names] = np.where(free[names] & better, best, of[names])
    return out


def _table(word: np.ndarray, before: np.ndarray, n: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    return np.bincount(before * classes + of[word], weights=n, minlength=classes * classes).astype(float).reshape(classes, classes)


def swept(word: np.ndarray, before: np.ndarray, n: np.ndarray, of: np.ndarray, rest: np.ndarray, sweeps: int) -> np.ndarray:
    """Classes of words after sweeps over alternating halves; ``rest`` is the table of all other words."""
    for sweep in range(sweeps):
        table = rest + _table(word, before, n, of, len(rest))
        new = moved(word, before, n, of, table, np.arange(len(of)) % 2 == sweep % 2)
        if likelihood(rest + _table(word, before, n, new, len(rest))) <= likelihood(table) and sweep % 2:
            break
        of = new
    return of


@dataclass
class Histories:
    """What every task knows: frequent words by ascending hash with their class, and the class of each bucket."""

    head: np.ndarray
    head_class: np.ndarray
    bucket_class: np.ndarray

    def places(self, block: Block) -> np.ndarray:
        """Place among the frequent words, -1 for others."""
        if not len(self.head):
            return np.full(len(block.hash), -1)
        at = np.minimum(np.searchsorted(self.head, block.hash), len(self.head) - 1)
        return np.where(self.head[at] == block.hash, at, -1)

    def classes(self, block: Block, places: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        known = self.head_class[np.maximum(places, 0)] if len(self.head) else 0
        return np.where(places >= 0, known, self.bucket_class[buckets])


def _contexts(training: DataFrame, know: Histories, classes: int, rare: bool) -> DataFrame:
    """(kind, key, before, n, b): counts of words by the class before them.

    Kind 0: frequent words by place, the end of a text after the last; kind 1: buckets; kind 2, if ``rare``, all
    other words by hash, with their bucket.
    """
    ends = len(know.head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, bucket = np.zeros((ends + 1) * classes, np.int64), np.zeros(BUCKETS * classes, np.int64)
        for batch in batches:
            found = []
            for _, block, count in blocks(batch.column(0).to_pylist(), BLOCK):
                places, buckets = know.places(block), buckets_of(block)
                current, before = _with_ends(block, know.classes(block, places, buckets), count)
                key = np.insert(places, block.first[1: count + 1], ends)
                listed = key >= 0
                head += np.bincount(key[listed] * classes + before[listed], minlength=len(head))
                inner = np.insert(buckets, block.first[1: count + 1], 0)
                bucket += np.bincount(inner[~listed] * classes + before[~listed], minlength=len(bucket))
                if rare:
                    hashes = np.insert(block.hash, block.first[1: count + 1], 0)[~listed]
                    found.append((hashes, before[~listed], inner[~listed]))
            if found:
                h, v, b = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((v, h))
                h, v, b = h[order], v[order], b[order]
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (v[1:] != v[:-1]))))
                yield _rows(2, h[first].view(np.int64), v[first], np.diff(np.append(first, len(h))), b[first])
        for kind, dense in ((0, head), (1, bucket)):
            some = np.flatnonzero(dense)
            yield _rows(kind, some // classes, some % classes, dense[some], np.zeros(len(some)))

    return training.mapInArrow(run, "kind int, key long, before int, n long, b int").groupBy("kind", "key", "before").agg(F.sum("n").alias("n"), F.first("b").alias("b"))


def _rows(kind: int, key: np.ndarray, before: np.ndarray, n: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(key), kind), pa.int32()), pa.array(key, pa.int64()), pa.array(before, pa.int32()), pa.array(n, pa.int64()), pa.array(b, pa.int32())],
        ["kind", "key", "before", "n", "b"])


def _dense(contexts: DataFrame, kind: int, size: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, before, n) by word of the frequent words or of the buckets; at most ``size`` times the classes."""
    rows = contexts.filter(F.col("kind") == kind).select("key", "before", "n").toArrow()
    key, before, n = (rows.column(i).to_numpy() for i in range(3))
    order = np.lexsort((before, key))
    return key[order], before[order].astype(np.int64), n[order]


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, before, n) of a batch of words, numbered in the batch."""
    lists = batch.column("before")
    return np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy().astype(np.int64), batch.column("n").flatten().to_numpy()


def _tail_table(tail: DataFrame, classes: int) -> np.ndarray:
    """Transitions into the words of the table under their classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, classes))
        for batch in batches:
            total += _table(*_flat(batch), batch.column("k").to_numpy().astype(np.int64), classes)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total.ravel()[cells])], ["cell", "n"])

    cells = tail.mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # classes squared
    out = np.zeros(classes * classes)
    for cell, n in cells:
        out[cell] = n
    return out.reshape(classes, classes)


def tail_classes(tail: DataFrame, rest: np.ndarray, sweeps: int) -> tuple[DataFrame, np.ndarray]:
    """(table, transitions): words (h, c, before, n, k) with their classes after sweeps; ``rest``: the transitions of all other words."""
    classes = len(rest)
    kind = tail.schema
    own = _tail_table(tail, classes)
    for sweep in range(sweeps):
        table = rest + own

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                free = batch.column("h").to_numpy() % 2 == sweep % 2
                new = moved(*_flat(batch), batch.column("k").to_numpy().astype(np.int64), table, free)
                yield batch.set_column(batch.schema.get_field_index("k"), "k", pa.array(new, pa.int32()))

        new = staged(tail.mapInArrow(run, kind), "classes")
        then = _tail_table(new, classes)
        if likelihood(rest + then) <= likelihood(table):
            release(new)
            if sweep % 2:
                break
            continue
        if sweep:
            release(tail)
        tail, own = new, then
    return tail, own


@dataclass
class Model:
    """Counts, classes and class tables; ``tail`` has (h, c, k) of all words but the frequent ones."""

    know: Histories
    head_count: np.ndarray
    tail: DataFrame
    table: np.ndarray
    tokens: np.ndarray
    types: np.ndarray
    total_tokens: int
    total_types: int
    ends: int

    def step(self, alpha: float, mixture: float) -> np.ndarray:
        """log10 of what a word's count plus alpha is multiplied by, by (history, class)."""
        classes = len(self.table)
        transition = (self.table + 1.0 / classes) / (self.table.sum(1, keepdims=True) + 1.0)
        inside = transition / (self.tokens + alpha * (self.types + 1))[None, :]
        return np.log10(mixture * inside + (1 - mixture) / (self.total_tokens + alpha * (self.total_types + 1)))


def train(training: DataFrame, head: int = HEAD, units: int = UNITS, classes: int = CLASSES, head_sweeps: int = HEAD_SWEEPS, tail_sweeps: int = TAIL_SWEEPS) -> Model:
    """Classes of all words of the texts (a column ``text`` without nulls)."""
    counts = staged(word_counts(training), "counts")
    n_words, v_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = training.count()
    head_hash, head_count, head_bucket = frequent(counts, head)
    top = np.sort(np.argsort(-head_count, kind="stable")[:units])
    known = head_hash[top]
    width = 1 + len(known) + BUCKETS

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, dtype=np.int64)
        for batch in batches:
            for _, block, count in blocks(batch.column(0).to_pylist(), BLOCK):
                current, previous = _with_ends(block, unit_ids(block, known), count)
                total += np.bincount(previous * width + current, minlength=width * width)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["cell", "n"])

    cells = training.mapInArrow(pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # units squared at most
    bigrams = np.zeros(width * width)
    bigrams[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    of = exchange(bigrams.reshape(width, width), classes, SWEEPS)
    bucket_class = of[1 + len(known):]
    # Frequent words start in the class of their unit, or of the bucket that stood for them.
    start = np.zeros(len(head_hash), np.int64)
    if len(head_hash):
        start = bucket_class[head_bucket]
        start[top] = of[1: 1 + len(known)]
    know = Histories(head_hash, start, bucket_class)
    first = staged(_contexts(training, know, classes, rare=False), "contexts")
    word, before, n = _dense(first, 0, len(head_hash) + 1, classes)
    rest = _table(*_dense(first, 1, BUCKETS, classes), bucket_class, classes)
    release(first)
    last = word == len(head_hash)
    rest += _table(word[last], before[last], n[last], np.zeros(len(head_hash) + 1, np.int64), classes)
    know = Histories(head_hash, swept(word[~last], before[~last], n[~last], start, rest, head_sweeps), bucket_class)
    # The histories have changed with the classes: count again, now with all other words by themselves.
    contexts = staged(_contexts(training, know, classes, rare=True), "contexts")
    word, before, n = _dense(contexts, 0, len(head_hash) + 1, classes)
    rest = _table(word, before, n, np.append(know.head_class, 0), classes)
    first_class = F.get(F.lit(bucket_class.astype(int).tolist()), F.col("b")).cast("int")
    tail = staged(contexts.filter("kind = 2").groupBy(F.col("key").alias("h")).agg(
        F.first("b").alias("b"), F.sum("n").alias("c"), F.array_sort(F.collect_list(F.struct("before", "n"))).alias("x")).select(  # a row per class at most
        "h", "c", F.col("x.before").alias("before"), F.col("x.n").alias("n"), first_class.alias("k")), "words")
    release(contexts)
    tail, own = tail_classes(tail, rest, tail_sweeps)
    table = rest + own
    types = np.bincount(know.head_class, minlength=classes).astype(float)
    for k, v in tail.groupBy("k").count().collect():
        types[k] += v
    types[0] += 1
    release(counts)
    return Model(know, head_count, tail.select("h", "c", "k"), table, table.sum(0), types, n_words + ends, v_words + (1 if ends else 0), ends)


def class_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, units: int = UNITS,
                 classes: int = CLASSES, alpha: float = ALPHA, mixture: float = MIX) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every text."""
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        (id_crc(F.col(id_col)) % 10 == 0).alias("held_out"))
    return scores(docs, train(docs.filter("not held_out").select("text"), head, units, classes), alpha, mixture)


def scores(docs: DataFrame, model: Model, alpha: float = ALPHA, mixture: float = MIX) -> DataFrame:
    """Scores of texts (doc_id, text, held_out) under a model."""
    know, step, ends = model.know, model.step(alpha, mixture), model.ends
    classes = len(step)
    end_log, head_log = float(np.log10(ends + alpha)), np.log10(model.head_count + alpha)
    base_den = model.total_tokens + alpha * (model.total_types + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            for begin, block, count in blocks(texts, BLOCK):
                places, buckets = know.places(block), buckets_of(block)
                current, previous = _with_ends(block, know.classes(block, places, buckets), count)
                listed = np.insert(places, block.first[1: count + 1], len(know.head)) >= 0
                # Steps into frequent words and ends; the classes of others come with their counts.
                moves = np.concatenate(([0.0], np.cumsum(np.where(listed, step[previous, current], 0.0))))
                upto = block.first[: count + 1] + np.arange(count + 1)
                logs = np.where(places >= 0, head_log[np.maximum(places, 0)], 0.0) if len(know.head) else np.zeros(len(places))
                log_sum, known_sum = (np.concatenate(([0], np.cumsum(x))) for x in (logs, places >= 0))
                lo, hi = block.first[:count], block.first[1: count + 1]
                rare = places < 0
                before = previous[np.delete(np.arange(len(current)), upto[1:] - 1)]
                offsets = pa.array(np.concatenate(([0], np.cumsum(rare)))[block.first[: count + 1]], pa.int32())
                packed = (before * BUCKETS + buckets)[rare]
                tail = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(block.hash[rare].view(np.int64)), pa.array(packed, pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, count), held.slice(begin, count), pa.array(hi - lo + 1, pa.int64()), pa.array(moves[upto[1:]] - moves[upto[:-1]]),
                     pa.array((log_sum[hi] - log_sum[lo]).astype(float) + end_log), pa.array(known_sum[hi] - known_sum[lo], pa.int64()), *tail],
                    ["doc_id", "held_out", "n_tokens", "steps", "logs", "known", "h", "x"])

    scored = docs.select("doc_id", "text", "held_out").mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, steps double, logs double, known long, h array<long>, x array<int>")
    scored = staged(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    tail = scored.select("row", F.explode(F.arrays_zip("h", "x")).alias("w")).select("row", F.col("w.h").alias("h"), F.col("w.x").alias("x"))
    before, bucket = F.floor(F.col("x") / BUCKETS), F.col("x") % BUCKETS
    of = F.coalesce("k", F.get(F.lit(know.bucket_class.astype(int).tolist()), bucket.cast("int")))
    into = F.get(F.lit(step.ravel().tolist()), (before * classes + of).cast("int"))
    summed = tail.join(model.tail, "h", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(alpha))).alias("tail_logs"), F.sum(into).alias("tail_steps"), F.count("c").alias("tail_known"))
    logs = F.col("logs") + F.coalesce("tail_logs", F.lit(0.0))
    result = scored.drop("h", "x").join(summed, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(int(model.total_tokens)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(base_den)))).alias("base_score"),
        (logs + F.col("steps") + F.coalesce("tail_steps", F.lit(0.0))).alias("score"))
    return result.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
