"""Spelling variants: exact neighbours at one edit by a dictionary of trie-node pairs.

Words are the frequent runs of letters. The nodes of the trie of all words and of the trie of all reversed words are numbered,
so each prefix and each suffix is an integer. Leaving out place i of a word gives the pair (node of the prefix before it, node
of the suffix after it); cutting a word in two at place i gives such a pair as well. Two words that share a skipped pair differ
in that letter; a word's skipped pair that is another's cut is that word with a letter deleted. Both are equi-joins on two
integers. A skipped pair stands for at most one word per letter of the alphabet, a cut for one word, so no bucket is large.
Of a run of equal letters only the first is skipped for deletions, so each neighbour is met once.

Numbering follows the sorted words, range-partitioned: a word's new nodes are those beyond the prefix it shares with the word
before. Each partition numbers its own nodes; only its first and last word come to the driver, where the nodes that a
partition shares with those before it get their numbers. The number of a word's last node rises with the word's order, so it
serves as the word's id, and ties between words are decided on it.

Defined cases: null and empty texts have no words; a null id counts as empty text in the check sum; repeated rows count as often
as they stand; of near words with equal counts the smallest in code-point order is the form; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import LOWER, UPPER, release, slices, staged

LEAST_LENGTH, LEAST_COUNT, RATIO, DROPPED = 6, 5, 5, 199
#: Distinct words a task counts before it passes them on.
HELD = 1 << 19
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def word_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LEAST_LENGTH,
                least: int = LEAST_COUNT, dropped: int = DROPPED) -> DataFrame:
    """(word, n): runs of letters, A-Z folded, of at least ``length`` letters and ``least`` occurrences.

    Where ``dropped`` divides the check sum of id and run, the run loses the letter the check sum points at.
    """
    run_of = re.compile(f"[a-zÀ-ÿ]{{{max(1, length)},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lowered = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).decode("utf-8", "surrogatepass")
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(run_of.findall(lowered)).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % dropped == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < length:
                            continue
                    held[run] += n
                if len(held) > HELD:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    rows = documents.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def _local_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and, per word, the partition's numbers of the nodes along it. Words come sorted."""
    part, before, path, free = TaskContext.get().partitionId(), "", [], 0
    for batch in slices(batches, 2048):
        paths = []
        for word in batch.column(0).to_pylist():
            shared = len(commonprefix((before, word)))
            path = path[:shared] + list(range(free, free + len(word) - shared))
            free += len(word) - shared
            before = word
            paths.append(path)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(paths, pa.list_(pa.int64()))], [*batch.schema.names, "part", "path"])


def numbered(words: DataFrame, column: str, name: str) -> DataFrame:
    """All columns and ``name``: the numbers of the trie nodes along the strings of ``column``, from the first letter on."""
    spark, columns = words.sparkSession, [F.col(column).alias("_key"), *words.columns]
    keyed = words.select(*columns).repartitionByRange("_key").sortWithinPartitions("_key")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields)
    local = staged(keyed.mapInArrow(_local_paths, f"{kind}, part int, path array<long>"), "trie")
    ends = local.groupBy("part").agg(F.min("_key").alias("first"), F.max("_key").alias("last"), F.max_by("path", "_key").alias("path")).orderBy("part")
    rows, word, along, free = [], "", [], 1  # 0 is the root
    for r in ends.collect():  # one row per partition
        shared = len(commonprefix((word, r.first)))
        known = along[:shared]
        rows.append((r.part, known, free - shared))
        along = [known[x] if x < shared else free - shared + x for x in r.path]
        free += r.path[-1] + 1 - shared if r.path else 0
        word = r.last
    bases = spark.createDataFrame(rows, "part int, known array<long>, base long")
    node = F.transform("path", lambda x: F.when(x < F.size("known"), F.get("known", x.cast("int"))).otherwise(F.col("base") + x))
    return local.join(bases, "part").select(*words.columns, node.alias(name))


def pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(p, s, id, n, head) of skipped places and (p, s, id, n) of cuts, from (id, n, letters, fore, back)."""
    fore, back = (F.concat(F.array(F.lit(0).cast("long")), c) for c in ("fore", "back"))
    size = F.size("fore")
    at = lambda a, i: F.get(a, i)
    held = nodes.select("id", "n", "letters", fore.alias("f"), back.alias("b"), size.alias("size"))
    skip = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.struct(
        at(F.col("f"), i).alias("p"), at(F.col("b"), F.col("size") - 1 - i).alias("s"),
        ((i == 0) | (at(F.col("letters"), i) != at(F.col("letters"), i - 1))).alias("head")))
    cut = F.transform(F.sequence(F.lit(0), F.col("size")), lambda i: F.struct(at(F.col("f"), i).alias("p"), at(F.col("b"), F.col("size") - i).alias("s")))
    return held.select("id", "n", F.inline(skip)), held.select("id", "n", F.inline(cut))


def near_pairs(nodes: DataFrame) -> DataFrame:
    """(id, other, other_n): every ordered pair of words at exactly one inserted, deleted or replaced letter."""
    skips, cuts = pairs(nodes)
    a, b, c = skips.alias("a"), skips.alias("b"), cuts.alias("c")
    replaced = a.join(b, (F.col("a.p") == F.col("b.p")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.id") != F.col("b.id")))
    replaced = replaced.select("a.id", F.col("b.id").alias("other"), F.col("b.n").alias("other_n"))
    deleted = a.filter("head").join(c, (F.col("a.p") == F.col("c.p")) & (F.col("a.s") == F.col("c.s")))
    both = F.array(F.struct(F.col("a.id").alias("id"), F.col("c.id").alias("other"), F.col("c.n").alias("other_n")),
                   F.struct(F.col("c.id").alias("id"), F.col("a.id").alias("other"), F.col("a.n").alias("other_n")))
    return replaced.union(deleted.select(F.inline(both)))


def followed(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): the last of the forms that follow one another; counts rise, so there is no ring."""
    jump = staged(forms.select("id", F.col("form").alias("root")), "jumps")
    while True:
        further = jump.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        ahead = staged(jump.join(further, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "jumps")
        release(jump)
        jump = ahead.select("id", "root")
        jump.staged_at = ahead.staged_at
        if ahead.filter("moved").isEmpty():
            return jump


def variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LEAST_LENGTH,
             least: int = LEAST_COUNT, ratio: int = RATIO, dropped: int = DROPPED) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word."""
    words = staged(word_counts(documents, id_col, text_col, length, least, dropped), "words")
    fore = staged(numbered(words, "word", "fore").select("word", "n", F.element_at("fore", -1).alias("id"), "fore"), "fore")
    back = numbered(fore.select("id", F.reverse("word").alias("drow")), "drow", "back").select("id", "back")
    nodes = staged(fore.select("id", "n", F.split("word", "").alias("letters"), "fore").join(back, "id"), "nodes")
    best = near_pairs(nodes).groupBy("id").agg(F.count("*").alias("n_near"), F.max(F.struct(F.col("other_n"), -F.col("other"))).alias("best"))
    names = fore.select("id", "word", "n")
    suits = F.col("best.other_n") >= ratio * F.col("n")
    judged = staged(names.join(best, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(suits, -F.col("best.col2")).alias("form"), F.when(suits, F.col("best.other_n")).alias("form_n")), "near")
    roots = followed(judged.filter("form is not null").select("id", "form"))
    named = judged.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    form, root = (names.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word")) for c in ("form", "root"))
    return named.join(form, "form", "left").join(root, "root").select(
        "word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
