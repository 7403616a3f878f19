"""Benchmark decontamination with one Aho-Corasick automaton over the normalised windows of all items.

Texts are normalised bytewise (A-Z folded, separators to blanks), so a word keeps its byte place and a match is mapped
back to offsets of the original. Each text passes through the automaton once. The items are written to the shared folder, by hash in blocks
of about ``block_bytes`` of text, and a task reads a block by its path when it builds that automaton. With several blocks a task holds ``text_bytes`` of texts and passes
them through one automaton after the other, so that a block is built once per that many bytes. The driver holds no items, a task one block's and
two automata.

Defined cases: null and empty texts have no words, no hits and are not contaminated; items without words or without an
id are left out; an item_id on several rows counts once; rows of documents are judged one by one, repeated ids included;
columns of other names are ignored; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import slices
from marketloom.session import fresh_path

SIZE = 13
BLOCK_BYTES, TEXT_BYTES = 8 << 20, 64 << 20
#: Bytes that separate words become blanks, A-Z become a-z.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_automata: OrderedDict[str, ahocorasick.Automaton] = OrderedDict()


def normalised_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(words: list[bytes], size: int = SIZE) -> list[bytes]:
    """Windows of ``size`` words, or all words as one if they are fewer."""
    return [b" ".join(words[i: i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def block_items(path: str) -> list[tuple[str, str]]:
    """The items of a block's folder."""
    system, folder = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    files = [f for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(".parquet")]
    out: list[tuple[str, str]] = []
    for file in files:
        with system.open_input_file(file.path) as source:
            table = pq.read_table(source)
        out += zip(table.column("item").to_pylist(), table.column("text").to_pylist())
    return out


def _automaton(path: str, size: int) -> ahocorasick.Automaton:
    """The automaton of a block, built once per Python worker; at most two are held."""
    key = f"{size} {path}"
    if key not in _automata:
        items = block_items(path)
        patterns: dict[bytes, set[str]] = {}
        for item, text in items:
            for window in windows(normalised_words(text), size):
                patterns.setdefault(window, set()).add(item)
        made = ahocorasick.Automaton()
        for window, of in patterns.items():
            pattern = f" {window.decode('latin-1')} "
            made.add_word(pattern, (len(pattern), tuple(of)))
        if patterns:
            made.make_automaton()
        _automata[key] = made
        while len(_automata) > 2:
            _automata.popitem(last=False)
    return _automata[key]


def _hits(joined: str, automaton: ahocorasick.Automaton, intervals: list[tuple[int, int]], items: set[str]) -> None:
    """Adds the character intervals of the joined words that are windows, and the items these are of."""
    if len(automaton):
        for end, (length, of) in automaton.iter(joined):
            intervals.append((end - length + 1, end))
            items.update(of)


def _union(intervals: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping intervals merged; two that only share a blank stay apart."""
    merged: list[list[int]] = []
    for start, end in sorted(intervals):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def _original(text: str, joined: str, merged: list[list[int]]) -> list[dict[str, int]]:
    """Character offsets in the original text of the merged intervals."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    spans = []
    for start, end in merged:
        first = joined.count(" ", 0, start + 1) - 1
        last = joined.count(" ", 0, end) - 1
        begin, stop = places[first][0], places[last][1]
        spans.append({"start": len(raw[:begin].decode("utf-8", "surrogatepass")), "end": len(raw[:stop].decode("utf-8", "surrogatepass"))})
    return spans


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[str]:
    """Folders of the items' blocks, of about ``block_bytes`` of text each; only their count comes to the driver."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    if not n:
        return []
    path = fresh_path(benchmark.sparkSession, "benchmark")
    items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n))).repartition("block").write.partitionBy("block").parquet(path)
    return [f"{path}/block={i}" for i in range(n)]


def scan(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
         item_id: str = "item_id", item_text: str = "text", size: int = SIZE, block_bytes: int = BLOCK_BYTES, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Per row: ``carry``, n_words, n_hit, items (sorted as strings), spans (start, end in characters of the text)."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    return _found(rows, None, benchmark, item_id, item_text, size, block_bytes, text_bytes).select("_row.*", "n_words", "n_hit", "items", "spans")


def held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold ``most`` bytes."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(b.nbytes for b in some) >= most:
            yield pa.concat_batches(some)
            some = []
    if some:
        yield pa.concat_batches(some)


def _found(docs: DataFrame, field: str | None, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text",
           size: int = SIZE, block_bytes: int = BLOCK_BYTES, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Rows (_row, and _text unless the text is ``field`` of _row) with n_words, n_hit, items, spans."""
    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # With few automata texts pass in small slices; with many, in large ones, so that each is built few times.
        for batch in slices(batches) if len(blocks) <= 2 else held(batches, text_bytes):
            n_words, n_hit, items, spans = [], [], [], []
            texts = (batch.column(1) if field is None else batch.column(0).field(field)).to_pylist()
            joined = [(b" " + b" ".join(normalised_words(t)) + b" ").decode("latin-1") for t in texts]
            found: list[list[tuple[int, int]]] = [[] for _ in texts]
            named: list[set[str]] = [set() for _ in texts]
            for path in blocks:
                automaton = _automaton(path, size)
                for j, intervals, of in zip(joined, found, named):
                    _hits(j, automaton, intervals, of)
            for text, j, intervals, of in zip(texts, joined, found, named):
                union = _union(intervals)
                n_words.append(j.count(" ") - 1 if len(j) > 2 else 0)
                n_hit.append(sum(j.count(" ", s + 1, e + 1) for s, e in union))
                items.append(sorted(of))
                spans.append(_original(text, j, union) if union else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["_row", "n_words", "n_hit", "items", "spans"])

    kind = docs.schema["_row"].dataType.simpleString()
    return docs.mapInArrow(run, f"_row {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")


def judged(found: DataFrame) -> DataFrame:
    """Adds n_items, items_sha256 and contaminated."""
    return found.withColumns({
        "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256),
        "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})


def clean_documents(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", **kwargs) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    return judged(_found(rows, text_col, benchmark, **kwargs)).filter("not contaminated").select("_row.*")
