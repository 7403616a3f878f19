"""Byte-level BPE with forced boundaries.

A merge can only join two neighbouring bytes if some token of the vocabulary holds them side by side. All other byte pairs are
certain cuts, read off the vocabulary once as a table of 65,536 bits. The ends of the words that the vocabulary's splitting
pattern gives are cuts as well. Fragments between cuts are encoded on their own, each distinct one once per task, and their
ids concatenated. As most fragments are shorter than a word and recur, few merges are ever run.

The cuts of a batch of texts are found at once over its code points and bytes in numpy. Word ends follow from the classes
letter, number, white space and other: a class change ends a word, a blank before a word belongs to it, the last of several
white space characters before a word stands alone, and an apostrophe that is not part of a longer run of other characters
takes the listed endings. Special tokens are cut out of the text before and have their own ids.

Ids travel as binary, unsigned 32-bit little-endian integers. Rules of the vocabulary come from the file at ``path`` on the
driver and are broadcast; they grow with the vocabulary, not with the data. Decoding concatenates the tokens' bytes and
reads them as UTF-8, broken sequences as U+FFFD.

Defined cases: null texts are empty, empty texts have no ids and decode to empty texts; rows are encoded one by one, whatever
their ids and however often they stand; other columns are ignored; an empty table gives no rows; unknown ids raise an error.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import slices

#: Endings that an apostrophe starts, and the code points that count as white space.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Distinct fragments a task remembers, and the longest that it does.
REMEMBERED, LONGEST = 1 << 20, 64
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point."""
    of = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.int8, 0x110000)
    table[list(WHITE)] = SPACE
    return table


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: itself, or the next free one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Tokens as bytes, merges by pair of ids, special tokens, and the table of byte pairs that are certain cuts."""

    def __init__(self, raw: bytes):
        file = json.loads(raw)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ids = file["model"]["vocab"]
        self.bytes = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, longest_first))) if self.special else None
        self.bytes.update({i: t.encode() for t, i in self.special.items()})
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]):
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.start = [ids[c] for c in byte_letters()]
        self.cut = np.ones((256, 256), dtype=bool)
        for token in self.bytes.values():
            flat = np.frombuffer(token, np.uint8)
            self.cut[flat[:-1], flat[1:]] = False
        self.known = Remembered(self)

    def merged(self, fragment: bytes) -> bytes:
        """Ids of a fragment: neighbours are joined in the order of their merges' ranks, equal ranks from left to right."""
        ids = [self.start[b] for b in fragment]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue  # one of the two has been joined meanwhile
            ids[i], ids[j] = self.merges[pair][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (new := (ids[left], ids[right])) in self.merges:
                    heapq.heappush(heap, (self.merges[new][0], left, new))
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()


class Remembered(dict):
    """Ids of the fragments met so far; long ones are encoded anew."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, fragment: bytes) -> bytes:
        ids = self.vocabulary.merged(fragment)
        if len(fragment) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[fragment] = ids
        return ids


def word_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each code point, whether a word starts there. ``ends`` holds the places after each text."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[0] = True
    first[ends] = True
    change = first.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    run = change[:n].copy()
    start = run.copy()
    # White space before a word: its last character starts a new one and, if it is a blank, takes the word along.
    last = np.flatnonzero((kind == SPACE) & change[1:] & ~first[1:])
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # An apostrophe alone between other classes, not after a blank, takes a listed ending of the letters after it.
    mark = np.flatnonzero((points == 39) & run & change[1:] & ~first[1:])
    mark = mark[start[mark] & (kind[np.minimum(mark + 1, n - 1)] == LETTER)]
    open_ = np.ones(len(mark), dtype=bool)
    for ending in ENDINGS:
        k = len(ending)
        fits = open_.copy()
        for j, letter in enumerate(ending, 1):
            at = mark + j
            inside = at < n
            at = np.minimum(at, n - 1)
            fits &= inside & (points[at] == ord(letter)) & (~first[at])
        open_ &= ~fits
        hit = mark[fits]
        start[hit + 1] = False
        beyond = hit + 1 + k
        beyond = beyond[beyond < n]
        start[beyond[kind[beyond] == LETTER]] = True
    return start


def _pieces(texts: list[str], special: re.Pattern | None, ids: dict[str, int]) -> tuple[list[str], list[int], list[int]]:
    """Pieces between special tokens, the text each is of, and the special id after it (-1 for none)."""
    pieces, of, after = [], [], []
    for i, text in enumerate(texts):
        begin = 0
        for found in special.finditer(text) if special else ():
            pieces.append(text[begin: found.start()])
            of.append(i)
            after.append(ids[found.group()])
            begin = found.end()
        pieces.append(text[begin:])
        of.append(i)
        after.append(-1)
    return pieces, of, after


def encode_texts(texts: list[str], vocabulary: Vocabulary) -> list[bytes]:
    """Ids of each text."""
    pieces, of, after = _pieces(texts, vocabulary.special_pattern, vocabulary.special)
    joined = "".join(pieces)
    raw = joined.encode("utf-8", "surrogatepass")
    out: list[list[bytes]] = [[] for _ in texts]
    if raw:
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ends = np.cumsum([len(p) for p in pieces])
        flat = np.frombuffer(raw, dtype=np.uint8)
        lead = np.flatnonzero((flat & 0xC0) != 0x80)  # the byte each code point starts at
        cut = np.zeros(len(flat) + 1, dtype=bool)
        cut[1:-1] = vocabulary.cut[flat[:-1], flat[1:]]
        cut[lead[word_starts(points, ends)]] = True
        byte_ends = np.append(lead, len(flat))[ends]
        cut[byte_ends] = True
        cut[0] = cut[-1] = True
        places = np.flatnonzero(cut)
        known = vocabulary.known
        at = places.tolist()
        ids = [known[raw[a:b]] for a, b in zip(at, at[1:])]
        upto = np.searchsorted(places, byte_ends).tolist()
    else:
        ids, upto = [], [0] * len(pieces)
    begin = 0
    for i, end, token in zip(of, upto, after):
        out[i] += ids[begin:end]
        begin = end
        if token >= 0:
            out[i].append(token.to_bytes(4, "little"))
    return [b"".join(x) for x in out]


def decode_ids(ids: bytes, vocabulary: Vocabulary) -> str:
    table = vocabulary.bytes
    return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(raw: Broadcast) -> Vocabulary:
    """Parsed once per Python worker."""
    key = hash(raw.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(raw.value)
    return _loaded[key]


def load(spark: SparkSession, path: str) -> Broadcast:
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encoded(documents: DataFrame, vocabulary: Broadcast, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` and ids (binary: unsigned 32-bit little-endian) of every text."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _vocabulary(vocabulary)
        for batch in slices(batches):
            ids, held, size = [], [], 0
            for text in batch.column(1).to_pylist():
                held.append(text)
                size += len(text)
                if size > BLOCK:
                    ids += encode_texts(held, rules)
                    held, size = [], 0
            ids += encode_texts(held, rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["_row", "ids"])

    return rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, ids binary").select("_row.*", "ids")


def decoded(tokens: DataFrame, vocabulary: Broadcast, ids_col: str = "ids") -> DataFrame:
    """All columns and ``decoded``, the text of the ids."""
    rows = tokens.select(F.struct(*[F.col(f"`{c}`") for c in tokens.columns]).alias("_row"), F.coalesce(F.col(f"`{ids_col}`"), F.lit(b"")).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _vocabulary(vocabulary)
        for batch in slices(batches):
            texts = [decode_ids(x, rules) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_row", "decoded"])

    return rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, decoded string").select("_row.*", "decoded")


def id_array(ids: bytes) -> np.ndarray:
    """The ids of a row as integers."""
    return np.frombuffer(ids, dtype="<u4")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    vocabulary = load(documents.sparkSession, path)
    whole = decoded(encoded(documents, vocabulary), vocabulary)
    return whole.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
