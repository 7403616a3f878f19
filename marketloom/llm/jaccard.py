"""Exact Jaccard join on word n-gram sets by pigeonhole over a partitioned universe.

Two sets of sizes a and b with Jaccard similarity of at least t differ in at most k = (a + b)(1 - t)/(1 + t) elements.
All shingles are hashed into g segments, for each size band its own number. A segment that is looked up exactly stands
for one difference, one that is looked up with its one-deletion neighbourhood for two; when these numbers exceed k, at
least one segment of two similar sets agrees that far. How many segments are of which kind is chosen per band by cost:
signatures, which are written and moved, against the collisions that near-empty segments would make among the given number
of documents, each of which is a test of bit rows.

Before any signature is made, sets that cannot have a partner are left out. A set keeps all but a share 1 - t of its elements
in a partner, so among its elements in a fixed part of the universe, too, at most that many stand in no other set. These
elements travel once, as short hashes by range of hash, with the ids they are of; what occurs in two different sets is counted
back to them. Equal hashes of different shingles only let more sets through, never fewer.

Links within a bucket are found without its pairs: every member is verified against one hub, and only members which are
still in different components go on to further hubs and at last to an exact join of what remains, in which a large bucket
is cut into slices that meet pairwise in tasks of their own. A hub's text goes to as many tasks as its pairs fill. Before
texts are fetched, and inside that join, a pair must pass a bound that loses nothing: elements are hashed to places of a bit row,
each bit the parity of its elements' number, and two rows never differ in more bits than the sets in elements.

Defined cases: null and empty texts have an empty set and no links; rows with a null id keep their size, with a null
component; rows of one id count as one node; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import blocks, components, mix, release, slices, staged

NUM, DEN = 90, 100
RATIO = 1.2
#: Cost of a chance collision, a test of two bit rows, in signatures, which are written, moved and sorted.
PAIR_COST = 0.25
#: Elements of one range of hashes, and the words a text is taken to have where the number of ranges is chosen.
RANGE, USUAL_WORDS = 1 << 18, 512
#: Pairs of one hub, and members of one slice of a bucket, that one task takes.
HUB_SLICE, BUCKET_SLICE = 256, 512
#: Pairs left per member of the buckets above which members try another hub before the exact join.
PAIRS_PER_MEMBER = 200
_A, _B, _C, _D = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


@lru_cache(maxsize=None)
def bands(num: int, den: int, upto: int) -> tuple[tuple[int, int], ...]:
    """(smallest, largest) size of each band; below the first, sets are similar only if they are equal."""
    low = next(n for n in range(1, 10_000) if den * n >= num * (n + 1))
    out = []
    while low <= upto:
        high = max(low, int(low * max(RATIO, den / num)))
        out.append((low, high))
        low = high + 1
    return tuple(out)


@lru_cache(maxsize=None)
def allocation(high: int, num: int, den: int, documents: int) -> tuple[int, int]:
    """(exact segments, one-deletion segments) for the band up to size ``high``: least cost that covers every difference.

    The cost of a set is its signatures plus, per segment, the chance collisions: its part is empty and so are others'.
    """
    partner = high * den // num
    k = (high + partner) * (den - num) // (den + num)
    best = None
    for q in sorted({round(i * (k + 1) / 64) // 2 for i in range(65)} | {(k + 2) // 2}):
        m = max(0, k + 1 - 2 * q)
        size = high / RATIO / (m + q)
        cost = m + q * (1 + size) + PAIR_COST * (m + q) * documents * math.exp(-2 * size)
        if best is None or cost < best[0]:
            best = (cost, m, q)
    return best[1], best[2]


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the n-word shingles; of the whole sequence when it is shorter; none for no words."""
    if len(words) == 0:
        return words
    width = min(n, len(words))
    total = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        total = total * _A + words[i: len(words) - width + 1 + i]
    return np.unique(mix(total + np.uint64(width)))


def schemes(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """(band, its largest size): the set's own band and, as the larger partner, the band below if it reaches there."""
    all_bands = bands(num, den, n)
    found = {j for smallest in (n, -(-n * num // den)) for j, (low, high) in enumerate(all_bands) if low <= smallest <= high}
    return [(j, all_bands[j][1]) for j in sorted(found)]


def signatures(shingles: np.ndarray, band: int, exact: int, loose: int) -> np.ndarray:
    """Bucket keys of a set in a band: one per segment, and one per element of the loose segments without that element."""
    g = exact + loose
    element = mix(shingles * _B + np.uint64(band))
    segment = (mix(shingles ^ _C) % np.uint64(g)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    segment, element = segment[order], element[order]
    present, first = np.unique(segment, return_index=True)
    total = np.zeros(g, dtype=np.uint64)
    total[present] = np.add.reduceat(element, first)
    place = np.arange(g, dtype=np.uint64) * _D + np.full(g, band, dtype=np.uint64) * _B
    inside = segment >= exact
    return np.unique(np.concatenate([mix(total + place), mix(total[segment[inside]] - element[inside] + place[segment[inside]])])).astype(np.int64)


def parities(shingles: np.ndarray, exact: int, loose: int) -> np.ndarray:
    """Bit row of the set, as longs: eight bits per difference that the band allows."""
    bits = 64 * max(1, (exact + 2 * loose) // 8)
    odd = np.bincount((mix(shingles ^ _D) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.empty(0), kind))


class Sample:
    """A fixed part of all shingles, as hashes of as few bytes as tell the given number of documents' shingles apart."""

    def __init__(self, documents: int, num: int, den: int):
        elements = max(1, documents) * USUAL_WORDS
        share = min(1.0, 2 * (den - num) / den)
        self.bound = np.uint64(share * (1 << 20))
        self.bytes = min(7, -(-(math.ceil(math.log2(elements)) + 5) // 8))
        self.ranges = min(1 << 20, max(1, int(elements * share) // RANGE))

    def pack(self, shingles: np.ndarray) -> bytes:
        h = mix(shingles + _B)
        return self.packed(np.unique(h[h >> np.uint64(44) < self.bound] & np.uint64((1 << 8 * self.bytes) - 1)))

    def packed(self, values: np.ndarray) -> bytes:
        return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.bytes].tobytes()

    def unpacked(self, raw: bytes) -> np.ndarray:
        wide = np.zeros((len(raw) // self.bytes, 8), dtype=np.uint8)
        wide[:, : self.bytes] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, self.bytes)
        return wide.reshape(-1).view("<u8").astype(np.uint64)

    def range_of(self, values: np.ndarray) -> np.ndarray:
        high = values >> np.uint64(max(0, 8 * self.bytes - 24))
        return (high * np.uint64(self.ranges) >> np.uint64(min(24, 8 * self.bytes))).astype(np.int64)


def sketch(docs: DataFrame, words: int, sample: Sample) -> DataFrame:
    """Per row: doc_id, set size, 128-bit digest of the set, its elements in the sample and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, block, count in blocks(texts):
                size, one, two, part = [], [], [], []
                for i in range(count):
                    s = shingle_hashes(block.hash[block.first[i]: block.first[i + 1]], words)
                    size.append(len(s))
                    one.append(int(np.add.reduce(mix(s ^ _A)).astype(np.int64)) if len(s) else 0)
                    two.append(int(np.add.reduce(mix(s ^ _D)).astype(np.int64)) if len(s) else 0)
                    part.append(sample.pack(s))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, count), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(part, pa.binary()),
                     pa.array([len(x) // sample.bytes for x in part], pa.int64())],
                    ["doc_id", "n_shingles", "d1", "d2", "part", "n_part"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, part binary, n_part long")


def shared_counts(parts: DataFrame, sample: Sample) -> DataFrame:
    """doc_id, shared: how many of a row's sampled elements (doc_id, part) stand in another row; none, no row.

    Elements that two rows of a batch have are counted there and travel on once, so a passage that a third of all rows
    share reaches its range once per batch.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            ids, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            values = sample.unpacked(b"".join(raw))
            owner = np.repeat(np.arange(len(raw)), [len(x) // sample.bytes for x in raw])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))
            times = np.diff(np.append(first, len(values)))
            alone = np.repeat(times == 1, times)
            known = np.bincount(owner[~alone], minlength=len(raw))
            twice, single, of = values[first[times > 1]], values[alone], owner[alone]
            cut, cut_twice = (np.searchsorted(sample.range_of(x), np.arange(sample.ranges + 1)) for x in (single, twice))
            names, counts, alones, twices = [], [], [], []
            for p in range(sample.ranges):
                lo, hi = cut[p], cut[p + 1]
                by = np.argsort(of[lo:hi], kind="stable")
                who, n = np.unique(of[lo:hi], return_counts=True)
                names.append(ids[who])
                counts.append(n)
                alones.append(sample.packed(single[lo:hi][by]))
                twices.append(sample.packed(twice[cut_twice[p]: cut_twice[p + 1]]))
            # What is known already goes along with one of the ranges.
            told, at = np.flatnonzero(known), int(ids[0]) % sample.ranges if len(ids) else 0
            none = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(sample.ranges), pa.int32()), _lists(names, pa.int64()), _lists(counts, pa.int32()), pa.array(alones, pa.binary()), pa.array(twices, pa.binary()),
                 _lists([ids[told] if p == at else none for p in range(sample.ranges)], pa.int64()),
                 _lists([known[told] if p == at else none for p in range(sample.ranges)], pa.int32())],
                ["p", "ids", "n", "alone", "twice", "told", "known"])

    def meet(table: pa.Table) -> pa.Table:
        flat = {c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "n", "told", "known")}
        single, twice = (sample.unpacked(b"".join(table.column(c).to_pylist())) for c in ("alone", "twice"))
        owner = np.repeat(flat["ids"], flat["n"])
        order = np.argsort(single, kind="stable")
        single, owner = single[order], owner[order]
        same = single[1:] == single[:-1]
        shared = np.concatenate((same, np.zeros(min(1, len(single)), bool))) | np.concatenate((np.zeros(min(1, len(single)), bool), same)) | np.isin(single, twice)
        who, n = np.unique(owner[shared], return_counts=True)
        return pa.table({"doc_id": pa.array(np.concatenate((who, flat["told"])), pa.int64()), "shared": pa.array(np.concatenate((n, flat["known"])), pa.int64())})

    dealt = parts.select("doc_id", "part").mapInArrow(
        deal, "p int, ids array<long>, n array<int>, alone binary, twice binary, told array<long>, known array<int>")
    return dealt.groupBy("p").applyInArrow(meet, "doc_id long, shared long").groupBy("doc_id").agg(F.sum("shared").alias("shared"))


def keyed(texts: DataFrame, words: int, num: int, den: int, documents: int) -> DataFrame:
    """Per row: doc_id, set size, and per band: number, bucket keys, bit row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            ids, raw = batch.column(0), batch.column(1).to_pylist()
            for begin, block, count in blocks(raw):
                size, per, band, keys, bits = [], [], [], [], []
                for i in range(count):
                    s = shingle_hashes(block.hash[block.first[i]: block.first[i + 1]], words)
                    found = schemes(len(s), num, den)
                    size.append(len(s))
                    per.append(len(found))
                    for j, high in found:
                        exact, loose = allocation(high, num, den, documents)
                        band.append(j)
                        keys.append(signatures(s, j, exact, loose))
                        bits.append(parities(s, exact, loose))
                inner = pa.StructArray.from_arrays([pa.array(band, pa.int32()), _lists(keys, pa.int64()), _lists(bits, pa.int64())], ["band", "keys", "bits"])
                outer = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([ids.slice(begin, count), pa.array(size, pa.int64()), outer], ["doc_id", "n_shingles", "bands"])

    return texts.mapInArrow(run, "doc_id long, n_shingles long, bands array<struct<band:int,keys:array<long>,bits:array<long>>>")


def near_enough(num: int, den: int) -> Column:
    """Bound on rows (n_a, bits_a, n_b, bits_b): similar sets differ in at most (n_a + n_b)(den - num)/(den + num) elements."""
    differing = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return differing * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)


def text_set(text: str | None, words: int) -> set:
    """The exact shingle set of a text, as tuples of words."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return set(zip(*[w[i:] for i in range(words)])) if len(w) >= words else {tuple(w)} if w else set()


_TABLE = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose texts pass the exact test. The text of an ``a`` of many pairs goes to several tasks."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_SLICE).cast("int").alias("shares"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).join(shares, "a")
    left = left.select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), "shares").cast("int").alias("share"))
    rows = (
        dealt.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(left, ["a", "share"]).select("a", "b", "text_a", "text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_set = None, set()
        for batch in slices(batches):
            keep = []
            for text_a, text_b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if text_a != held:
                    held, held_set = text_a, text_set(text_a, words)
                other = text_set(text_b, words)
                both = len(held_set & other)
                keep.append(both > 0 and den * both >= num * (len(held_set) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                       num: int = NUM, den: int = DEN, hub_rounds: int = 4,
                       expected: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id: exact components of the links ``den * |A & B| >= num * |A | B|``.

    ``expected`` stands for the number of documents where hashes and segments are chosen; by default they are counted.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = Sample(docs.count() if expected is None else expected, num, den)
    rows = staged(sketch(docs, words, sample), "sketch")
    some = rows.filter("doc_id is not null and n_shingles > 0")
    # Equal sets collapse to their smallest id before anything is compared.
    equal = some.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    equal = staged(equal, "classes")
    # A rep goes on if enough of its sampled elements stand in other sets; one with few elements in the sample always does.
    parts = some.join(equal.select(F.col("rep").alias("doc_id"), "d1", "d2", "n_shingles"), ["doc_id", "d1", "d2", "n_shingles"], "left_semi")
    least = F.col("n_part") - F.floor(F.col("n_shingles") * (den - num) / den)
    counted = staged(shared_counts(parts, sample), "shared")
    able = some.select("doc_id", least.alias("least")).join(counted, "doc_id", "left").filter(F.coalesce("shared", F.lit(0)) >= F.col("least"))
    able = able.join(equal.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id").distinct()
    docs = staged(docs.join(able, "doc_id", "left_semi"), "able")
    chosen = staged(keyed(docs, words, num, den, docs.count() if expected is None else expected), "keys")
    release(counted)
    chosen = chosen.select("doc_id", "n_shingles", F.explode("bands").alias("b"))
    keys = chosen.select("doc_id", F.col("b.band").alias("band"), F.explode("b.keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    member = staged(keys.join(shared.select("key", "lo"), "key"), "buckets")
    some_bits = chosen.select("doc_id", F.col("b.band").alias("band"), F.col("n_shingles").alias("n"), F.col("b.bits").alias("bits"))
    bits = staged(some_bits.join(member.select("doc_id", "band").distinct(), ["doc_id", "band"], "left_semi"), "bits")

    def side(name: str) -> DataFrame:
        return bits.select(F.col("doc_id").alias(name), "band", F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))

    def passing(pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b, band) within the bound."""
        return pairs.distinct().join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"]).filter(near_enough(num, den)).select("a", "b").distinct()

    tested = staged(passing(member.filter("doc_id <> lo").select(F.col("lo").alias("a"), F.col("doc_id").alias("b"), "band")), "pairs")
    links = staged(verified(tested, docs, words, num, den), "links")
    for round_ in range(hub_rounds + 1):
        root = components(links)
        member = (
            member.select("key", "band", "doc_id").join(root.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
            .select("key", "band", "doc_id", F.coalesce("root", "doc_id").alias("root")))
        mixed = member.groupBy("key").agg(
            F.min("root").alias("x"), F.max("root").alias("y"),
            F.min_by("doc_id", F.xxhash64("doc_id", F.lit(round_))).alias("hub"), F.count("*").alias("n")).filter("x < y")
        # Only buckets that still hold several components go on.
        member = staged(member.join(mixed.select("key", "hub", "n"), "key"), "buckets")
        sizes = member.groupBy("key", "n", "root").agg(F.count("*").alias("own"))
        left, held = sizes.agg(F.sum(F.col("own") * (F.col("n") - F.col("own"))) / 2, F.sum("own")).first()
        if not left:
            break
        last = left <= PAIRS_PER_MEMBER * held or round_ == hub_rounds
        if last:
            # A large bucket is cut into slices; each member meets each slice of the other side in a task of its own.
            placed = member.select("key", "band", "doc_id", "root", F.ceil(F.col("n") / BUCKET_SLICE).cast("int").alias("cuts")).join(bits, ["doc_id", "band"])
            x, y = (placed.select("key", F.col("doc_id").alias(s), F.col("root").alias(f"root_{s}"), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"),
                                  F.pmod(F.xxhash64("doc_id"), "cuts").cast("int").alias(f"cut_{s}"),
                                  F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut_b" if s == "a" else "cut_a")) for s in "ab")
            pairs = x.join(y, ["key", "cut_a", "cut_b"]).filter((F.col("root_a") < F.col("root_b")) & near_enough(num, den)).select("a", "b")
        else:
            hubs = root.select(F.col("node").alias("hub"), F.col("root").alias("of"))
            pairs = member.filter("doc_id <> hub").join(hubs, "hub", "left").filter(F.coalesce("of", "hub") != F.col("root"))
            pairs = passing(pairs.select(F.col("hub").alias("a"), F.col("doc_id").alias("b"), "band"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fresh = staged(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(fresh)
        links = staged(links.union(verified(fresh, docs, words, num, den)), "links")
        if last:
            break
    root = components(links.union(_clashes(some, equal)))
    reps = equal.join(root.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        "d1", "d2", "n_shingles", F.coalesce("root", "rep").alias("component"))
    empty = rows.filter("doc_id is null or n_shingles = 0").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("component_id"))
    return some.join(reps, ["d1", "d2", "n_shingles"]).select("doc_id", "n_shingles", F.col("component").alias("component_id")).union(empty)


def _clashes(some: DataFrame, equal: DataFrame) -> DataFrame:
    """Links between the classes of an id that stands on rows with different sets; none when ids are unique."""
    twice = some.groupBy("doc_id").agg(F.count_distinct("d1", "d2").alias("k")).filter("k > 1").select("doc_id")
    rows = some.join(twice, "doc_id", "left_semi").join(equal, ["d1", "d2", "n_shingles"])
    return rows.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
