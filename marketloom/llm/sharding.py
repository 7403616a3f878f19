"""Sharding by balanced label propagation.

Documents are linked through groups: equal texts, and any further groups the caller names in ``links``, of which a document
may have several. Every member of a group is a neighbour of every other. Rows of one text are interchangeable, so a round
works on one counted row per text and shard: it tallies each group's members by shard, adds up the tallies of a text's
groups (each as a share of its group) and moves the text's rows towards the shard that holds most of its neighbours. A
shard takes no more than its quota: what moves is accepted in levels of gain, against the room left and what leaves in
exchange. Texts with more rows than a shard's quota by the number of shards are few; they are dealt to whole shards first.
Rows without links come last and fill what is left. The rows then go where the rounds put them; only what exceeds a
shard's quota is passed on, from the end of its order, to shards with room: counts differ by one at most.

No hot group is ever gathered, and no pairs are made: a group of more than one in ``HOT`` rows is joined from a table
of at most that many groups for each group a document has, all others are small.

Defined cases: null text counts as empty, and as a copy of empty texts; null ids come first; repeated rows get their own
slots; null links are none; fewer rows than shards leave shards empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import ascii_lower, staged, words_of

SHARDS, ROUNDS = 16, 4
HOT, LEVELS, GAINS = 500, 64, 4
#: Words of the shortest passage that links its documents.
PASSAGE = 50


def _draw(*cols) -> Column:
    """A number in [0, 1) fixed by the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def passage_links(text: Column) -> Column:
    """Hashes of the lines of at least ``PASSAGE`` words, in lower case and with single blanks."""
    lines = F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1), lambda x: words_of(ascii_lower(x)))
    return F.transform(F.filter(lines, lambda w: F.size(w) >= PASSAGE), lambda w: F.xxhash64(F.array_join(w, " ")))


def accepted(asks: list[tuple[int, int, int, int]], load: list[int], quota: int) -> dict[tuple[int, int], int]:
    """Least level that moves, by (from, to), for asks (from, to, level, rows).

    No shard ends above its quota, or above what it holds where that is more.
    """
    shards = range(len(load))
    want: dict[tuple[int, int], dict[int, int]] = {}
    for s, t, level, n in asks:
        want.setdefault((s, t), {})[level] = n
    total = {k: sum(v.values()) for k, v in want.items()}
    asked = [sum(n for (_, t), n in total.items() if t == shard) for shard in shards]
    moved: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (s, t), levels in want.items():
        swap = min(total[s, t], total.get((t, s), 0))
        most = swap + max(0, quota - load[t]) * (total[s, t] - swap) // max(1, asked[t])
        held = 0
        for level in sorted(levels, reverse=True):
            if held + levels[level] > most:
                break
            held += levels[level]
            moved.setdefault((s, t), []).append((level, levels[level]))
    while True:
        size = list(load)
        for (s, t), levels in moved.items():
            n = sum(n for _, n in levels)
            size[s] -= n
            size[t] += n
        over = [t for t in shards if size[t] > max(quota, load[t])]
        if not over:
            return {k: v[-1][0] for k, v in moved.items()}
        # What came in last goes back, least gain first.
        k = min((k for k in moved if k[1] == over[0]), key=lambda k: (moved[k][-1][0], k))
        moved[k].pop()
        if not moved[k]:
            del moved[k]


def dealt(counts: dict[bytes, dict[int, int]], shards: int, quota: int) -> dict[bytes, dict[int, int]]:
    """Rows by shard of the largest groups: largest first, each fills the shards that hold most of it."""
    room = [quota] * shards
    out = {}
    for group, held in sorted(counts.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        rest, out[group] = sum(held.values()), {}
        # A group that fits into one shard is not cut.
        for t in sorted(range(shards), key=lambda t: (-min(room[t], rest), -held.get(t, 0), t)):
            n = min(room[t], rest)
            if n:
                out[group][t] = n
                room[t] -= n
                rest -= n
        if rest:
            raise ValueError("quotas are smaller than the rows")
    return out


def propagate(cells: DataFrame, members: list[DataFrame], fixed: list[int], quota: int, shards: int, rounds: int) -> DataFrame:
    """(group, fixed, shard, rows) after some rounds of balanced moves.

    ``members`` are (group, key, n), hot keys apart from the others; ``fixed`` are the rows by shard that do not move.
    """
    places = [F.lit(s) for s in range(shards)]
    for round_ in range(rounds):
        scores = []
        for part in members:
            tally = staged(part.join(cells, "group").groupBy("key", "n").agg(F.array(*[
                F.sum(F.when(F.col("shard") == s, F.col("rows")).otherwise(0)) for s in range(shards)]).alias("held")), "tallies")
            # Half a row, fixed by group and shard, decides ties alike for all members.
            share = [(F.get("held", s) + 0.5 * _draw("key", s)) / F.col("n") for s in places]
            scores.append(part.join(tally.select("key", F.array(*share).alias("share")), "key").select("group", "share"))
        votes = scores[0].union(scores[1]).groupBy("group").agg(F.array(*[F.sum(F.get("share", s)) for s in places]).alias("score"))
        closed = [s for s in range(shards) if fixed[s] >= quota]
        score = F.array(*[F.lit(-1.0) if s in closed else F.get("score", F.lit(s)) for s in range(shards)])
        ranked = cells.join(votes.select("group", score.alias("score")), "group", "left").withColumn(
            "best", F.when(~F.col("fixed"), F.array_position("score", F.array_max("score")).cast("int") - 1))
        gain = F.array_max("score") - F.get("score", F.col("shard"))
        level = F.least(F.lit(GAINS - 1), F.floor(GAINS * gain)) * LEVELS + F.floor(LEVELS * _draw(F.lit(round_), "group"))
        ranked = staged(ranked.select(
            "group", "fixed", "shard", "rows", F.when(gain > 0, F.col("best")).alias("best"), level.cast("int").alias("level")), "labels")
        load = [0] * shards
        for s, n in ranked.groupBy("shard").agg(F.sum("rows")).collect():
            load[s] = n
        # Shards squared by levels at most.
        asks = ranked.filter("best <> shard").groupBy("shard", "best", "level").agg(F.sum("rows")).collect()
        cut = accepted([tuple(r) for r in asks], load, quota)
        if not cut:
            break
        least = F.create_map(*[F.lit(x) for (s, t), v in cut.items() for x in (s * shards + t, v)])
        moves = F.coalesce(F.col("level") >= F.try_element_at(least, F.col("shard") * shards + F.col("best")), F.lit(False))
        cells = staged(ranked.withColumn("shard", F.when(moves, F.col("best")).otherwise(F.col("shard")))
                       .groupBy("group", "fixed", "shard").agg(F.sum("rows").alias("rows")), "labels")
    return cells


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds _at, the place of each row in the order of the whole table, from 0."""
    placed = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "shards")
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_rows")).withColumn("_all", F.lit(0))
    # One row per partition.
    before = Window.partitionBy("_all").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return placed.join(parts, "_part").withColumn("_at", F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place", "_part", "_before")


def _labelled(docs: DataFrame, cells: DataFrame, kind: int) -> DataFrame:
    """Rows with their label: the rows of a group take its shards by running totals; ``start`` where it has no cells."""
    held = cells.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("shard", "rows"))).alias("c"))  # one entry per shard at most
    upto = F.transform("c", lambda x, i: F.struct(
        x["shard"].alias("shard"), F.aggregate(F.slice("c", 1, i + 1), F.lit(0).cast("long"), lambda t, y: t + y["rows"]).alias("upto")))
    joined = staged(docs.join(staged(held.select("group", upto.alias("c")), "cells"), "group", "left"), "labelled")
    names = ["group", "doc_id", "size", "text_crc32"]
    whole = joined.filter("c is null or size(c) = 1").select(
        *names, F.coalesce(F.get("c", F.lit(0))["shard"], F.col("start")).alias("label"), F.when(F.col("c").isNull(), 2).otherwise(kind).alias("kind"))
    cut = _placed(joined.filter("size(c) > 1").drop("start"), names)
    first = staged(cut.groupBy("group").agg(F.min("_at").alias("first")), "cells")
    at = cut.join(first, "group").withColumn("k", F.col("_at") - F.col("first"))
    return whole.union(at.select(*names, F.expr("filter(c, x -> k < x.upto)[0].shard").alias("label"), F.lit(kind).alias("kind")))


def _repaired(size: list[int]) -> tuple[Column, Column]:
    """Shard and slot of the row at ``_at`` in the order of ``label``: what exceeds a shard's target goes where room is."""
    shards = len(size)
    base, rest = divmod(sum(size), shards)
    more = set(sorted(range(shards), key=lambda s: (-size[s], s))[:rest])
    target = [base + (s in more) for s in range(shards)]
    place = F.col("_at") - F.get(F.array(*[F.lit(sum(size[:s])).cast("long") for s in range(shards)]), F.col("label"))
    passed = place - F.get(F.array(*[F.lit(target[s] - sum(max(0, size[i] - target[i]) for i in range(s))).cast("long") for s in range(shards)]), F.col("label"))
    stays = place < F.get(F.array(*[F.lit(t).cast("long") for t in target]), F.col("label"))
    shard, slot, upto = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    free = [(t, target[t] - size[t]) for t in range(shards) if size[t] < target[t]]
    for t, n in reversed(free):
        upto = sum(m for u, m in free if u < t)
        shard = F.when(passed < upto + n, F.lit(t)).otherwise(shard)
        slot = F.when(passed < upto + n, passed - upto + size[t]).otherwise(slot)
    return F.when(stays, F.col("label")).otherwise(shard), F.when(stays, place).otherwise(slot)


def sharded(documents: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text",
            links: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group digest; law ``rows``: counts at most one apart.

    ``links`` is an array of whole numbers, the groups a row belongs to besides that of its text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = F.array().cast("array<bigint>") if links is None else F.coalesce(links, F.array().cast("array<bigint>"))
    docs = staged(documents.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("group"), F.pmod(F.xxhash64(id_col, text_col), F.lit(shards)).cast("int").alias("start"), named.alias("links")), "shards")
    total = docs.count()
    quota = -(-total // shards)
    rows = docs.drop("links")
    counts = docs.groupBy("group", F.col("start").alias("shard")).agg(F.count("*").alias("rows"))
    own = docs.groupBy("group").agg(F.count("*").alias("m"))
    # The largest groups, at most shards squared.
    large = staged(own.filter(F.col("m") * shards > quota).filter("m > 1").select("group"), "large")
    keys = own.filter("m > 1").select("group", F.xxhash64("group").alias("key"), "m")
    if links is not None:
        keys = keys.union(docs.select("group", F.explode(F.array_distinct("links")).alias("key")).filter("key is not null")
                          .groupBy("group", "key").agg(F.count("*").alias("m")))
    keys = staged(keys, "keys")
    groups = staged(keys.groupBy("key").agg(F.sum("m").alias("n"), F.count("*").alias("texts")).filter("n > 1"), "groups")
    hot = staged(groups.filter(F.col("texts") * HOT > total), "groups")
    mild = groups.filter(F.col("texts") * HOT <= total)
    members = [staged(keys.join(hot.select("key", "n"), "key").select("group", "key", "n"), "members"),
               staged(keys.join(hot, "key", "left_anti").join(mild.select("key", "n"), "key").select("group", "key", "n"), "members")]
    linked = members[0].select("group").union(members[1].select("group")).distinct()
    cells = counts.join(linked, "group", "left_semi")
    fixed = [0] * shards
    if rounds:
        held: dict[bytes, dict[int, int]] = {}
        for g, s, n in counts.join(large, "group", "left_semi").collect():
            held.setdefault(bytes(g), {})[s] = n
        plan = [(bytearray(g), True, t, n) for g, part in dealt(held, shards, quota).items() for t, n in part.items()]
        for _, _, t, n in plan:
            fixed[t] += n
        kind = "group binary, fixed boolean, shard int, rows long"
        moving = cells.join(large, "group", "left_anti").select("group", F.lit(False).alias("fixed"), "shard", "rows")
        cells = propagate(staged(moving.union(documents.sparkSession.createDataFrame(plan, kind)), "labels"), members, fixed, quota, shards, rounds)
    cells = staged(cells.select("group", "shard", "rows"), "labels")
    labelled = _labelled(rows.join(large, "group", "left_semi"), cells.join(large, "group", "left_semi"), 0).union(
        _labelled(rows.join(large, "group", "left_anti"), cells.join(large, "group", "left_anti"), 1))
    placed = _placed(labelled, ["label", "kind", "group", "doc_id", "size", "text_crc32"])
    size = [0] * shards
    for s, n in placed.groupBy("label").agg(F.count("*")).collect():
        size[s] = n
    shard, slot = _repaired(size)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.hex("group").alias("text_group"))
