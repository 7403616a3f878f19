"""Mixing sources to target weights by hierarchical budgets.

A token budget runs down a tree of levels (domain, language, source): each node deals its budget among its children in
proportion to their weights, a child whose documents cannot fill its share (at most ``max_epochs`` passes) takes what it
can, and its shortage goes to its siblings. Only when all siblings are full does the rest return to their parent, whose
own capacity already counts it, and so to the parent's siblings. Each leaf then takes documents in a seeded order of its
own, whole epochs first, then the prefix that fits the remaining tokens.

Tokens are words of non-white-space characters. The tree is summed to one row per leaf before anything is ordered. A
leaf may hold a third of all rows: the prefix is cut by range partitions with carried totals, never in one task.

Defined cases: null and empty texts have 0 tokens, and are taken whenever their place in the order is reached; a null
level is a node of its own; nodes without a given weight get the default; repeated rows are taken one by one, ties
of the order (repeated ids) in the order of their text's digest; a node of weight 0 gets only what its siblings cannot take; an empty table gives no rows; a budget above all capacity takes
everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import staged, words_of

#: Share of the available tokens that the mixture takes, and the weights of nodes by level (per mille).
BUDGET_SHARE, MAX_EPOCHS, SEED, DEFAULT_WEIGHT = 0.6, 2, 17, 100
WEIGHTS = {"lang": {"en": 400, "de": 200, "fr": 200, "es": 200}}


def domain_of(source: Column) -> Column:
    """Domain of a source name in the driver's tables: the last digit's class modulo 3; names without one share a domain."""
    digit = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]+)$", 1)
    return F.concat(F.lit("domain"), F.when(digit == "", F.lit("")).otherwise((F.right(digit, F.lit(1)).cast("int") % 3).cast("string")))


def _weight(level: str, weights: dict[str, dict[str, int]], default: int) -> Column:
    out = F.lit(default)
    for name, value in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(value)).otherwise(out)
    return out.cast("long")


def water_fill(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Adds ``granted``: the share of ``budget`` (of the parent, whole tokens) for each child with ``weight`` and ``capacity``.

    A child is full when giving all siblings as much per weight as it can hold stays within the budget.
    """
    group = Window.partitionBy(*parent)
    order = group.orderBy("_fill", F.col(name).asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # What weighs nothing is filled last: it gets what its siblings cannot take.
    ranked = nodes.withColumn("_fill", F.when(F.col("weight") > 0, F.col("capacity") / F.nullif(F.col("weight"), F.lit(0))).otherwise(F.lit(float("inf"))))
    ranked = ranked.withColumn("_held", F.sum("capacity").over(upto)).withColumn(
        "_others", F.sum("weight").over(group) - F.sum("weight").over(upto))
    rest = F.when(F.col("_others") > 0, F.col("_fill") * F.col("_others")).otherwise(F.lit(0.0))
    ranked = ranked.withColumn("_full", F.col("_held") + rest <= F.col("budget"))
    spent = F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(group), F.lit(0))
    weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group)
    # Among children without weight alone, each takes what those before it in the order have left.
    left = F.col("budget") - spent
    before = F.coalesce(F.sum(F.when(~F.col("_full"), F.col("capacity"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.when(weight > 0, F.floor(left / F.nullif(weight, F.lit(0)) * F.col("weight"))).otherwise(F.greatest(F.lit(0), left - before))
    return ranked.withColumn("granted", F.when(F.col("_full"), F.col("capacity")).otherwise(F.least("capacity", share)).cast("long")).drop(
        "_fill", "_held", "_others", "_full")


def budgets(leaves: DataFrame, levels: Sequence[str], budget: Column, weights: dict[str, dict[str, int]],
            max_epochs: int, default: int = DEFAULT_WEIGHT) -> DataFrame:
    """Leaves (levels, tokens, budget columns) with their granted tokens; ``budget`` is the root's."""
    nodes = leaves.withColumn("budget", budget.cast("long")).withColumn("_leaf", F.col("tokens") * max_epochs)
    for depth, level in enumerate(levels):
        parent = list(levels[:depth])
        # The nodes of this depth, one row each, under the budget their parent got.
        here = nodes.groupBy(*parent, level).agg(F.sum("_leaf").alias("capacity"), F.min("budget").alias("budget"))
        here = here.withColumn("weight", _weight(level, weights, default))
        keys = [*parent, level]
        filled = water_fill(here, parent or [F.lit(0)], level).select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("granted").alias("_granted"))
        nodes = nodes.join(filled, _same(keys)).drop("budget", *[f"{k}_" for k in keys]).withColumnRenamed("_granted", "budget")
    return nodes.drop("_leaf").withColumnRenamed("budget", "granted")


def mixed(documents: DataFrame, levels: dict[str, Column], text_col: str = "text", id_col: str = "doc_id",
          weights: dict[str, dict[str, int]] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS,
          seed: int = SEED) -> DataFrame:
    """Per row: doc_id, levels, n_tokens, digest of the text, and epochs, the times the row is taken (0: not at all)."""
    names = list(levels)
    keys = [f"_level{i}" for i in range(len(names))]
    text = F.col(text_col).cast("string")
    rows = staged(documents.select(
        F.col(id_col).alias("_id"), *[c.alias(k) for k, c in zip(keys, levels.values())],
        F.size(words_of(text)).cast("long").alias("_tokens"), F.md5(F.coalesce(text, F.lit(""))).alias("_digest")), "tokens")
    leaves = staged(rows.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    granted = budgets(leaves, keys, F.lit(int(total * budget_share)), {k: weights.get(n, {}) for k, n in zip(keys, names)}, max_epochs)
    some = F.col("tokens") > 0
    granted = granted.select(
        *[F.col(k).alias(f"{k}_") for k in keys],
        F.when(some, F.floor(F.col("granted") / F.col("tokens"))).otherwise(F.lit(max_epochs)).alias("_full"),
        F.when(some, F.col("granted") % F.col("tokens")).otherwise(F.lit(0)).alias("_rest"))
    # The epoch that is cut has its own seed, and so its own order of the leaf.
    epoch = rows.join(granted, _same(keys)).withColumn("_order", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("_full").cast("string"), F.col("_id").cast("string"))))
    order = [*keys, "_order", "_id", "_digest"]
    placed = staged(epoch.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "mixing")
    placed = placed.drop(*[f"{k}_" for k in keys]).withColumn("_part", F.shiftright("_place", 33))
    parts = placed.groupBy(*keys, "_part").agg(F.sum("_tokens").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_part").alias("_part_"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    running = Window.partitionBy("_part", *keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("_tokens").over(running)
    more = F.when((upto <= F.col("_rest")) & (F.col("_full") < max_epochs), 1).otherwise(0)
    return placed.join(parts, _same([*keys, "_part"])).select(
        F.col("_id").alias("doc_id"), *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_tokens").alias("n_tokens"),
        F.col("_digest").alias("digest"), (F.col("_full") + more).cast("long").alias("epochs"))


def _same(keys: Sequence[str]) -> Column:
    """Null-safe equality of columns with those of the same names and a trailing underscore."""
    condition = F.col(keys[0]).eqNullSafe(F.col(f"{keys[0]}_"))
    for k in keys[1:]:
        condition = condition & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return condition


def taken_documents(documents: DataFrame, levels: dict[str, Column], text_col: str = "text", id_col: str = "doc_id", **kwargs) -> DataFrame:
    """The rows the mixture takes, with all their columns, once per epoch; rows of equal id and text are taken alike."""
    taken = mixed(documents, levels, text_col, id_col, **kwargs).groupBy("doc_id", "digest").agg(F.max("epochs").cast("int").alias("_epochs"))
    taken = taken.filter("_epochs > 0").select(F.col("doc_id").alias("_id_"), F.col("digest").alias("_digest_"), "_epochs")
    packed = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), F.col(id_col).alias("_id"),
        F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_digest"))
    return packed.join(taken, _same(["_id", "_digest"])).select("_row", F.explode(F.sequence(F.lit(1), F.col("_epochs")))).select("_row.*")
