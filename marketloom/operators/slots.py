"""Reference documents per (dimension, category) slot: classification, selection, merge, summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.ordering import top_per_key
from marketloom.operators.tournament import Judge, best_two

# The slot grid with the position of each category on its dimension.
GRID = (
    ("supply", "restrict", -100), ("supply", "reduce", -50), ("supply", "increase", 50), ("supply", "expand", 100),
    ("demand", "restrict", -100), ("demand", "reduce", -50), ("demand", "increase", 50), ("demand", "expand", 100),
    ("policy_strength", "informational", 0), ("policy_strength", "encouraged", 33),
    ("policy_strength", "binding", 67), ("policy_strength", "mandatory", 100),
)

# Inner category a runner-up of the outer one may fill.
ADJACENT = {"restrict": "reduce", "expand": "increase"}

SLOT = ["dimension", "category"]


def grid(spark: SparkSession) -> DataFrame:
    """The twelve slots; the one table here small enough by definition to be broadcast."""
    return spark.createDataFrame(list(GRID), "dimension string, category string, position int")


def direction_category(value: Column, outer: float = 75.0) -> Column:
    return (
        F.when(value <= -outer, "restrict").when(value < 0, "reduce").when(value < outer, "increase").otherwise("expand"))


def strength_category(value: Column) -> Column:
    return (
        F.when(value > 75, "mandatory").when(value > 50, "binding").when(value > 25, "encouraged").otherwise("informational"))


def classify(df: DataFrame) -> DataFrame:
    """One row per document and dimension with its category and the score that decides between candidates."""
    s, d, p = F.col("supply"), F.col("demand"), F.col("strength")
    rows = F.array(
        F.struct(F.lit("supply").alias("dimension"), direction_category(s).alias("category"), F.abs(s).alias("score")),
        F.struct(F.lit("demand").alias("dimension"), direction_category(d).alias("category"), F.abs(d).alias("score")),
        F.struct(F.lit("policy_strength").alias("dimension"), strength_category(p).alias("category"), p.alias("score")))
    return df.select("*", F.inline(rows))


def best_per_slot(candidates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Highest score per slot and group, the lowest id on a tie; an aggregate, so a crowded slot combines map-side."""
    return candidates.groupBy(*keys, *SLOT).agg(
        F.min(F.struct((-F.col("score")).alias("order"), "doc_id")).alias("_best")
    ).select(*keys, *SLOT, F.col("_best.doc_id").alias("doc_id"), (-F.col("_best.order")).alias("score"))


def merged_slots(candidates: DataFrame, judge: Judge | None = None) -> DataFrame:
    """All twelve slots: the best candidate, else the runner-up of the adjacent outer slot, else empty.

    The top two of a slot, by score or by a judge of pairs, offer themselves to their own slot and, as runner-up, to the
    adjacent inner one.
    """
    rows = candidates.select(*SLOT, "doc_id", "score")
    ranked = best_two(rows, SLOT, ["doc_id"], judge) if judge else top_per_key(rows, SLOT, [F.desc("score"), F.asc("doc_id")], 2)
    inner = F.create_map(*[F.lit(x) for kv in ADJACENT.items() for x in kv])
    second = (F.col("rank") == 2) & (F.col("dimension") != "policy_strength")
    offers = F.array_compact(F.array(
        F.when(F.col("rank") == 1, F.struct("category", F.lit(0).alias("via"))),
        F.when(second & F.col("category").isin(*ADJACENT), F.struct(F.try_element_at(inner, F.col("category")).alias("category"), F.lit(1).alias("via")))))
    chosen = (
        ranked.select("dimension", "doc_id", "score", F.explode(offers).alias("o"))
        .groupBy("dimension", F.col("o.category").alias("category"))
        .agg(F.min(F.struct(F.col("o.via").alias("_via"), "doc_id", "score")).alias("_c")))
    filled = grid(candidates.sparkSession).join(chosen, SLOT, "left")
    return filled.select(
        *SLOT, "position", F.col("_c.doc_id").alias("doc_id"), F.col("_c.score").alias("score"),
        F.when(F.col("_c").isNull(), "empty").otherwise("filled").alias("status"),
        (F.coalesce(F.col("_c._via"), F.lit(0)) == 1).alias("adapted"))


def fill_summary(slots: DataFrame) -> DataFrame:
    filled = F.count_if(F.col("status") == "filled")
    return slots.agg(
        F.count("*").alias("total_slots"), filled.alias("filled"), (F.count("*") - filled).alias("empty"),
        (100 * F.try_divide(filled, F.count("*"))).alias("fill_rate"))


def _by(field: str):
    return lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0)


def nested_json(slots: DataFrame, document: Sequence[str]) -> DataFrame:
    """One JSON object dimension → category → status and document (null when empty); twelve entries in all."""
    entry = F.struct("status", F.when(F.col("status") == "filled", F.struct(*document)).alias("document"))
    inner = F.array_sort(F.collect_list(F.struct("category", entry.alias("e"))), _by("category"))
    per_dimension = slots.groupBy("dimension").agg(F.map_from_entries(inner).alias("categories"))
    outer = F.array_sort(F.collect_list(F.struct("dimension", "categories")), _by("dimension"))
    return per_dimension.groupBy().agg(F.to_json(F.map_from_entries(outer), {"ignoreNullFields": "false"}).alias("value"))


def read_nested_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Slots of a nested JSON, with the document under ``document`` or directly under the category."""
    doc = "struct<doc_id: long, score: double>"
    entry = f"map<string, map<string, struct<status: string, document: {doc}, doc_id: long, score: double>>>"
    wide = df.select(F.explode(F.from_json(column, entry)).alias("dimension", "categories"))
    return wide.select("dimension", F.explode("categories").alias("category", "e")).select(
        *SLOT, F.coalesce("e.document.doc_id", "e.doc_id").alias("doc_id"), F.coalesce("e.document.score", "e.score").alias("score"))


def replies(df: DataFrame, column: str) -> DataFrame:
    """(dimension, category) pairs of a JSON reply that exist on the grid; malformed replies give no row."""
    schema = "struct<classifications: array<struct<dimension: string, category: string>>>"
    pairs = df.withColumn("_r", F.from_json(column, schema)).select(
        *[c for c in df.columns if c != column], F.inline("_r.classifications"))
    return pairs.join(grid(df.sparkSession), SLOT, "left_semi")
