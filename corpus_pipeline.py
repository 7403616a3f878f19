"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixture, shards.

Each stage reads what the one before it kept, written as Parquet; all but the last return the columns of documents. Rows
that share a doc_id stay or go together in the near-duplicate stage, rows without one stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import contamination, jaccard, mixing, quality, sharding
from marketloom.llm.common import staged
from marketloom.llm.queries import mixing_levels


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked documents stays: five-word shingles, 0.8 in common."""
    gone = staged(jaccard.jaccard_components(docs, words=5, num=80, den=100).filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One pass over each source at most, so no document is repeated."""
    return mixing.taken_documents(docs, mixing_levels(), max_epochs=1)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal texts are gone by now; what still links documents is their source and the long passages they share."""
    source = F.when(F.col("source").isNotNull(), F.array(F.xxhash64("source")))
    return sharding.sharded(docs, links=F.concat(sharding.passage_links(F.col("text")), F.coalesce(source, F.array().cast("array<bigint>"))))


STAGES = [("quality rules", keep_quality), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_contaminated),
          ("mixing sources to target weights", mix), ("sharding", shard)]

#: Label propagation and range partitions have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    return docs
