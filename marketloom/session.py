"""Session defaults and the shared folder that cuts long lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "marketloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator here relies on (UTC, AQE, skew-join split)."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: the cluster's ``spark.checkpoint.dir``.

    A temporary folder stands in only on a local master, where driver and executors share one disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="marketloom-")
    context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for a subtree that several branches of one plan read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def allow_charsets(spark: SparkSession) -> None:
    """Let text scans use the national charsets of the source files, which Spark 4 accepts only on request."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
