"""Fingerprints and unit identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.hashing import content_hash, namespace_key, unit_id
from waymark.schema import CHUNK_COLUMNS


def fingerprints(corpus: DataFrame) -> DataFrame:
    """One row per path with its content hash and times; keyed by path, so copies stay apart."""
    return corpus.select(
        "path",
        content_hash(F.col("content")).alias("file_hash"),
        F.col("mtime").alias("file_mtime"),
        F.col("ctime").alias("file_ctime"),
    )


def identify(units: DataFrame) -> DataFrame:
    """Extracted units to the chunk table: adds `chunk_hash` and `id`."""
    return (
        units.withColumn("chunk_hash", content_hash(F.col("content")))
        .withColumn("id", unit_id())
        .select(*CHUNK_COLUMNS)
    )


def with_namespace(df: DataFrame, root: str, provider: str) -> DataFrame:
    """Add the namespace column computed from a root-path column."""
    return df.withColumn("namespace", namespace_key(F.col(root), provider))
