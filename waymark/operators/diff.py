"""Difference between the local chunk table and an index, and its application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upload_set(local: DataFrame, index: DataFrame) -> DataFrame:
    """Local rows whose id is not in the index."""
    return local.join(index.select("id"), "id", "left_anti")


def delete_set(local: DataFrame, index: DataFrame) -> DataFrame:
    """Index rows whose id is not local."""
    return index.join(local.select("id"), "id", "left_anti")


def stale_paths(deletes: DataFrame) -> DataFrame:
    return deletes.select("path").distinct()


def rows_on_paths(index: DataFrame, paths: DataFrame) -> DataFrame:
    """Every index row on the given paths, stale or not."""
    return index.join(paths.select("path").distinct(), "path", "left_semi")


def drop_paths(index: DataFrame, paths: DataFrame) -> DataFrame:
    """The index without any row on the given paths."""
    return index.join(paths.select("path").distinct(), "path", "left_anti")


def apply_diff(
    index: DataFrame, uploads: DataFrame, deletes: DataFrame, by: str = "id"
) -> DataFrame:
    """The index after a diff: delete first, then upsert by id.

    `by="id"` removes exactly the delete set. `by="path"` removes every row on its paths;
    a current row sharing a path with a stale one comes back with the next sync.
    """
    uploads = uploads.select(*index.columns).dropDuplicates(["id"])
    if by == "path":
        kept = drop_paths(index, stale_paths(deletes))
    elif by == "id":
        kept = index.join(deletes.select("id"), "id", "left_anti").select(*index.columns)
    else:
        raise ValueError(f"by must be 'id' or 'path', not {by!r}")
    return (
        kept.join(uploads.select("id"), "id", "left_anti")
        .select(*index.columns)
        .unionByName(uploads)
    )


def diff_actions(local: DataFrame, index: DataFrame) -> DataFrame:
    """One row per changed id with `action` upload or delete: both sets from one join."""
    ours = local.select("id", F.col("path").alias("local_path"))
    theirs = index.select("id", F.col("path").alias("index_path"))
    both = ours.join(theirs, "id", "full_outer")
    return both.where(F.col("local_path").isNull() | F.col("index_path").isNull()).select(
        "id",
        F.coalesce("local_path", "index_path").alias("path"),
        F.when(F.col("index_path").isNull(), "upload").otherwise("delete").alias("action"),
    )


def sync_counts(actions: DataFrame) -> DataFrame:
    """One row: rows to upload, rows to delete, and whether anything changed."""
    count = lambda name: F.count_if(F.col("action") == name)
    return actions.agg(
        count("upload").alias("n_upload"),
        count("delete").alias("n_delete"),
        (F.count("*") > 0).alias("changed"),
    )


def status_counts(embedded: DataFrame) -> DataFrame:
    """Rows by embedding status."""
    return embedded.groupBy("status").agg(F.count("*").alias("n"))
