"""Corpus counts and chunk checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import extension


def corpus_stats(chunks: DataFrame, corpus: DataFrame) -> DataFrame:
    """By extension: files with at least one chunk, their bytes, and their chunks.

    Chunks are counted by path before anything is joined or grouped by the few extensions.
    """
    per_path = chunks.groupBy("path").agg(F.count("*").alias("n"))
    return (
        corpus.select("path", "size")
        .join(per_path, "path")
        .groupBy(extension(F.col("path")).alias("extension"))
        .agg(
            F.count("*").alias("n_files"),
            F.sum("n").alias("n_chunks"),
            F.sum("size").alias("n_bytes"),
        )
    )


def broken_rules() -> dict[str, Column]:
    """For each invariant of a chunk, how many rows break it (null counts as broken)."""
    broken = lambda ok: F.count_if(~F.coalesce(ok, F.lit(False)))
    return {
        "bad_path": broken(F.col("path") != ""),
        "bad_start": broken(F.col("start_line") > 0),
        "bad_end": broken(F.col("end_line") >= F.col("start_line")),
        "bad_content": broken(F.col("content") != ""),
        "bad_hash": broken((F.col("file_hash") != "") & (F.col("chunk_hash") != "")),
        "bad_id": broken(F.col("id") != ""),
    }


def check_chunks(chunks: DataFrame) -> DataFrame:
    """One row: how many chunks there are and how many break each rule."""
    return chunks.agg(F.count("*").alias("n_chunks"), *[c.alias(name) for name, c in broken_rules().items()])
