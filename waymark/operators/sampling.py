"""Seeded sample of exactly n rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import materialise

# Up to this many rows the sample is a top-n; beyond it no single task holds the sample.
MAX_TOP = 50_000
PREFIX = 4


def seeded_sample(df: DataFrame, n: int, seed: str, key: str = "id") -> DataFrame:
    """The n rows with the smallest hash of seed and key; all rows when there are fewer.

    The same seed and rows give the same sample however the rows are partitioned. The rows are read
    once: each task hands on its own n smallest, and of a large sample those are written, cut by
    ranges of the hash and never gathered in one task.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))))
    if n <= MAX_TOP:
        return hashed.orderBy("_h", key).limit(n).drop("_h")
    return _large(materialise(_smallest(hashed, n, key), "sample"), n, key, "").drop("_h")


def _smallest(hashed: DataFrame, n: int, key: str) -> DataFrame:
    """Of every task's rows the n smallest."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = n
        for batch in batches:
            if left <= 0:
                return
            yield batch.slice(0, left)
            left -= batch.num_rows

    return hashed.sortWithinPartitions("_h", key).mapInArrow(first, hashed.schema)


def _large(hashed: DataFrame, n: int, key: str, prefix: str) -> DataFrame:
    """Whole hash ranges up to the one the n-th row falls in, then the same inside that one."""
    depth = len(prefix) + PREFIX
    head = F.substring("_h", 1, depth)
    counts = (
        hashed.where(F.startswith("_h", F.lit(prefix)))
        .groupBy(head.alias("head"))
        .agg(F.count("*").alias("n"))
        .orderBy("head")
        .collect()  # at most 16**PREFIX rows
    )
    before = 0
    for row in counts:
        if before + row.n > n:
            below = hashed.where(F.startswith("_h", F.lit(prefix)) & (head < row["head"]))
            inside = hashed.where(F.startswith("_h", F.lit(row["head"])))
            left = n - before
            if left == 0:
                return below
            if left <= MAX_TOP or depth + PREFIX > 32:
                return below.unionByName(inside.orderBy("_h", key).limit(left))
            return below.unionByName(_large(hashed, left, key, row["head"]))
        before += row.n
    return hashed.where(F.startswith("_h", F.lit(prefix)))
