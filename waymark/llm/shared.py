"""Helpers of the training-data operators: input tables, written tables, task batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import fresh_path

# Rows and bytes of text that a Python worker holds at a time. Rows bound it for ordinary
# texts, bytes for very long ones (a single longer text is a batch of its own).
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20
# Rows of some numbers that may be broadcast; each takes about 64 bytes of the driver.
BROADCAST_ROWS = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; call before a Python stage is planned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once, compactly, to the shared folder and read back.

    Cuts lineage: a lost executor repeats only tasks that had not committed.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_by(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How rows of a written table go into a join: broadcast if they are few, else shuffled.

    Left to itself Spark judges a table by its compressed files, and millions of numbers in
    a few megabytes would pass through the driver.
    """
    return F.broadcast if table.count() <= BROADCAST_ROWS else lambda rows: rows.hint("merge")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a table's shuffle files go as soon as it is written, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def runs(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of at most `size` consecutive items."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def crc32_sql(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes: the byte-wise form, its table made by rule."""
    values = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        values.append(f"{value}::BIGINT")
    digits = "'0123456789ABCDEF'"
    byte = f"16 * instr({digits}, substr(hex({text}), 2 * i + 1, 1)) + instr({digits}, substr(hex({text}), 2 * i + 2, 1)) - 17"
    octets = f"[({byte})::BIGINT FOR i IN range(strlen({text}))]"
    step = f"lambda a, b: xor(a >> 8, ([{', '.join(values)}])[xor(a & 255, b) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), {step}), 4294967295::BIGINT)"
