"""Token-id files: document boundaries in Elias-Fano form over one array of ids.

A file set is a Parquet table of blocks in document order, so that any store Spark writes to
will do. A block is a row: `shard, block, n_docs, n_ids, ids_before` (ids of the shard before
it), `doc_ids` (null ids, which come first, are left out) and `data`. `data` is

    magic "EFT1" | id width in bytes (1 byte, 2 or 4) | 3 bytes zero
    | Elias-Fano sequence of the n_docs document ends | n_ids ids, little-endian, unsigned

The width is 2 where the vocabulary allows. A block holds `BLOCK_IDS` ids or one longer
document. Shards follow each other in doc_id order; so do blocks within a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.elias_fano import EliasFano
from waymark.llm.shared import small_batches, table
from waymark.llm.tokens import shared_encoder, text_list
from waymark.session import fresh_path

MAGIC = b"EFT1"
BLOCK_IDS = 1 << 20
END_ID = 0
BLOCKS = (
    "shard int, block int, n_docs int, n_ids long, ids_before long, doc_ids array<long>, "
    "data binary"
)


def encode_block(documents: list[np.ndarray], width: int) -> bytes:
    """Documents' ids as one block."""
    ends = np.cumsum([len(d) for d in documents], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    ids = np.concatenate(documents) if documents else np.zeros(0)
    head = MAGIC + bytes([width, 0, 0, 0])
    return head + EliasFano.encode(ends, total).to_bytes() + ids.astype(f"<u{width}").tobytes()


class Block:
    """A block read back; documents are found by selection."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token-id block")
        self.ends, size = EliasFano.from_bytes(data[8:])
        self.ids = np.frombuffer(data, dtype=f"<u{data[4]}", offset=8 + size)

    def __len__(self) -> int:
        return self.ends.count

    def bounds(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the documents at `places` start and end."""
        starts = np.zeros(len(places), dtype=np.int64)
        later = places > 0
        starts[later] = self.ends.select(places[later] - 1)
        return starts, self.ends.select(places)

    def document(self, i: int) -> np.ndarray:
        (start,), (end,) = self.bounds(np.array([i]))
        return self.ids[start:end]


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode `docs` (`doc_id`, `text`; other columns are ignored) into blocks at `path`.

    Documents are ordered by doc_id, null first; rows that repeat an id are next to each other,
    ordered by a hash of the text, so that they may fill several shards. A null or empty text is
    its end id alone. An empty table writes no block.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId()
        encoder = shared_encoder(vocabulary)
        width = 2 if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], dtype="<u4")
        ids: list[np.ndarray] = []
        names: list = []
        number = before = held = 0

        def row() -> pd.DataFrame:
            data = encode_block(ids, width)
            one = (shard, number, len(ids), held, before, [n for n in names if n is not None], data)
            return pd.DataFrame([one], columns="shard block n_docs n_ids ids_before doc_ids data".split())

        for batch in batches:
            encoded = encoder.encode(text_list(batch["text"]))
            keys = batch["doc_id"].astype("Int64")
            for doc_id, own in zip(keys, encoded):
                if ids and held + len(own) + 1 > block_ids:
                    yield row()
                    number, before, held, ids, names = number + 1, before + held, 0, [], []
                ids.append(np.concatenate([own, end]))
                names.append(None if doc_id is pd.NA else int(doc_id))
                held += len(own) + 1
        if ids:
            yield row()

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = read.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ordered.mapInPandas(blocks, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at `path`: `doc_id, start, n_tokens, ids` (unsigned 32-bit)."""
    small_batches(spark)
    stored = spark.read.schema(BLOCKS).parquet(path)
    sizes = stored.groupBy("shard").agg(F.sum("n_ids").alias("own"))
    # One row of two numbers per shard of the file set, so its broadcast is bounded by the
    # number of write tasks.
    bases = sizes.select(
        "shard", F.expr("sum(own) OVER (ORDER BY shard) - own AS shard_start")
    )
    placed = stored.join(F.broadcast(bases), "shard").select(
        (F.col("shard_start") + F.col("ids_before")).alias("block_start"), "doc_ids", "data"
    )

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, names, data in zip(batch["block_start"], batch["doc_ids"], batch["data"]):
                block = Block(data)
                starts, ends = block.bounds(np.arange(len(block)))
                wide = block.ids.astype("<u4")
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None] * (len(block) - len(names)) + list(names), "Int64"),
                        "start": start + starts,
                        "n_tokens": ends - starts,
                        "ids": [wide[a:b].tobytes() for a, b in zip(starts, ends)],
                    }
                )

    return placed.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' places, sizes and checksums, read back from written token files."""
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    read = read_token_files(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
