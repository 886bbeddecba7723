"""Substring deduplication: Rabin-Karp hashes of every window of words, counted in Spark.

A window is a run of `window` words of one document; its hash is a polynomial of its words'
hashes, rolled over all windows of a batch of documents at once. Equal hashes meet in buckets of
about equal size, where the least doc_id of each is found; windows that a document with a
smaller id has too are told to their document, and there merge into maximal removal intervals.

A batch of documents sends a hash once, for the least doc_id that has it, so a window that
a third of all documents share makes one entry per batch. That its other documents lose it is
known in the batch. A bucket's number is taken from a second polynomial, so entries of one bucket
are told apart by 64 bits, those of all buckets by 64 and the bits of the number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import small_batches, table
from waymark.llm.tokens import text_list

WINDOW = 13
SEED = 11
# Odd bases of the two polynomials, modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
# Windows of a batch of documents; bytes of text per bucket of hashes.
BATCH_WINDOWS = 1 << 20
BUCKET_BYTES = 32 << 20
ENTRIES = "bucket long, ids binary, counts binary, hashes binary"
TOLD = "part long, ids binary, counts binary, hashes binary"
REPEATS = "doc_id long, repeats binary"
CUT = (
    "doc_id long, n_words long, n_removed long, removed array<struct<first: long, end: long>>, kept_text string"
)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def word_lists(texts: list[str]) -> list[list[bytes]]:
    """Words are what bytes.split() leaves: runs without space, tab, line or page breaks."""
    return [t.encode().split() for t in texts]


def window_hashes(texts: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of every window of the texts' words, and how many windows each text has."""
    from xxhash import xxh64_intdigest as xxh64

    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    counts = np.maximum(sizes - window + 1, 0)
    total = int(sizes.sum())
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), counts
    words = np.fromiter((xxh64(w, SEED) for own in texts for w in own), dtype=np.uint64, count=total)
    ends = np.cumsum(sizes)
    # Windows that would run over a text's end are left out.
    starts = np.repeat(ends - sizes, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    out = []
    for base in BASES:
        rolled = np.zeros(total - window + 1, dtype=np.uint64)
        for k in range(window):
            rolled *= np.uint64(base)
            rolled += words[k : total - window + 1 + k]
        out.append(_mixed(rolled)[starts])
        words = _mixed(words)
    return out[0] ^ (out[1] << np.uint64(1)), out[1], counts


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true flags."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _packed(keys: np.ndarray, ids: np.ndarray, hashes: np.ndarray, name: str) -> pd.DataFrame:
    """A row per key with its hashes, in order of id: ids as differences, how many of each, hashes."""
    by = np.lexsort((ids, keys))
    keys, ids, hashes = keys[by], ids[by], hashes[by]
    cuts = np.flatnonzero(np.diff(keys, prepend=-1, append=-1)) if len(keys) else np.zeros(1, int)
    rows = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        names, counts = np.unique(ids[a:b], return_counts=True)
        steps = np.diff(names, prepend=np.int64(0))
        rows.append((int(keys[a]), steps.tobytes(), counts.astype("<i4").tobytes(), hashes[a:b].tobytes()))
    return pd.DataFrame(rows, columns=[name, "ids", "counts", "hashes"]).astype({name: "int64"})


def _unpacked(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and hashes of rows of `_packed`."""
    ids = [
        np.repeat(np.cumsum(np.frombuffer(i, "<i8")), np.frombuffer(c, "<i4")) for i, c in zip(group["ids"], group["counts"])
    ]
    return np.concatenate(ids), np.concatenate([np.frombuffer(h, "<u8") for h in group["hashes"]])


def _batch_entries(ids: np.ndarray, hashes: np.ndarray, seconds: np.ndarray, buckets: int, own: int) -> pd.DataFrame:
    """A batch's rows: per bucket its distinct hashes with their least ids; what repeats in it as bucket `own`.

    `ids` and both hashes are of windows, ids ascending.
    """
    order = np.argsort(hashes, kind="stable")
    h, d, bucket = hashes[order], ids[order], (seconds[order] >> np.uint64(33)).astype(np.int64) * buckets >> 31
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    # A hash is listed once per id.
    again = ~new
    again[1:] &= d[1:] != d[:-1]
    bucket[again] = buckets + own
    listed = new | again
    return _packed(bucket[listed], d[listed], h[listed], "bucket")


def _entries(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Rows of `_batch_entries` of all documents with an id."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def rows() -> pd.DataFrame:
            parts = [np.concatenate(p) for p in zip(*held)]
            return _batch_entries(*parts, buckets, task << 32 | number)

        for batch in batches:
            first, second, counts = window_hashes(word_lists(text_list(batch["text"])), window)
            held.append((np.repeat(batch["doc_id"].to_numpy(np.int64), counts), first, second))
            if sum(len(h) for _, h, _ in held) >= BATCH_WINDOWS:
                yield rows()
                held, number = [], number + 1
        if held and sum(len(h) for _, h, _ in held):
            yield rows()

    # In a fixed order a repeated task makes the same batches, and least ids come first in them.
    return docs.where("doc_id IS NOT NULL").sortWithinPartitions("doc_id", F.xxhash64("text")).mapInPandas(hashed, ENTRIES)


def repeated_windows(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`doc_id, repeats`: per id, the hashes of its windows that a smaller id has too."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        """What documents of a bucket lose, by parts of all ids."""
        ids, hashes = _unpacked(group)
        if group["bucket"].iloc[0] < buckets:
            order = np.lexsort((ids, hashes))
            ids, hashes = ids[order], hashes[order]
            new = np.ones(len(ids), dtype=bool)
            new[1:] = hashes[1:] != hashes[:-1]
            lost = ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1]
            ids, hashes = ids[lost], hashes[lost]
        parts = (_mixed(ids.view(np.uint64)) >> np.uint64(33)).astype(np.int64) * buckets >> 31
        return _packed(parts, ids, hashes, "part")

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        ids, hashes = _unpacked(group)
        order = np.argsort(ids, kind="stable")
        names, first = np.unique(ids[order], return_index=True)
        ends = [*first[1:].tolist(), len(ids)]
        raw = hashes[order].tobytes()
        return pd.DataFrame({"doc_id": names, "repeats": [raw[8 * a : 8 * b] for a, b in zip(first.tolist(), ends)]})

    told = _entries(docs, window, buckets).groupBy("bucket").applyInPandas(judge, TOLD)
    return told.groupBy("part").applyInPandas(gather, REPEATS)


def remove_repeats(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Cut from `docs` (`doc_id`, `text`) every word inside a window that a smaller doc_id has too.

    Returns, per row of `docs`, `doc_id, n_words, n_removed`, `removed` (maximal intervals of
    word numbers, end exclusive) and `kept_text` (kept words joined by one space). All windows
    are judged on the texts as given. A null or empty text has no words; a text of fewer words
    than a window keeps them. A null doc_id is compared with nothing: such rows lose no word
    and take none from others. Rows that repeat an id lose nothing to each other and each give
    a row; equal rows give equal results. An empty table gives none; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = repeated_windows(texts, window, bucket_bytes).withColumn("unnamed", F.lit(False))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = word_lists(text_list(batch["text"]))
            spans: list[list] = [[] for _ in words]
            hit = [k for k, r in enumerate(batch["repeats"]) if r is not None]
            hashes, _, counts = window_hashes([words[k] for k in hit], window)
            ends = np.cumsum(counts)
            for k, end, count in zip(hit, ends.tolist(), counts.tolist()):
                known = np.frombuffer(batch["repeats"].iloc[k], "<u8")
                at = np.flatnonzero(np.isin(hashes[end - count : end], known))
                cover = np.zeros(len(words[k]) + 1, dtype=np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                spans[k] = _spans(np.cumsum(cover)[:-1] > 0)
            kept = []
            for own, gone in zip(words, spans):
                starts, stops = [0, *(b for _, b in gone)], [*(a for a, _ in gone), len(own)]
                kept.append(b" ".join([w for a, b in zip(starts, stops) for w in own[a:b]]).decode())
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "n_words": [len(w) for w in words],
                    "n_removed": [sum(b - a for a, b in s) for s in spans],
                    "removed": [[{"first": a, "end": b} for a, b in s] for s in spans],
                    "kept_text": kept,
                }
            )

    # Rows without an id find nothing, and are spread by their text.
    named = texts.select("*", F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.xxhash64("text")).alias("key"))
    joined = named.join(found.withColumnRenamed("doc_id", "key"), ["unnamed", "key"], "left")
    return joined.select("doc_id", "text", "repeats").mapInPandas(cut, CUT)


def op11_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of documents before it."""
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
    FROM documents
), windows AS (
    SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS key
    FROM d, unnest(range(1, len(w) - 11)) AS u(i)
), gone AS (
    SELECT DISTINCT r, i + k AS p FROM (
        SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY key) AS again FROM windows
    ), unnest(range(0, 13)) AS u(k) WHERE again
), kept AS (
    SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
    FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p)
    GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
