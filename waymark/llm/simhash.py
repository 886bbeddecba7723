"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit of a fingerprint is assigned one of the non-zero vectors of `radius + 1` bits; mask
v keeps the bits whose vector has an odd product with v. For any `radius` bits some v has an
even product with all their vectors, so two fingerprints that differ in at most that many
bits agree under that mask: 2^(radius + 1) - 1 tables miss no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.components import components
from waymark.llm.shared import small_batches, table, written
from waymark.llm.tokens import text_list

WIDTH = 64
SEED = 42
RADIUS = 2
# Buckets up to this size are compared pair by pair; larger ones through midpoints.
PAIRED = 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# Hashes whose bits are counted at a time.
_COUNTED = 1 << 15


def covering_masks(radius: int = RADIUS, width: int = WIDTH) -> list[int]:
    """Masks of which at least one agrees for every two values within `radius` bits."""
    vectors = (1 << (radius + 1)) - 1
    own = [1 + bit % vectors for bit in range(width)]
    return [
        sum(1 << bit for bit in range(width) if (own[bit] & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of every run of `size` words (all words, if fewer), repeats included."""
    from xxhash import xxh64_intdigest as xxh64

    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(0, len(words) - size)
    first, final = starts[: last + 1].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    return np.fromiter(
        (xxh64(joined[a:b], SEED) for a, b in zip(first, final)), dtype=np.uint64, count=len(first)
    )


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of 64-bit hashes."""
    counts = np.zeros(WIDTH, dtype=np.int64)
    for at in range(0, len(hashes), _COUNTED):
        part = hashes[at : at + _COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """`doc_id` and `fp` (the fingerprint as a signed long) per row of `docs`.

    A text without words, null or empty, has fingerprint zero.
    """
    small_batches(docs.sparkSession)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = [majority(shingle_hashes(t, words)) for t in text_list(batch["text"])]
            fp = np.array(marks, dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": fp})

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInPandas(mark, "doc_id long, fp long")


def links_within(marks: DataFrame, radius: int = RADIUS, paired: int = PAIRED) -> DataFrame:
    """Links `a, b` whose components are those of all pairs of `marks.fp` within `radius` bits.

    `marks.fp` must be distinct. In buckets of at most `paired` marks every pair is compared.
    Marks of larger buckets are linked through midpoints: for an even radius, two marks within
    it have a value within half of it from both, and marks that share such a value are within
    it; so linking all marks of a value to the least of them is exact and grows with the
    marks, not with their pairs.
    """
    if radius != 2:
        raise ValueError("midpoints are written for radius 2")
    signed = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("m")) for t, m in enumerate(signed)]))
    keyed = marks.select("fp", tables.alias("mask")).select(
        "fp", F.col("mask.t").alias("t"), F.col("fp").bitwiseAND(F.col("mask.m")).alias("key")
    )
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, ["t", "key"]), "buckets")
    few = shared.where(F.col("n") <= paired)
    pairs = few.alias("x").join(few.alias("y"), ["t", "key"]).where(
        F.expr(f"x.fp < y.fp AND bit_count(x.fp ^ y.fp) <= {radius}")
    )
    many = shared.where(F.col("n") > paired).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.expr(f"shiftleft(1L, {b})") for b in range(WIDTH)])
    middles = many.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle")
    )
    least = middles.groupBy("middle").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = middles.join(least, "middle").where("fp <> b")
    return (
        pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        .unionByName(stars.select(F.col("fp").alias("a"), "b"))
        .distinct()
    )


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """`doc_id, fp, component_id` per row of `docs`; component_id is the group's least doc_id.

    Rows of equal fingerprint count once in the search. Null ids take part and never name a
    group (a group of them alone has none); repeated rows come back as often as they came;
    an empty table gives no rows; other columns are ignored.
    """
    marked = written(fingerprints(docs, words), "fingerprints")
    marks = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "marks")
    roots = components(links_within(marks, radius))
    rooted = marks.join(roots, marks.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = written(rooted.join(named, "root").select("fp", "component_id"), "groups")
    return marked.join(groups, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the documents and the groups they form."""
    found = simhash_groups(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
