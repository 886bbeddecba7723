"""Benchmark decontamination by suffix arrays over training shards.

A shard is a run of documents in one task. Its words become numbers of the benchmark's
vocabulary (0: in no item); suffixes that no test window can begin are left out, since
two words that never stand together in an item end every match. The others, and those of the
items, are ranked by prefix doubling, which gives the shard's suffix array to the window's
depth; every test suffix is then found in it by binary search. Hits that go on along an item
are joined to the longest verbatim matches.

The benchmark reaches the tasks in blocks of at most `BLOCK_BYTES` of text, each broadcast by
itself and matched against every document, so its size is not bounded by a task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import small_batches, table
from waymark.llm.tokens import text_list

WINDOW = 13
BLOCK_BYTES = 8 << 20
# Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
# A document is contaminated from one hit word in this many.
SHARE = 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTES = _LOWER.tobytes()
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
# An odd multiplier for word hashes modulo 2^64, and one modulo a prime: no pair of words is alike
# under every multiplier of both, as some long ones are modulo a power of two.
_STEP = 0x9E3779B97F4A7C15 | 1
_PRIME, _PRIME_STEP = (1 << 31) - 1, 1_664_525
_TABLE_BITS = 20
MATCHES = "array<struct<item_id: string, doc_word: long, item_word: long, n_words: long>>"
HITS = f"n_words long, n_hit long, item_ids array<string>, matches {MATCHES}"


class _Powers:
    """Powers of the multiplier and of its inverse, as far as any shard needed them."""

    up = down = prime_up = prime_down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, ...]:
        if len(cls.up) < n:
            for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
                factors = np.full(n, base, dtype=np.uint64)
                factors[0] = 1
                setattr(cls, name, np.cumprod(factors))
            for name, base in (("prime_up", _PRIME_STEP), ("prime_down", pow(_PRIME_STEP, -1, _PRIME))):
                powers = np.ones(1, dtype=np.uint64)
                while len(powers) < n:
                    ahead = np.uint64(pow(base, len(powers), _PRIME))
                    powers = np.concatenate([powers, powers * ahead % np.uint64(_PRIME)])
                setattr(cls, name, powers[:n])
        return cls.up[:n], cls.down[:n], cls.prime_up[:n], cls.prime_down[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of lower-cased texts, and each word's text number."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = _IN_WORD[joined]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    up, down, prime_up, prime_down = _Powers.upto(len(joined) + 1)
    letters = joined.astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(letters * up[:-1], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    # Sums of numbers below 2^40 stay exact for texts of less than 2^24 times a shard's bytes.
    np.cumsum(letters * prime_up[:-1], out=sums[1:])
    second = (sums[ends] - sums[starts]) % np.uint64(_PRIME) * prime_down[starts] % np.uint64(_PRIME)
    hashes ^= second * np.uint64(0xC2B2AE3D27D4EB4F)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return hashes, np.searchsorted(first, starts, side="right") - 1


class Benchmark:
    """A block of test items: their words as numbers, their windows, their word pairs."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        texts = [t.encode().translate(_LOWER_BYTES) for _, t in items]
        hashes, owner = word_hashes(texts) if texts else (np.zeros(0, np.uint64), np.zeros(0, int))
        self.words = np.unique(hashes)
        ranks = np.searchsorted(self.words, hashes) + 1
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        classes: dict[bytes, int] = {}
        self.ids: list[list[str]] = []  # of each class of items with equal words
        pieces, at = [], 0
        windows: dict[int, list[np.ndarray]] = {}
        owners: list[np.ndarray] = []
        for k, (item_id, _) in enumerate(items):
            own = ranks[bounds[k] : bounds[k + 1]]
            if not len(own):
                continue
            number = classes.setdefault(own.tobytes(), len(self.ids))
            if number == len(self.ids):
                self.ids.append([])
                size = min(window, len(own))
                starts = np.arange(len(own) - size + 1) + at
                windows.setdefault(size, []).append(starts)
                pieces += [own, [0]]
                owners.append(np.full(len(own) + 1, number))
                at += len(own) + 1
            if item_id is not None:
                self.ids[number].append(item_id)
        self.text = np.concatenate([*pieces, [0]]).astype(np.int64)
        self.owner = np.concatenate([*owners, [-1]]).astype(np.int64)
        begins = np.flatnonzero(np.diff(self.owner, prepend=-2))
        self.begin = begins[np.clip(self.owner, 0, None)] if len(begins) else self.text
        self.windows = {size: np.concatenate(w) for size, w in windows.items()}
        pairs = self.text[:-1] * (len(self.words) + 1) + self.text[1:]
        self.pairs = np.unique(pairs[(self.text[:-1] > 0) & (self.text[1:] > 0)])
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[self.words >> np.uint64(64 - _TABLE_BITS)] = True
        self.pair_table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.pair_table[self._slot(self.pairs)] = True

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(_STEP)) >> np.uint64(64 - _TABLE_BITS)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=np.int64)
        maybe = np.flatnonzero(self.table[hashes >> np.uint64(64 - _TABLE_BITS)])
        if len(maybe) and len(self.words):
            at = np.searchsorted(self.words, hashes[maybe])
            at[at == len(self.words)] = 0
            out[maybe] = np.where(self.words[at] == hashes[maybe], at + 1, 0)
        return out

    def candidates(self, ranks: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Places of words that a match of some test window may cover."""
        shortest = min(self.windows)
        if shortest == 1:
            return np.flatnonzero(ranks)
        pairs = ranks[:-1] * (len(self.words) + 1) + ranks[1:]
        maybe = (ranks[:-1] > 0) & (ranks[1:] > 0) & (owner[1:] == owner[:-1])
        at = np.flatnonzero(maybe)
        at = at[self.pair_table[self._slot(pairs[at])]]
        at = at[np.isin(pairs[at], self.pairs)]  # the pair (at, at + 1) stands in an item
        if not len(at):
            return at
        cuts = np.flatnonzero(np.diff(at) != 1) + 1
        begins = at[np.concatenate([[0], cuts])]
        sizes = np.diff(np.concatenate([[0], cuts, [len(at)]])) + 1
        begins, sizes = begins[sizes >= shortest], sizes[sizes >= shortest]
        return _spread(begins, sizes)


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each size, in a row."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(total[-1]) + np.repeat(begins - total[:-1], sizes)


def _keys(joint: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, numbers that order and identify the first `size` words of every suffix."""
    ranks, depth = np.unique(joint, return_inverse=True)[1], 1
    for size in sorted(sizes):
        while depth * 2 <= size:
            ranks = np.unique(_pair(ranks, depth), return_inverse=True)[1]
            depth *= 2
        yield size, _pair(ranks, size - depth) if size > depth else ranks


def _pair(ranks: np.ndarray, shift: int) -> np.ndarray:
    # Past the end stands what orders first: rank 0, the rank of a separator.
    later = np.concatenate([ranks[shift:], np.zeros(shift, dtype=ranks.dtype)])
    return ranks * (ranks.max() + 1) + later


def _unlike(
    keys: np.ndarray, beside: np.ndarray, tests: np.ndarray, base: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (shard suffix, test) of equal keys whose words `beside` them differ or are none.

    Suffixes are ordered by key, then neighbour: what a test pairs with is its key's range without
    the neighbour's, so the pairs listed are the ones returned.
    """
    order = np.lexsort((beside[base:], keys[base:]))
    ordered, around = keys[base:][order], beside[base:][order]
    low = np.searchsorted(ordered, keys[tests], side="left")
    high = np.searchsorted(ordered, keys[tests], side="right")
    some = np.flatnonzero(high > low)
    tests, low, high = tests[some], low[some], high[some]
    # One number per key (its place in order) and neighbour finds the part to leave out.
    step = int(beside.max()) + 1
    group = np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0)
    both, wanted = group * step + around, group[low] * step + beside[tests]
    first = np.searchsorted(both, wanted, side="left")
    last = np.searchsorted(both, wanted, side="right")
    bare = beside[tests] == 0
    first, last = np.where(bare, low, first), np.where(bare, low, last)
    sizes = np.stack([first - low, high - last], axis=1)
    begins = np.stack([low, last], axis=1)
    return order[_spread(begins.ravel(), sizes.ravel())], np.repeat(tests, sizes.sum(axis=1))


def match_shard(
    hashes: np.ndarray, owner: np.ndarray, bench: Benchmark
) -> tuple[np.ndarray, np.ndarray]:
    """The hit words of a shard, and its matches: rows (first word, item class, item word, words).

    Hits are marked once per distinct window; of the windows that follow each other along an item
    only the first and the last are listed, so memory grows with the shard and its matches.
    """
    hit = np.zeros(len(hashes) + 1, dtype=np.int64)
    none = np.zeros((0, 4), dtype=np.int64)
    if not bench.windows or not len(hashes):
        return hit[:-1] > 0, none
    ranks = bench.numbers(hashes)
    places = bench.candidates(ranks, owner)
    if not len(places):
        return hit[:-1] > 0, none
    # A separator stands wherever the words kept are not neighbours in one document.
    apart = (np.diff(places) != 1) | (owner[places[1:]] != owner[places[:-1]])
    slots = np.arange(len(places)) + np.concatenate([[0], np.cumsum(apart)])
    kept = np.zeros(slots[-1] + 2, dtype=np.int64)
    kept[slots] = ranks[places]
    place_of = np.full(len(kept), -1)
    place_of[slots] = places
    joint = np.concatenate([bench.text, kept])
    base, found = len(bench.text), []
    left = np.concatenate([[0], joint[:-1]])
    for size, keys in _keys(joint, list(bench.windows)):
        tests = bench.windows[size]
        suffixes = np.flatnonzero(np.isin(keys[base:], keys[tests]))
        docs = place_of[suffixes]
        hit += np.bincount(docs, minlength=len(hit)) - np.bincount(docs + size, minlength=len(hit))
        if not len(suffixes):
            continue
        # A whole item is one window, whatever stands beside it.
        right = np.concatenate([joint[size:], np.zeros(size, dtype=np.int64)])
        begins, heads = _unlike(keys, left, tests, base)
        ends, tails = _unlike(keys, right, tests, base)
        # Along one diagonal matches are apart: the n-th that begins is the n-th that ends.
        ahead = np.lexsort((begins, begins - heads))
        behind = np.lexsort((ends, ends - tails))
        begins, heads, ends = begins[ahead], heads[ahead], ends[behind]
        found.append(
            np.stack([place_of[begins], bench.owner[heads], heads - bench.begin[heads], ends - begins + size], axis=1)
        )
    return np.cumsum(hit)[:-1] > 0, np.concatenate(found) if found else none


def _blocks(spark: SparkSession, items: DataFrame, window: int, block_bytes: int) -> list:
    """Broadcast benchmarks of at most about `block_bytes` of text each."""
    rows = items.select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(-(-total // block_bytes)) or 1
    spread = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    out = []
    for k in range(count):
        block = [(r.item_id, r.text) for r in rows.where(spread == k).toLocalIterator()]
        out.append(spark.sparkContext.broadcast(Benchmark(block, window)))
    return out


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: bool = False
) -> DataFrame:
    """Words of `docs` (`doc_id`, `text`) inside verbatim windows of `items` (`item_id`, `text`).

    Returns, per row of `docs`, `doc_id, n_words, n_hit, item_ids` (sorted, of all items with a
    window in it) and `matches`, the longest verbatim ones: item (one of equal items), first
    word in document and item, number of words. A null or empty text has no words; an item
    without words is found nowhere; an item of null id counts as hits but is not listed;
    repeated rows each give a row; an empty table of either kind gives rows without hits or
    none. Other columns are ignored; with `keep` the whole row comes along as the struct `doc`.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = _blocks(spark, items, window, block_bytes)

    def shards(texts: list[bytes]) -> Iterator[tuple[int, int]]:
        begin = held = 0
        for k, text in enumerate(texts):
            if k > begin and held + len(text) > SHARD_BYTES:
                yield begin, k
                begin, held = k, 0
            held += len(text)
        if begin < len(texts):
            yield begin, len(texts)

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode().translate(_LOWER_BYTES) for t in text_list(batch)]
            parts = []
            for begin, end in shards(texts):
                hashes, owner = word_hashes(texts[begin:end])
                count = end - begin
                hit = np.zeros(len(hashes), dtype=bool)
                starts = np.searchsorted(owner, np.arange(count + 1))
                listed: list[set] = [set() for _ in range(count)]
                rows, names = [], []
                for block in blocks:
                    bench = block.value
                    own, matches = match_shard(hashes, owner, bench)
                    hit |= own
                    docs = owner[matches[:, 0]]
                    for pair in np.unique(docs * (len(bench.ids) or 1) + matches[:, 1]).tolist():
                        doc, kind = divmod(pair, len(bench.ids))
                        listed[doc].update(bench.ids[kind])
                    first = np.array([ids[0] if ids else None for ids in bench.ids], dtype=object)
                    names.append(first[matches[:, 1]] if len(first) else first)
                    rows.append(np.stack([docs, matches[:, 0] - starts[docs], matches[:, 2], matches[:, 3]], axis=1))
                told, names = np.concatenate(rows), np.concatenate(names)
                order = np.lexsort(told.T[::-1])
                told, names = told[order], names[order]
                bounds = np.searchsorted(told[:, 0], np.arange(count + 1))
                parts.append(pd.DataFrame(
                    {
                        "n_words": np.diff(starts),
                        "n_hit": np.bincount(owner[hit], minlength=count)[:count],
                        "item_ids": [sorted(x) for x in listed],
                        "matches": [
                            [
                                {"item_id": name, "doc_word": word, "item_word": at, "n_words": n}
                                for name, (_, word, at, n) in zip(names[a:b].tolist(), told[a:b].tolist())
                            ]
                            for a, b in zip(bounds[:-1], bounds[1:])
                        ],
                    }
                ))
            yield pd.concat(parts, ignore_index=True)

    found = F.pandas_udf(search, HITS)(F.col("text").cast("string")).alias("found")
    lead = F.struct("*").alias("doc") if keep else F.col("doc_id").cast("long")
    return docs.select(lead, found).select("doc" if keep else "doc_id", "found.*")


def contaminated(share: int = SHARE):
    """Whether hit words make up at least one in `share` of a document's words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands verbatim in benchmark items."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP9_SQL = r"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS size,
        array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS key
    FROM item_words, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS r(i) WHERE len(w) > 0
), doc_words AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents
), hits AS (
    SELECT r, i, size, item_id FROM (
        SELECT r, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS key
        FROM doc_words, (SELECT DISTINCT size FROM windows), unnest(range(1, len(w) + 1)) AS u(i)
        WHERE i + size - 1 <= len(w)
    ) JOIN windows USING (size, key)
), hit_words AS (
    SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, size FROM hits),
        unnest(range(0, size)) AS u(k) GROUP BY r
), hit_items AS (
    SELECT r, count(DISTINCT item_id) AS n_items,
        string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
    FROM hits GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
