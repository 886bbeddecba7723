"""Exact top-k by cosine distance for a table of queries.

Distances are ranked to twelve decimals, ties go to the smaller id, and only the result is
rounded for show, so results do not depend on how the index is split. Index rows never move and no
pair of query and index row leaves a task: each task multiplies its rows with a chunk of the
queries, a broadcast of checked size, and passes on at most k rows per query. More queries than one
chunk holds go over the index chunk after chunk; small chunks share a pass, some passes are one job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from waymark.functions.vectors import DISTANCE_DECIMALS, RANKED_DECIMALS
from waymark.session import fresh_path, materialise

# Fixed value: results per query when not told otherwise.
DEFAULT_K = 20
# Queries and bytes of one chunk, which travels to every task.
MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_BYTES = 64 << 20
# Passes over the index that are one job.
JOB_CHUNKS = 16
SLICE_ROWS = 2048
# More than rounding to the ranked decimals can move a distance.
SLACK = 10.0**-RANKED_DECIMALS
# Column of a row's cell, where queries look into some cells only.
CELL = "ann_cell"
# Tasks that the hits of one query are dealt over first.
RANK_SHARES = 64


def knn(
    index: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    payload: tuple[str, ...] = (),
    max_queries: int = MAX_BROADCAST_QUERIES,
    shown: bool = True,
) -> DataFrame:
    """`query_id, rank, id, distance, *payload` of the k nearest rows of every query.

    `index` has `id` and `vector`, `queries` has `query_id` and `vector`. Filter `index`
    first for a filtered search. Rows of another width than the query, and rows or queries
    without a length, take no part.
    """
    queries = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    index = index.select("id", "vector", *payload)
    groups = chunk_groups(shared_passes(query_chunks(queries, max_queries)))

    def ranked(passes: list[list]) -> DataFrame:
        parts = [[rows[at : at + max_queries] for at in range(0, len(rows), max_queries)] or [[]] for rows in passes]
        asked = [[Asked([r.query_id for r in rows], [r.vector for r in rows]) for rows in chunks] for chunks in parts]
        return rank_hits(reduce(DataFrame.unionByName, [scan(index, queries, a, k) for a in asked]), k, shown)

    near, second = ranked(next(groups, [[]])), next(groups, None)
    # A query is in one chunk only, so each group's ranks are final; one group is held at a time.
    if second is not None:
        near = materialise(near, "hits")
    while second is not None:
        near = near.unionByName(materialise(ranked(second), "hits"))
        second = next(groups, None)
    return near


class Query(NamedTuple):
    query_id: object
    vector: np.ndarray


def shared_passes(chunks: Iterator[list]) -> Iterator[list]:
    """The queries of chunks that go over the index in one pass: together as many as one chunk may hold."""
    held: list = []
    for rows in chunks:
        width = max(len(r.vector) for r in (*held, *rows))
        count = len(held) + len(rows)
        if held and (count > MAX_BROADCAST_QUERIES or count * width * 8 > MAX_BROADCAST_BYTES):
            yield held
            held = []
        held = held + rows
    if held:
        yield held


def chunk_groups(chunks: Iterator[list], most: int = JOB_CHUNKS) -> Iterator[list[list]]:
    """Chunks that go over the index in one job: together no larger than one chunk may be."""
    group, held = [], 0
    for rows in chunks:
        size = len(rows) * max(len(r.vector) for r in rows) * 8
        if group and (len(group) >= most or held + size > MAX_BROADCAST_BYTES):
            yield group
            group, held = [], 0
        group.append(rows)
        held += size
    if group:
        yield group


def query_chunks(queries: DataFrame, max_queries: int = MAX_BROADCAST_QUERIES) -> Iterator[list]:
    """Rows of `queries` (`query_id`, `vector`) in chunks that may be sent to every task.

    One row more than fits is enough to know that a set is too large; it is then written once, dealt
    into chunks of about even size, and read one folder at a time, which holds one chunk, or as many
    small ones as the largest would be. All rows of a query are in one chunk.
    """
    head = queries.limit(max_queries + 1).collect()
    width = max((len(r.vector) for r in head), default=0)
    if len(head) <= max_queries and len(head) * width * 8 <= MAX_BROADCAST_BYTES:
        if head:
            yield head
        return
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    largest = max(1, MAX_BROADCAST_BYTES // (8 * max(size.width, 1)))
    fits = min(max_queries, largest)
    # Dealt by hash, chunks differ a little in size.
    count = math.ceil(1.25 * size.n / fits)
    together = max(1, min(MAX_BROADCAST_QUERIES, largest) // fits)
    folders = math.ceil(count / together)
    path = fresh_path(queries.sparkSession, "query-chunks")
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(count)).cast("int")
    dealt = queries.withColumn("chunk", chunk).withColumn("folder", F.floor(F.col("chunk") / together).cast("int"))
    dealt.repartition(min(folders, 4096), "folder").write.partitionBy("folder").parquet(path)
    schema = T.StructType([*dealt.schema.fields])
    written = queries.sparkSession.read.schema(schema).parquet(path)
    for k in range(folders):
        chunks: dict[int, list] = {}
        for row in written.where(F.col("folder") == k).select("chunk", "query_id", "vector").collect():
            # Held as numbers of eight bytes: some chunks wait for each other.
            chunks.setdefault(row.chunk, []).append(Query(row.query_id, np.asarray(row.vector, dtype=np.float64)))
        yield from (chunks[c] for c in sorted(chunks))


def rank_hits(hits: DataFrame, k: int, shown: bool = True) -> DataFrame:
    """Keep the k nearest hits of each query, number them and, if they are `shown`, round their distances.

    Hits of a query meet in as many tasks as they are dealt over before they meet in one, so
    a single query over a large index sends no task more than its share of them.
    """
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    share = Window.partitionBy("query_id", "share").orderBy("distance", "id")
    dealt = hits.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(RANK_SHARES)).cast("int"))
    hits = dealt.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= k).select(*hits.columns)
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    rest = [c for c in hits.columns if c not in ("query_id", "id", "distance")]
    distance = F.round("distance", DISTANCE_DECIMALS).alias("distance") if shown else F.col("distance")
    return ranked.select("query_id", "rank", "id", distance, *rest)


def _hit_schema(index: DataFrame, queries: DataFrame) -> T.StructType:
    kept = [f for f in index.schema.fields if f.name != "vector"]
    return T.StructType(
        [T.StructField("query_id", queries.schema["query_id"].dataType)]
        + kept
        + [T.StructField("distance", T.DoubleType())]
    )


def scan(index: DataFrame, queries: DataFrame, asked: Asked | list[Asked], k: int) -> DataFrame:
    """One pass over the index: at most k rows per query of every task. `asked` goes along with it."""
    schema = _hit_schema(index, queries)
    chunks = asked if isinstance(asked, list) else [asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _nearest(batches, chunks, k, schema):
            yield from found.to_batches()

    return index.mapInArrow(run, schema)


class Asked:
    """Query ids, and their unit vectors by what they are compared with.

    That is all rows of their width, or, with `by_cell` ({(width, cell): places of queries}), the
    rows of their width in a cell.
    """

    def __init__(self, ids: list, vectors: list, by_cell: dict[tuple[int, int], list[int]] | None = None):
        self.ids = np.empty(len(ids), dtype=object)
        self.ids[:] = ids
        members: dict[int, list] = {}
        for at, vector in enumerate(vectors):
            unit = np.asarray(vector, dtype=np.float64)
            norm = np.sqrt(unit @ unit)
            if norm > 0:
                members.setdefault(len(unit), []).append((at, unit / norm))
        self.units = {width: np.vstack([u for _, u in own]) for width, own in members.items()}
        self.by_cell = by_cell is not None
        # Places of queries, and of their vectors among those of their width.
        self.places: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for width, own in members.items():
            row = {at: n for n, (at, _) in enumerate(own)}
            keys = {(width, 0): list(row)} if by_cell is None else {k: v for k, v in by_cell.items() if k[0] == width}
            for key, places in keys.items():
                kept = [at for at in places if at in row]
                self.places[key] = np.array(kept, dtype=np.int64), np.array([row[at] for at in kept], dtype=np.int64)
        self._last: tuple = (None, None)

    def of(self, key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the queries, and their unit vectors, that rows of a width and cell are compared with."""
        places, rows = self.places.get(key, ((), ()))
        # Consecutive batches are mostly of one key.
        if self._last[0] != key:
            self._last = key, self.units[key[0]][rows] if len(places) else np.zeros((0, key[0]))
        return places, self._last[1]


class _Slice:
    """Rows of a batch in the order of their ids, by width and cell, with unit vectors made when asked for."""

    def __init__(self, batch: pa.RecordBatch, by_cell: bool):
        ids = batch.column(batch.schema.get_field_index("id"))
        batch = batch.take(pc.array_sort_indices(ids))
        self.vectors = batch.column(batch.schema.get_field_index("vector"))
        self.rest = batch.drop_columns(["vector"])
        widths = self.vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cells = np.zeros(len(widths), dtype=np.int64)
        if by_cell:
            cells = batch.column(batch.schema.get_field_index(CELL)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows = {
            key: np.flatnonzero((widths == key[0]) & (cells == key[1]))
            for key in map(tuple, np.unique(np.stack([widths, cells]), axis=1).T.tolist())
        }
        self._units: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def units(self, key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a key that have a length, and their unit vectors."""
        if key not in self._units:
            rows = self.rows[key]
            flat = self.vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            matrix = flat.astype(np.float64).reshape(len(rows), key[0])
            norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
            usable = norms > 0
            self._units[key] = rows[usable], matrix[usable] / norms[usable, None]
        return self._units[key]


class _Best:
    """At most k rows per query of a chunk, the nearest of what was offered so far."""

    def __init__(self, asked: Asked, k: int):
        self.asked, self.k = asked, k
        self.best: pd.DataFrame | None = None
        self.new: list[pd.DataFrame] = []
        self.waiting = 0
        # Distance a row must not exceed to be among a query's best; hits are merged, and it is lowered,
        # when as many are waiting as may be kept.
        self.limit = np.full(len(asked.ids), np.inf)
        self.patience = max(SLICE_ROWS, len(asked.ids) * k)

    def offer(self, part: _Slice) -> None:
        found = _nearest_in(part, self.asked, self.limit, self.k)
        if found is None:
            return
        self.new.append(found)
        self.waiting += len(found)
        if self.waiting >= self.patience:
            per_query = self.merged().groupby("q")["distance"].agg(["size", "max"])
            full = per_query[per_query["size"] == self.k]
            self.limit[full.index.to_numpy()] = full["max"].to_numpy()

    def merged(self) -> pd.DataFrame | None:
        if self.new:
            both = pd.concat(self.new if self.best is None else [self.best, *self.new], ignore_index=True)
            self.best = both.sort_values(["distance", "id"], kind="stable").groupby("q", sort=False).head(self.k)
            self.new, self.waiting = [], 0
        return self.best


def _nearest(
    batches: Iterator[pa.RecordBatch], chunks: list[Asked], k: int, schema: T.StructType
) -> Iterator[pa.Table]:
    """At most k rows per query, the nearest of all batches, chunk by chunk of the queries."""
    target = to_arrow_schema(schema)
    held = [_Best(asked, k) for asked in chunks]
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = _Slice(batch.slice(at, SLICE_ROWS), chunks[0].by_cell)
            for own in held:
                own.offer(part)
    for own in held:
        best = own.merged()
        if best is not None:
            best = best.assign(query_id=own.asked.ids[best["q"].to_numpy()])
            yield pa.Table.from_pandas(best[target.names], schema=target, preserve_index=False)


def _nearest_in(part: _Slice, asked: Asked, limit: np.ndarray, k: int) -> pd.DataFrame | None:
    """The k nearest rows of one slice for every query; of equal distances the smaller ids."""
    found = []
    for key in part.rows:
        positions, units = asked.of(key)
        if not len(positions):
            continue
        rows, matrix = part.units(key)
        if not len(rows):
            continue
        distance = 1 - units @ matrix.T
        # Most rows are beyond most limits: only what may be near is rounded and told apart.
        near = distance <= (limit[positions] + SLACK)[:, None]
        crowded = np.flatnonzero(np.count_nonzero(near, axis=1) > k)
        if len(crowded):
            full = np.round(distance[crowded], RANKED_DECIMALS) + 0.0
            last = np.partition(full, k - 1, axis=1)[:, k - 1 : k]
            below, level = full < last, full == last
            room = k - below.sum(axis=1, keepdims=True)
            near[crowded] = below | (level & (level.cumsum(axis=1) <= room))
        which, at = np.nonzero(near)
        ranked = np.round(distance[which, at], RANKED_DECIMALS) + 0.0
        kept = ranked <= limit[positions[which]]
        which, at, ranked = which[kept], at[kept], ranked[kept]
        if len(which):
            hits = part.rest.take(pa.array(rows[at])).to_pandas()
            hits["q"] = positions[which]
            hits["distance"] = ranked
            found.append(hits)
    return pd.concat(found, ignore_index=True) if found else None
