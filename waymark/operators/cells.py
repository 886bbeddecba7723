"""Approximate top-k over cells: a trained coarse quantiser and an index stored by cell.

Centroids come from k-means on a bounded sample of the index, the rows of least hashed id, and
every row is stored in the folder of its nearest centroid's cell. A search looks into
the cells whose centroids are nearest to the query, and no file of another cell is opened. How many
is not guessed: at build time a bounded set of stored rows is searched exactly, and the
number of cells is the least that finds the wanted share of their neighbours. Beyond that, a query
looks into further cells until they hold the k rows it asks for.
"""

from __future__ import annotations

import json
import math
from functools import cached_property, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.operators.knn import DEFAULT_K, MAX_BROADCAST_QUERIES, CELL, Asked, chunk_groups, knn, query_chunks, rank_hits, scan
from waymark.session import fresh_path, materialise

# The sample that centroids are fitted on: rows, and bytes of doubles, at most.
SAMPLE_ROWS = 1 << 16
SAMPLE_BYTES = 64 << 20
# Cells at most, sampled rows per cell at least, rounds of k-means.
MAX_CELLS = 4096
ROWS_PER_CELL = 16
ROUNDS = 4
# Stored rows, the last of the sample (the first are where cells begin), that are searched exactly
# to set the number of probes, and the share of their neighbours (themselves not counted) that
# must lie in the cells probed.
CALIBRATION = 256
TARGET = 0.97
# Chunks of queries that go over the cells in one job; each has the places of its queries by cell.
SEARCH_CHUNKS = 4
# Decimals at which similarities to centroids, and centroids, count as equal.
SIMILAR_DECIMALS = 9
CENTROID_DECIMALS = 6
# Column of the widths and, in `knn`, of the cells of stored rows.
WIDTH = "ann_width"
_MODEL = "width int, cell int, centroid array<double>, n_rows long, probes int"


class Quantiser(NamedTuple):
    """Unit centroids of one vector width, the rows of each cell, and how many cells a search looks into."""

    centroids: np.ndarray
    sizes: np.ndarray
    probes: int

    def probed(self, rows: np.ndarray, k: int, probes: int) -> list[list[int]]:
        """The cells that each unit vector looks into: `probes`, and more until they hold k rows."""
        order = nearest_cells(rows, self.centroids, len(self.centroids))
        held = np.cumsum(self.sizes[order], axis=1)
        enough = np.maximum(probes, (held < k).sum(axis=1) + 1)
        return [cells[:n] for cells, n in zip(order.tolist(), enough.tolist())]


def sample_order(key: str = "id") -> Column:
    return F.md5(F.col(key).cast("string"))


def units(vectors) -> np.ndarray:
    rows = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def usable(vector: str = "vector") -> Column:
    """Vectors with a length: finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest_cells(rows: np.ndarray, centroids: np.ndarray, count: int) -> np.ndarray:
    """The `count` nearest centroids of each row, nearest first; of equal ones the smaller number."""
    similar = np.round(rows @ centroids.T, SIMILAR_DECIMALS) + 0.0
    return np.argsort(-similar, axis=1, kind="stable")[:, :count]


def train(rows: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit `rows`: the first `cells` rows, moved to the mean of what is nearest to them."""
    centroids = np.round(rows[:cells], CENTROID_DECIMALS)
    for _ in range(rounds):
        own = nearest_cells(rows, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        norms = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        moved = norms > 0
        centroids[moved] = np.round(sums[moved] / norms[moved, None], CENTROID_DECIMALS)
    return centroids


def cell_count(rows: int, sampled: int) -> int:
    return max(1, min(MAX_CELLS, math.ceil(math.sqrt(rows)), sampled // ROWS_PER_CELL))


def _cell_of(models: dict[int, Quantiser]):
    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        out = pd.Series([0] * len(vectors), dtype="int32")
        widths = vectors.map(len)
        for width in widths.unique():
            at = (widths == width).to_numpy()
            if int(width) in models:
                out[at] = nearest_cells(units(vectors[at]), models[int(width)].centroids, 1)[:, 0].astype("int32")
        return out

    # Run once: a filter on the cell must not be pushed below.
    return cell.asNondeterministic()


class CellIndex:
    """An index stored by cell below one folder, with its centroids."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromJson(json.loads(spark.read.schema("schema string").parquet(f"{self.path}/schema").first()[0]))
        found: dict[int, list] = {}
        for row in spark.read.schema(_MODEL).parquet(f"{self.path}/model").collect():
            found.setdefault(row.width, []).append(row)
        self.models = {
            width: Quantiser(np.array([r.centroid for r in rows]), np.array([r.n_rows for r in rows]), rows[0].probes)
            for width, rows in ((w, sorted(r, key=lambda r: r.cell)) for w, r in found.items())
        }

    @classmethod
    def build(
        cls, index: DataFrame, path: str, k: int = DEFAULT_K, payload: tuple[str, ...] = (),
        target: float = TARGET, sample_rows: int = SAMPLE_ROWS,
    ) -> CellIndex:
        """Fit cells on `index` (`id`, `vector`), store its rows by cell and measure the probes for `k`.

        Vectors that are null, zero or not finite are near nothing and are not stored. Every width
        has cells of its own.
        """
        spark = index.sparkSession
        rows = index.select("id", "vector", *payload).where(usable()).withColumn(WIDTH, F.size("vector"))
        models, asked = {}, None
        for width, count in sorted(tuple(r) for r in rows.groupBy(WIDTH).count().collect()):
            limit = min(sample_rows, max(1, SAMPLE_BYTES // (8 * width)))
            own = rows.where(F.col(WIDTH) == width)
            sample = own.orderBy(sample_order(), "id").limit(limit).select("id", "vector").collect()
            centroids = train(units([r.vector for r in sample]), cell_count(count, len(sample)))
            models[width] = Quantiser(centroids, np.zeros(len(centroids), dtype=np.int64), 1)
            test = spark.createDataFrame(
                [(r.id, r.vector) for r in sample[-CALIBRATION:]], own.select(F.col("id").alias("query_id"), "vector").schema
            )
            asked = test if asked is None else asked.unionByName(test)
        cell = _cell_of(models)(F.col("vector")).alias(CELL)
        # One or more files per cell: what is too much for one task is split.
        placed = rows.select("id", "vector", *payload, WIDTH, cell).hint("rebalance", WIDTH, CELL)
        placed.write.partitionBy(WIDTH, CELL).parquet(f"{path}/rows")
        schema = T.StructType([*rows.schema.fields, T.StructField(CELL, T.IntegerType())])
        stored = spark.read.schema(schema).parquet(f"{path}/rows")
        for row in stored.groupBy(WIDTH, CELL).count().collect():
            models[row[WIDTH]].sizes[row[CELL]] = row["count"]
        if asked is not None:
            models = cls._calibrated(stored, models, asked, k, target)
        described = [
            (width, n, c.tolist(), int(model.sizes[n]), model.probes)
            for width, model in models.items() for n, c in enumerate(model.centroids)
        ]
        spark.createDataFrame(described, _MODEL).write.parquet(f"{path}/model")
        spark.createDataFrame([(schema.json(),)], "schema string").write.parquet(f"{path}/schema")
        return cls(spark, path)

    @staticmethod
    def _calibrated(
        stored: DataFrame, models: dict[int, Quantiser], asked: DataFrame, k: int, target: float
    ) -> dict[int, Quantiser]:
        """The models with the least number of probes that reaches `target` for the rows `asked`."""
        near = knn(stored.select("id", "vector", CELL), asked, k + 1, (CELL,))
        # A row is its own nearest; it says nothing about its neighbours.
        others = near.where(F.col("query_id") != F.col("id")).groupBy("query_id").agg(
            F.slice(F.transform(F.sort_array(F.collect_list(F.struct("rank", CELL))), lambda h: h[CELL]), 1, k).alias("cells")
        )
        needed: dict[int, list[int]] = {}
        for row in asked.join(others, "query_id").select("vector", "cells").toLocalIterator():
            centroids = models[len(row.vector)].centroids
            order = nearest_cells(units([row.vector]), centroids, len(centroids))[0].tolist()
            needed.setdefault(len(row.vector), []).extend(order.index(c) + 1 for c in row.cells)
        for width, ranks in needed.items():
            if ranks:
                reached = sorted(ranks)[math.ceil(target * len(ranks)) - 1]
                models[width] = models[width]._replace(probes=reached)
        return models

    @property
    def n_rows(self) -> int:
        return int(sum(m.sizes.sum() for m in self.models.values()))

    @cached_property
    def rows(self) -> DataFrame:
        """The stored rows; their folders are listed once."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def search(
        self, queries: DataFrame, k: int = DEFAULT_K, payload: tuple[str, ...] = (), probes: int | None = None,
        max_queries: int = MAX_BROADCAST_QUERIES, where: Column | None = None, hidden: DataFrame | None = None,
        n_hidden: int = 0, shown: bool = True,
    ) -> DataFrame:
        """Like `knn` over the rows in each query's nearest cells; `probes` overrides the measured number.

        Rows that do not meet `where`, or whose `id` is among the `n_hidden` ones of `hidden`, a number
        checked to be small, are not found; cells are looked into until they hold as many rows more.
        Without `shown`, distances are as they were ranked.
        At most `max_queries` go over the index at a time.
        """
        index = self.rows if where is None else self.rows.where(where)
        if hidden is not None:
            index = index.join(F.broadcast(hidden), "id", "left_anti")
        index = index.select("id", "vector", *payload, WIDTH, CELL)
        queries = queries.select("query_id", "vector").where(usable())
        groups = chunk_groups(query_chunks(queries, max_queries), SEARCH_CHUNKS)

        def ranked(chunks: list[list]) -> DataFrame:
            passes = [self._asked(rows, k + n_hidden, probes) for rows in chunks]
            hits = [scan(index.where(wanted), queries, asked, k) for asked, wanted in passes]
            return rank_hits(reduce(DataFrame.unionByName, hits), k, shown)

        near, second = ranked(next(groups, [[]])), next(groups, None)
        if second is not None:
            near = materialise(near, "cell-hits")
        while second is not None:
            near = near.unionByName(materialise(ranked(second), "cell-hits"))
            second = next(groups, None)
        return near.drop(WIDTH, CELL)

    def _asked(self, head: list, k: int, probes: int | None) -> tuple[Asked, Column]:
        """The queries by the cells they look into, and the folders those are."""
        by_cell: dict[tuple[int, int], list] = {}
        for width in {len(r.vector) for r in head} & set(self.models):
            model = self.models[width]
            own = [at for at, r in enumerate(head) if len(r.vector) == width]
            near = model.probed(units([head[at].vector for at in own]), k, probes or model.probes)
            for at, cells in zip(own, near):
                for cell in cells:
                    by_cell.setdefault((width, cell), []).append(at)
        wanted = F.lit(False)
        for width in {w for w, _ in by_cell}:
            cells = [c for w, c in by_cell if w == width]
            wanted = wanted | ((F.col(WIDTH) == width) & F.col(CELL).isin(cells))
        return Asked([r.query_id for r in head], [r.vector for r in head], by_cell), wanted


def ann(
    index: DataFrame, queries: DataFrame, k: int = DEFAULT_K, payload: tuple[str, ...] = (), target: float = TARGET
) -> DataFrame:
    """Approximate top-k of an index that is not stored by cell yet: one is built for these queries.

    Worth it for many queries; a stored index keeps its cells (`IndexStore.cells`).
    """
    path = fresh_path(index.sparkSession, "cells")
    return CellIndex.build(index, path, k, payload, target).search(queries, k, payload)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact hits the approximate search also returned."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "id"], "left").agg(
        F.count("*").alias("n_exact"),
        F.count("hit").alias("n_found"),
        (F.count("hit") / F.count("*")).alias("recall"),
    )
