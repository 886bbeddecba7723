"""Answer queries from an index: embed, rank, look up the source, format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.cells import ann
from waymark.operators.embed import OK, BatchProvider, ColumnProvider, embed
from waymark.operators.filetypes import SUPPORTED_TYPES
from waymark.operators.filters import split_blank_queries
from waymark.operators.filters import MAX_BYTES
from waymark.operators.knn import DEFAULT_K, knn, rank_hits
from waymark.operators.results import format_results, hydrate
from waymark.plans.sync import sync
from waymark.session import counted, materialise
from waymark.sources.corpus import FileSource, TableSource
from waymark.sources.index import IndexStore

PAYLOAD = ("path", "start_line", "end_line", "file_hash")
Source = DataFrame | FileSource | TableSource


def search_index(
    index: DataFrame,
    queries: DataFrame,
    corpus: Source,
    provider: ColumnProvider | BatchProvider,
    root: str | Column = "",
    k: int = DEFAULT_K,
    scores: bool = False,
    approximate: bool = False,
    where: Column | None = None,
) -> DataFrame:
    """One row per hit (`status` ok) and one per query that could not be asked.

    `queries` has `query_id` and `query`; `index` has vectors. `where` restricts the index
    rows that are ranked.
    """
    if where is not None:
        index = index.where(where)
    find = ann if approximate else knn
    return _answered(lambda asked: find(index, asked, k, PAYLOAD), queries, corpus, provider, root, scores)


def _answered(find, queries: DataFrame, corpus: Source, provider, root: str | Column, scores: bool) -> DataFrame:
    usable, blank = split_blank_queries(queries.select("query_id", "query"))
    asked = materialise(embed(usable, provider, "query", "query"), "queries")
    hits, seen = counted(find(asked.where(F.col("status") == OK)), "hits", n=F.count("*"))
    shown = format_results(hydrate(hits, corpus, max_hits=seen["n"]), root, scores).select(
        "query_id", "rank", "path", "start_line", "end_line", "distance", "line", "stale"
    )
    failed = asked.where(F.col("status") != OK).select("query_id", "status")
    unanswered = blank.select("query_id", "status").unionByName(failed)
    return shown.withColumn("status", F.lit(OK)).unionByName(
        unanswered, allowMissingColumns=True
    )


def search_cells(
    store: IndexStore, namespace: str, version: int, asked: DataFrame, k: int = DEFAULT_K, where: Column | None = None
) -> DataFrame:
    """Approximate top-k of a stored version: rows by cell, and what was published since, exactly."""
    stored, at = store.cells(namespace, version, PAYLOAD)
    if at == version:
        return stored.search(asked, k, PAYLOAD, where=where)
    hidden, n_hidden = store.hidden(namespace, at, version), store.n_hidden(namespace, at, version)
    old = stored.search(asked, k, PAYLOAD, where=where, hidden=hidden, n_hidden=n_hidden, shown=False)
    added = store.added(namespace, at, version)
    new = knn(added if where is None else added.where(where), asked, k, PAYLOAD, shown=False)
    return rank_hits(old.drop("rank").unionByName(new.drop("rank")), k)


def search(
    store: IndexStore,
    namespace: str,
    queries: DataFrame,
    corpus: Source,
    provider: ColumnProvider | BatchProvider,
    refresh: bool = True,
    types: tuple[str, ...] = SUPPORTED_TYPES,
    root: str | Column = "",
    k: int = DEFAULT_K,
    scores: bool = False,
    approximate: bool = False,
    where: Column | None = None,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Search a stored index; with `refresh`, the version a sync of the corpus has produced.

    `approximate` looks into the index's nearest cells only (`IndexStore.cells`). Files over
    `max_bytes` are not split; the sync's report counts them.
    """
    if refresh:
        files = corpus if isinstance(corpus, DataFrame) else corpus.files
        version = sync(store, namespace, files, provider, types, max_bytes=max_bytes).version
    else:
        version = store.version(namespace)
        if version is None:
            raise ValueError(f"namespace {namespace!r} has no index; sync it first")
    if approximate:
        find = lambda asked: search_cells(store, namespace, version, asked, k, where)
        return _answered(find, queries, corpus, provider, root, scores)
    index = store.read(namespace, version, vectors=True)
    return search_index(index, queries, corpus, provider, root, k, scores, where=where)
