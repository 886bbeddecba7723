"""Bring an index in step with a corpus."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.hashing import content_hash
from waymark.operators.diff import rows_on_paths, stale_paths, upload_set
from waymark.operators.embed import FAILED, NO_VECTOR, OK, SHORT, BatchProvider, ColumnProvider, embed
from waymark.operators.extract import chunk_table
from waymark.operators.filters import MAX_BYTES, size_filter
from waymark.operators.filetypes import SUPPORTED_TYPES
from waymark.operators.stats import broken_rules
from waymark.session import counted, materialise, temporary
from waymark.sources.corpus import SPREAD_BYTES
from waymark.sources.index import IndexStore

STATUSES = (OK, NO_VECTOR, FAILED, SHORT)


class SyncReport(NamedTuple):
    """What a sync did, and what it saw on the way.

    `left_out` counts files of the corpus that are never split: empty, too large, of no type asked
    for. `broken` counts new units that break a rule (`stats.broken_rules`).
    """

    version: int | None
    changed: bool
    n_upload: int
    n_delete: int
    statuses: dict[str, int]
    left_out: dict[str, int] = {}
    broken: dict[str, int] = {}


def sync(
    store: IndexStore,
    namespace: str,
    corpus: DataFrame,
    provider: ColumnProvider | BatchProvider,
    types: tuple[str, ...] = SUPPORTED_TYPES,
    by: str = "id",
    partial: bool = False,
    token: str | None = None,
    max_bytes: int = MAX_BYTES,
) -> SyncReport:
    """Publish a version of the index that matches a typed corpus.

    Only files whose fingerprint is not known, or that had units fail, are split into units;
    the ids of those are compared with the index, and only new ones are embedded. A file is
    known once it was handled, whether or not it gave a unit with a vector. What was embedded
    is written before it is published, so a retry of the write does not embed again.
    With `partial` the corpus holds some paths only and rows on other paths stay (a stream's
    arrivals); otherwise they are deleted. `changed` says that rows were added or deleted.
    The corpus is read twice: for its fingerprints, and for the texts of changed files, which are
    written by type. Counts are taken while those are written; temporary tables go at the end.
    """
    if by not in ("id", "path"):
        raise ValueError(f"by must be 'id' or 'path', not {by!r}")
    replayed = None if token is None else store.published(namespace, token)
    if replayed is not None:
        return SyncReport(replayed, False, 0, 0, {})
    with temporary(store.spark):
        return _sync(store, namespace, corpus, provider, types, by, partial, token, max_bytes)


class Seen(NamedTuple):
    """Fingerprints of all files, written; why files are left out; the types there are to split; their bytes."""

    prints: DataFrame
    left_out: dict[str, int]
    types: tuple[str, ...]
    n_bytes: int


def fingerprinted(corpus: DataFrame, types: tuple[str, ...], max_bytes: int) -> Seen:
    """One pass over a corpus, of which only what identifies a file is kept; a `file_hash` is taken as it is."""
    size = F.coalesce(F.col("size"), F.lit(0))
    fits = (size > 0) & (size <= max_bytes)
    wanted = fits & F.coalesce(F.col("type").isin(*types), F.lit(False))
    file_hash = F.col("file_hash") if "file_hash" in corpus.columns else content_hash(F.col("content"))
    prints, seen = counted(
        corpus.select(
            "path", file_hash.alias("file_hash"), F.col("mtime").alias("file_mtime"),
            F.col("ctime").alias("file_ctime"), "size", "type",
        ),
        "prints",
        empty=F.count_if(size <= 0),
        too_large=F.count_if(size > max_bytes),
        type=F.count_if(fits & ~wanted),
        n_bytes=F.sum(F.when(wanted, size).otherwise(0)),
        **{f"of_{t}": F.count_if(fits & (F.col("type") == t)) for t in types},
    )
    present = tuple(t for t in types if seen[f"of_{t}"])
    left_out = {k: seen[k] for k in ("empty", "too_large", "type")}
    return Seen(prints.drop("size", "type"), left_out, present, seen["n_bytes"] or 0)


def embedded_units(
    corpus: DataFrame, index: DataFrame | None, provider: ColumnProvider | BatchProvider, seen: Seen, max_bytes: int
) -> tuple[DataFrame, dict[str, int], dict[str, int]]:
    """Embedded units that `index` does not hold, written; how many by status; broken rules."""
    # Written by type, so that each type's plan reads its own files only; a small corpus in enough
    # files to keep all cores busy.
    texts = size_filter(corpus.where(F.col("type").isin(*seen.types)), max_bytes)
    texts = texts.select("path", "content", "size", "mtime", "ctime", "type")
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    if seen.n_bytes < cores * SPREAD_BYTES:
        texts = texts.repartition(cores)
    units = chunk_table(materialise(texts, "texts", by="type"), seen.types, max_bytes)
    uploads = units if index is None else upload_set(units, index)
    metrics = {f"status_{s}": F.count_if(F.col("status") == s) for s in STATUSES}
    embedded, got = counted(embed(uploads.dropDuplicates(["path", "id"]), provider), "embedded", **metrics, **broken_rules())
    statuses = {s: got[f"status_{s}"] for s in STATUSES if got[f"status_{s}"]}
    return embedded, statuses, {rule: got[rule] for rule in broken_rules()}


def _sync(
    store: IndexStore, namespace: str, corpus: DataFrame, provider: ColumnProvider | BatchProvider,
    types: tuple[str, ...], by: str, partial: bool, token: str | None, max_bytes: int,
) -> SyncReport:
    at = store.version(namespace)
    index, first = store.read(namespace, at), at is None
    found = fingerprinted(corpus, types, max_bytes)
    prints, left_out = found.prints, found.left_out
    n_files = F.count("*")
    if first:
        changed_corpus, new_files, n_new, old_retry, n_retry = corpus, prints, 1, None, 0
    else:
        files, old_retry = store.files(namespace, at), store.retry_paths(namespace, at)
        known = index.select("path", "file_hash").unionByName(files.select("path", "file_hash"))
        new_files = prints.join(known.distinct(), ["path", "file_hash"], "left_anti")
        if not partial:
            removed = files.select("path").join(prints.select("path"), "path", "left_anti")
            nothing = [F.lit(None).cast(f).alias(c) for c, f in (("file_hash", "string"), ("file_mtime", "timestamp"))]
            new_files = new_files.drop("file_ctime").unionByName(removed.select("path", *nothing))
        new_files, seen = counted(new_files, "files", n=n_files, held=F.count("file_hash"))
        n_new = seen["n"]
        # Written, so that its size is known when the corpus is joined: usually few paths,
        # and then no source text is shuffled to find them.
        changed = new_files.where("file_hash IS NOT NULL").select("path").unionByName(old_retry).distinct()
        changed, seen = counted(changed, "changed", n=n_files)
        changed_corpus = corpus.join(changed, "path", "left_semi")
        found = found if seen["n"] else found._replace(types=())
        n_retry = 0 if old_retry.isEmpty() else 1

    embedded, statuses, broken = None, {}, {}
    if found.types:
        embedded, statuses, broken = embedded_units(changed_corpus, None if first else index, provider, found, max_bytes)
    deletes, n_delete = None, 0
    if not first:
        scope = rows_on_paths(index, prints) if partial else index
        gone = scope.join(
            prints.select("path", "file_hash"), ["path", "file_hash"], "left_anti"
        ).select("id", "path")
        if by == "path":
            gone = rows_on_paths(index, stale_paths(gone)).select("id", "path")
        deletes, seen = counted(gone, "deletes", n=n_files)
        n_delete = seen["n"]

    n_upload = sum(statuses.values())
    changed_any = bool(statuses.get(OK) or n_delete)
    # A unit that can have no vector is done; one that failed is tried again, as are those of
    # paths that did not come this time.
    retry_moved = bool(statuses.get(FAILED) or statuses.get(SHORT))
    retry = old_retry.limit(0) if embedded is None and n_retry else None
    if embedded is not None:
        retry = embedded.where(F.col("status").isin(FAILED, SHORT)).select("path").distinct()
    if n_retry:
        if partial:
            waiting = old_retry.join(prints.select("path"), "path", "left_anti")
            retry = retry.unionByName(waiting).distinct()
        retry = materialise(retry, "retry")
        retry_moved = not (
            retry.join(old_retry, "path", "left_anti").isEmpty()
            and old_retry.join(retry, "path", "left_anti").isEmpty()
        )
    if not (changed_any or retry_moved or n_new or first):
        return SyncReport(at, False, n_upload, 0, statuses, left_out, broken)
    version = store.publish(
        namespace,
        embedded.where(F.col("status") == OK) if statuses.get(OK) else None,
        deletes if n_delete else None,
        retry=retry if retry_moved else None,
        token=token,
        replace=by == "path",
        files=new_files if n_new else None,
        expected=at,
        unique=True,
    )
    if not partial and store.crowded(namespace):
        version = store.compact(namespace)
    return SyncReport(version, changed_any, n_upload, n_delete, statuses, left_out, broken)


def rebuild(
    store: IndexStore,
    namespace: str,
    corpus: DataFrame,
    provider: ColumnProvider | BatchProvider,
    types: tuple[str, ...] = SUPPORTED_TYPES,
    max_bytes: int = MAX_BYTES,
) -> SyncReport:
    """Drop a namespace's rows and index the whole corpus again, in one version.

    If another version is published meanwhile, StaleVersion is raised.
    """
    at = store.version(namespace)
    with temporary(store.spark):
        found = fingerprinted(corpus, types, max_bytes)
        embedded, statuses, broken = None, {}, {}
        if found.types:
            embedded, statuses, broken = embedded_units(corpus, None, provider, found, max_bytes)
        failed = bool(statuses.get(FAILED) or statuses.get(SHORT))
        version = store.publish(
            namespace,
            embedded.where(F.col("status") == OK) if statuses.get(OK) else None,
            retry=embedded.where(F.col("status").isin(FAILED, SHORT)) if failed else None,
            files=found.prints,
            base=True,
            expected=at,
            unique=True,
        )
    return SyncReport(version, True, sum(statuses.values()), 0, statuses, found.left_out, broken)
