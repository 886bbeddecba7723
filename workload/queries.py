"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.hashing import content_hash
from waymark.functions.text import epoch_seconds
from waymark.operators import diff
from waymark.operators.cells import ann, recall
from waymark.operators.code import code_units
from waymark.operators.embed import (
    BatchProvider,
    BatchTooLarge,
    Response,
    embed,
    hashed_provider,
    token_total,
)
from waymark.operators.extract import chunk_table
from waymark.operators.filetypes import TABLE_RULES, assign_type
from waymark.operators.filters import attribute_filter, size_filter, split_blank_queries
from waymark.operators.html import page_block_units, page_comment_units, page_units
from waymark.operators.identity import fingerprints, identify, with_namespace
from waymark.operators.knn import knn
from waymark.operators.markdown import markdown_units
from waymark.operators.prose import prose_units
from waymark.operators.results import format_results, hydrate
from waymark.operators.roots import assign_root, marker_dirs
from waymark.operators.sampling import seeded_sample
from waymark.operators.stats import check_chunks, corpus_stats
from waymark.plans.search import search_index
from waymark.plans.sync import rebuild, sync
from waymark.schema import CORPUS
from waymark.session import fresh_path, materialise
from waymark.sources.corpus import corpus_from_table, decode_utf8, latest_per_path, scan_files, scan_tree
from waymark.sources.index import IndexStore, keyset_page, upload_projection
from waymark.streaming.continuous import continuous_sync
from workload import tables as t
from workload.languages import NESTED

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


# --- corpus ------------------------------------------------------------------------------


@register
def corpus_filter(spark, sf_dir):
    return size_filter(t.document_corpus(spark, sf_dir), 5_000).select("path", "size")


@register
def scanned_files(spark, sf_dir):
    """Documents written as files, some under hidden names and folders, and scanned."""
    base = t.document_files(spark, sf_dir)
    name = F.element_at(F.split("path", re.escape(base.rpartition("/")[2] + "/")), -1)
    return scan_files(spark, base).select(name.alias("name"), "size", F.md5("content").alias("text_hash"))


@register
def scanned_links(spark, sf_dir):
    """The same files with links to some and loops among them: every file once, links told."""
    base = t.linked_files(spark, sf_dir)
    found = scan_tree(spark, base)
    name = F.element_at(F.split("path", re.escape(base.rpartition("/")[2] + "/")), -1).alias("name")
    files = found.files.select(name, F.md5("content").alias("text_hash"), F.lit(None).cast("string").alias("reason"))
    return files.unionByName(found.skipped.select(name, "reason"), allowMissingColumns=True)


@register
def type_assignment(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    ext = F.element_at(
        F.array(*[F.lit(e) for e in t.EXTENSIONS]),
        (F.col("doc_id") % len(t.EXTENSIONS) + 1).cast("int"),
    )
    doc_paths = docs.select(F.concat(F.lit("/"), "source", F.lit("/f"), "doc_id", F.lit("."), ext).alias("path"))
    page_paths = t.table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    return assign_type(doc_paths.unionByName(page_paths), TABLE_RULES).select("path", "type")


@register
def utf8_filter(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    raw = F.encode("text", "UTF-8")
    spoiled = F.when(F.col("doc_id") % 7 == 0, F.concat(raw, F.lit(b"\xff\xc0"))).otherwise(raw)
    kept = decode_utf8(docs.select("doc_id", spoiled.alias("content")))
    return kept.select("doc_id", F.md5("content").alias("text_hash"))


@register
def fingerprint(spark, sf_dir):
    return fingerprints(t.document_corpus(spark, sf_dir)).select(
        "path",
        "file_hash",
        epoch_seconds(F.col("file_mtime")).alias("mtime"),
        epoch_seconds(F.col("file_ctime")).alias("ctime"),
    )


@register
def content_hashes(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    return docs.select("doc_id", content_hash("text").alias("chunk_hash"))


@register
def latest_versions(spark, sf_dir):
    now = t.document_corpus(spark, sf_dir)
    earlier = t.changed_corpus(spark, sf_dir).withColumn(
        "mtime", F.col("mtime") - F.expr("interval 1 hour")
    )
    newest = latest_per_path(now.unionByName(earlier))
    return newest.select("path", F.md5("content").alias("file_hash"))


@register
def namespaces(spark, sf_dir):
    roots = t.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/"), "source").alias("root")
    )
    return with_namespace(roots.distinct(), "root", "hashed64")


@register
def project_roots(spark, sf_dir):
    pages = t.table(spark, sf_dir, "pages")
    path = F.concat(F.lit("/"), F.regexp_replace("url", r"^https?://|\?.*$", ""))
    files = pages.select("page_id", path.alias("path"))
    marks = files.select(
        F.when(
            F.col("page_id") % 3 == 0,
            F.concat(F.regexp_extract("path", r"^/[^/]*", 0), F.lit("/package.json")),
        )
        .when(
            F.col("page_id") % 3 == 1,
            F.concat(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("/.git/config")),
        )
        .otherwise(F.lit("/readme.txt"))
        .alias("path")
    )
    return assign_root(files, marker_dirs(marks))


# --- units -------------------------------------------------------------------------------


def _unit_rows(units: DataFrame) -> DataFrame:
    return units.select(
        "path",
        "kind",
        F.col("start_line").cast("bigint").alias("start_line"),
        F.col("end_line").cast("bigint").alias("end_line"),
        F.md5("content").alias("chunk_hash"),
    )


@register
def prose_blocks(spark, sf_dir):
    return _unit_rows(prose_units(t.spaced_corpus(spark, sf_dir)))


@register
def chunk_ids(spark, sf_dir):
    rows = t.chunks(t.spaced_corpus(spark, sf_dir))
    return rows.select(
        "id",
        "path",
        "file_hash",
        "chunk_hash",
        epoch_seconds(F.col("file_mtime")).alias("mtime"),
    )


@register
def page_blocks(spark, sf_dir):
    return _unit_rows(page_block_units(t.page_corpus(spark, sf_dir)))


@register
def page_heading_context(spark, sf_dir):
    return _unit_rows(page_units(t.page_corpus(spark, sf_dir)))


@register
def page_comment_attach(spark, sf_dir):
    return _unit_rows(page_comment_units(t.page_corpus(spark, sf_dir)))


@register
def markdown_blocks(spark, sf_dir):
    return _unit_rows(markdown_units(t.markdown_corpus(spark, sf_dir)))


@register
def source_units(spark, sf_dir):
    return _unit_rows(code_units(t.source_files(spark, sf_dir)))


@register
def language_units(spark, sf_dir):
    """Units of all ten code types: nested, one-line, bodiless and commented ones."""
    return _unit_rows(code_units(t.language_files(spark, sf_dir)))


@register
def nested_units(spark, sf_dir):
    """Units of files whose literals nest: templates, here-documents, interpolations, raw strings."""
    return _unit_rows(code_units(t.language_files(spark, sf_dir, NESTED)))


@register
def long_units(spark, sf_dir):
    """Units of texts beyond the default size bound."""
    return t.chunks(t.long_corpus(spark, sf_dir)).select(
        "path", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), "chunk_hash"
    )


@register
def left_out_files(spark, sf_dir):
    """What a sync with the default bound says of the same texts."""
    store = IndexStore(spark, fresh_path(spark, "index"))
    report = sync(store, "docs", t.long_corpus(spark, sf_dir), hashed_provider(), ("prose",))
    return store.read("docs").agg(
        F.countDistinct("path").alias("n_paths"),
        F.lit(report.left_out["too_large"]).cast("bigint").alias("n_too_large"),
        F.lit(sum(report.broken.values())).cast("bigint").alias("n_broken"),
    )


@register
def chunk_checks(spark, sf_dir):
    return check_chunks(t.chunks(t.spaced_corpus(spark, sf_dir)))


@register
def broken_chunks(spark, sf_dir):
    """The checks over chunks of which one in seven breaks each rule."""
    chunks = t.chunks(t.spaced_corpus(spark, sf_dir))
    kind = F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint") % 7
    broken = chunks.withColumn("k", kind).withColumns(
        {
            "path": F.when(F.col("k") != 0, F.col("path")),
            "start_line": F.when(F.col("k") == 1, F.lit(0)).otherwise(F.col("start_line")),
            "end_line": F.when(F.col("k") == 2, F.col("start_line") - 1).otherwise(F.col("end_line")),
            "content": F.when(F.col("k") == 3, F.lit("")).otherwise(F.col("content")),
            "chunk_hash": F.when(F.col("k") != 4, F.col("chunk_hash")),
            "id": F.when(F.col("k") == 5, F.lit("")).otherwise(F.col("id")),
        }
    )
    return check_chunks(broken)


@register
def corpus_statistics(spark, sf_dir):
    corpus = t.source_files(spark, sf_dir)
    return corpus_stats(identify(code_units(corpus)), corpus)


@register
def sampled_lines(spark, sf_dir):
    """A sample too large for one task, of the order lines."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id")
    return seeded_sample(t.table(spark, sf_dir, "lineitem").select(key, "l_partkey"), 55_000, "lines")


@register
def sampled_chunks(spark, sf_dir):
    rows = t.chunks(t.document_corpus(spark, sf_dir))
    return seeded_sample(rows, 100, "/src0").select("path", "id")


# --- sync --------------------------------------------------------------------------------


def _local_and_index(spark, sf_dir):
    return (
        t.chunks(t.document_corpus(spark, sf_dir)),
        t.chunks(t.changed_corpus(spark, sf_dir)),
    )


@register
def diff_upload(spark, sf_dir):
    local, index = _local_and_index(spark, sf_dir)
    return diff.upload_set(local, index).select("id", "path")


@register
def diff_delete(spark, sf_dir):
    local, index = _local_and_index(spark, sf_dir)
    return diff.delete_set(local, index).select("id", "path")


@register
def stale_path_list(spark, sf_dir):
    local, index = _local_and_index(spark, sf_dir)
    return diff.stale_paths(diff.delete_set(local, index))


@register
def delete_by_path(spark, sf_dir):
    local, index = _local_and_index(spark, sf_dir)
    gone = diff.stale_paths(diff.delete_set(local, index))
    return diff.drop_paths(index, gone).select("id", "path")


@register
def applied_diff(spark, sf_dir):
    local, index = (materialise(side, "chunks") for side in _local_and_index(spark, sf_dir))
    after = diff.apply_diff(
        index, diff.upload_set(local, index), diff.delete_set(local, index)
    )
    return after.select("id", "path", "chunk_hash")


@register
def sync_report(spark, sf_dir):
    local, index = _local_and_index(spark, sf_dir)
    return diff.sync_counts(diff.diff_actions(local, index))


@register
def sync_unchanged(spark, sf_dir):
    """An index and the corpus it was made of, read back: nothing to do."""
    store = IndexStore(spark, fresh_path(spark, "index"))
    local = materialise(t.chunks(t.document_corpus(spark, sf_dir)), "local")
    store.publish("docs", upload_projection(local), unique=True)
    return diff.sync_counts(diff.diff_actions(local, store.read("docs")))


def _index_rows(index: DataFrame) -> DataFrame:
    return index.select(
        "id", "path", F.col("start_line").cast("bigint").alias("start_line"), "file_hash"
    )


@register
def stored_sync(spark, sf_dir):
    """Index the earlier state, then sync to the current one, through the stored index."""
    store = IndexStore(spark, fresh_path(spark, "index"))
    provider = hashed_provider()
    sync(store, "docs", t.changed_corpus(spark, sf_dir), provider, ("prose",), max_bytes=t.WHOLE)
    sync(store, "docs", t.document_corpus(spark, sf_dir), provider, ("prose",), max_bytes=t.WHOLE)
    return _index_rows(store.read("docs"))


@register
def sync_twice(spark, sf_dir):
    """A second sync of one corpus: nothing changed, no new version."""
    store = IndexStore(spark, fresh_path(spark, "index"))
    corpus = t.document_corpus(spark, sf_dir)
    first = sync(store, "docs", corpus, hashed_provider(), ("prose",), max_bytes=t.WHOLE)
    second = sync(store, "docs", corpus, hashed_provider(), ("prose",), max_bytes=t.WHOLE)
    return store.read("docs").agg(
        F.count("*").alias("n_rows"),
        F.lit(second.changed).alias("changed"),
        F.lit(second.version == first.version).alias("same_version"),
    )


@register
def duplicate_upserts(spark, sf_dir):
    """Every row upserted twice in one write and once more in the next: one row per id."""
    store = IndexStore(spark, fresh_path(spark, "index"))
    rows = embed(t.chunks(t.document_corpus(spark, sf_dir)), hashed_provider()).where("status = 'ok'")
    store.publish("docs", rows.unionByName(rows))
    store.publish("docs", store.read("docs", vectors=True))
    return _index_rows(store.read("docs"))


# Micro-batches that the files of a folder arrive in, or one for each file if they are fewer.
ARRIVALS = 4


def _arriving(spark, folder: str, batches: int) -> DataFrame:
    """The files of a folder of corpus rows as a stream, in about so many micro-batches."""
    rows = spark.read.parquet(folder)
    each = math.ceil(len(rows.inputFiles()) / batches)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(each, 1)).parquet(folder)


def _drained(spark, store: IndexStore, folder: str, checkpoint: str, batches: int = ARRIVALS) -> None:
    """All files of a folder of corpus rows through a stream."""
    stream = _arriving(spark, folder, batches)
    continuous_sync(
        stream,
        store,
        "docs",
        hashed_provider(),
        checkpoint,
        ("prose",),
        available_now=True,
        max_bytes=t.WHOLE,
        add_types=lambda df: assign_type(df, TABLE_RULES),
    ).awaitTermination()


@register
def stream_two_checkpoints(spark, sf_dir):
    """Two streams, each with its own checkpoint, one after the other into one index."""
    store = IndexStore(spark, fresh_path(spark, "index"))
    corpus = t.document_corpus(spark, sf_dir).select(*CORPUS.fieldNames())
    for half in (0, 1):
        folder = fresh_path(spark, "arrivals")
        corpus.where(F.pmod(F.xxhash64("path"), F.lit(2)) == half).write.parquet(folder)
        _drained(spark, store, folder, fresh_path(spark, "progress"))
    return _index_rows(store.read("docs"))


@register
def stream_late_rows(spark, sf_dir):
    """The current state arrives first; of the earlier one only paths not yet known count."""
    store = IndexStore(spark, fresh_path(spark, "index"))
    now = t.document_corpus(spark, sf_dir).select(*CORPUS.fieldNames())
    late = t.changed_corpus(spark, sf_dir).select(*CORPUS.fieldNames())
    late = late.withColumn("mtime", F.col("mtime") - F.expr("interval 1 hour"))
    for state in (now, late):
        folder = fresh_path(spark, "arrivals")
        state.write.parquet(folder)
        _drained(spark, store, folder, fresh_path(spark, "progress"))
    return _index_rows(store.read("docs"))


@register
def stream_removed(spark, sf_dir):
    """All documents arrive, then the removal of one in three, then older states of those."""
    store = IndexStore(spark, fresh_path(spark, "index"))
    now = t.document_corpus(spark, sf_dir).select(*CORPUS.fieldNames()).withColumn("op", F.lit(None).cast("string"))
    third = F.pmod(F.unix_timestamp("mtime"), F.lit(3)) == 0
    hour = F.expr("interval 1 hour")
    gone = now.where(third).withColumns({"content": F.lit(None).cast("string"), "op": F.lit("delete"), "mtime": F.col("mtime") + hour})
    checkpoint, folder = fresh_path(spark, "progress"), fresh_path(spark, "arrivals")
    for state in (now, gone, now.where(third)):
        state.write.mode("append").parquet(folder)
        # What is new in the folder is one micro-batch.
        _drained(spark, store, folder, checkpoint, batches=1)
    return _index_rows(store.read("docs"))


@register
def reset_index(spark, sf_dir):
    store = IndexStore(spark, fresh_path(spark, "index"))
    provider = hashed_provider()
    sync(store, "docs", t.changed_corpus(spark, sf_dir), provider, ("prose",), max_bytes=t.WHOLE)
    rebuild(store, "docs", t.document_corpus(spark, sf_dir), provider, ("prose",), max_bytes=t.WHOLE)
    return _index_rows(store.read("docs"))


@register
def stream_sync(spark, sf_dir):
    """The earlier state, then the current one, arriving as files of a stream."""
    arrivals = fresh_path(spark, "arrivals")
    columns = ["path", "content", "size", "mtime", "ctime"]
    earlier = t.changed_corpus(spark, sf_dir).select(*columns)
    now = t.document_corpus(spark, sf_dir).select(*columns)
    earlier = earlier.withColumn("mtime", F.col("mtime") - F.expr("interval 1 hour"))
    earlier.write.parquet(arrivals)
    now.write.mode("append").parquet(arrivals)
    stream = _arriving(spark, arrivals, 2)
    store = IndexStore(spark, fresh_path(spark, "index"))
    continuous_sync(
        stream,
        store,
        "docs",
        hashed_provider(),
        fresh_path(spark, "progress"),
        ("prose",),
        available_now=True,
        max_bytes=t.WHOLE,
        add_types=lambda df: assign_type(df, TABLE_RULES),
    ).awaitTermination()
    return _index_rows(store.read("docs"))


# --- embedding ---------------------------------------------------------------------------


@register
def hashed_embedding(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents", heavy=True)
    rows = embed(docs, hashed_provider(), text="text")
    return rows.select("doc_id", F.posexplode("vector").alias("bucket", "w")).select(
        "doc_id",
        F.col("bucket").cast("bigint").alias("bucket"),
        F.round(F.col("w").cast("double"), 5).alias("weight"),
    )


@register
def tokens_billed(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents", heavy=True)
    return token_total(embed(docs, hashed_provider(), text="text"))


def _strict_provider() -> BatchProvider:
    """Refuses batches over a size, reads no vector for texts without a letter e."""

    def call(texts: list[str], kind: str) -> Response:
        size = sum(len(x) for x in texts)
        if size > 6_000:
            raise BatchTooLarge(f"{size} characters")
        return Response([[float(len(x)), 1.0] if "e" in x else None for x in texts], size)

    return BatchProvider("strict", call)


@register
def embed_batches(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents", heavy=True)
    rows = embed(docs, _strict_provider(), text="text")
    return rows.groupBy("status").agg(
        F.count("*").alias("n"),
        F.sum(F.get("vector", F.lit(0)).cast("double")).alias("total"),
    )


@register
def short_responses(spark, sf_dir):
    """A provider that answers fewer vectors than it was given texts: the first ones are paired."""

    def call(texts: list[str], kind: str) -> Response:
        return Response([[float(len(x))] for x in texts[:-1]], None)

    docs = t.table(spark, sf_dir, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows = embed(docs, BatchProvider("short", call, 2), text="text")
    return rows.groupBy("status").agg(
        F.sum(F.when(F.col("vector").isNull() | (F.col("vector")[0] == F.length("text")), 0).otherwise(1)).alias("n_wrong"),
        (F.count("*") > 0).alias("seen"),
    )


@register
def embedding_kinds(spark, sf_dir):
    """Queries and documents are told apart; a text that is missing is never sent."""

    def call(texts: list[str], kind: str) -> Response:
        return Response([[float(len(x)), float(kind == "query")] for x in texts], None)

    docs = t.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("text")
    )
    parts = [embed(docs, BatchProvider("kinds", call), kind, "text").withColumn("kind", F.lit(kind)) for kind in ("query", "document")]
    return parts[0].unionByName(parts[1]).select(
        "doc_id", "kind", F.col("vector")[0].cast("bigint").alias("n_chars"), F.col("vector")[1].cast("bigint").alias("as_query")
    )


@register
def embed_token_total(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents", heavy=True)
    return token_total(embed(docs, _strict_provider(), text="text"))


# --- index reads -------------------------------------------------------------------------


@register
def index_projection(spark, sf_dir):
    local = upload_projection(t.chunks(t.document_corpus(spark, sf_dir)))
    return local.select(
        *[c for c in local.columns if c not in ("vector", "file_mtime", "file_ctime")],
        epoch_seconds(F.col("file_mtime")).alias("mtime"),
        epoch_seconds(F.col("file_ctime")).alias("ctime"),
        F.col("vector").isNull().alias("no_vector"),
    ).select(
        "id", "path", "file_hash", "chunk_hash", "mtime", "ctime", "no_vector",
        F.col("start_line").cast("bigint").alias("start_line"),
        F.col("end_line").cast("bigint").alias("end_line"),
    )


@register
def next_page(spark, sf_dir):
    rows = t.vectors(spark, sf_dir).drop("vector")
    return keyset_page(rows, 99, 150).select("id", F.col("label").cast("bigint").alias("label"))


@register
def attribute_predicates(spark, sf_dir):
    rows = t.vectors(spark, sf_dir)
    chosen = attribute_filter(("label", "Eq", 1), ("label", "Eq", 4), ("id", "Gt", 400))
    return rows.where(chosen).select("id", F.col("label").cast("bigint").alias("label"))


# --- search ------------------------------------------------------------------------------


def _hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "distance")


@register
def knn_exact(spark, sf_dir):
    return _hits(knn(t.vectors(spark, sf_dir), t.vector_queries(spark, sf_dir), 20))


@register
def knn_filtered(spark, sf_dir):
    rows = t.vectors(spark, sf_dir).where(attribute_filter(("label", "Eq", 3)))
    return _hits(knn(rows, t.vector_queries(spark, sf_dir), 5))


@register
def knn_blocks(spark, sf_dir):
    """The plan for query sets too large to send to every task."""
    rows, asked = t.vectors(spark, sf_dir), t.vector_queries(spark, sf_dir)
    return _hits(knn(rows, asked, 5, max_queries=100))


@register
def ann_search(spark, sf_dir):
    return _hits(ann(t.vectors(spark, sf_dir), t.vector_queries(spark, sf_dir), 5))


@register
def ann_recall(spark, sf_dir):
    rows, asked = t.vectors(spark, sf_dir), t.vector_queries(spark, sf_dir)
    return recall(ann(rows, asked, 5), knn(rows, asked, 5))


@register
def blank_queries(spark, sf_dir):
    turns = t.table(spark, sf_dir, "conversations")
    odd = turns.where(F.col("turn") % 2 == 1)
    empty = odd.select("conv_id", (-1 - F.col("turn")).alias("turn"), F.lit(" \t ").alias("query"))
    asked = turns.select("conv_id", "turn", F.col("text").alias("query")).unionByName(empty)
    usable, blank = split_blank_queries(asked)
    return usable.withColumn("status", F.lit("ok")).unionByName(blank).select(
        "conv_id", "turn", "status", F.md5("query").alias("query_hash")
    )


@register
def hydrated_hits(spark, sf_dir):
    """Lines 2 to 4 of every document, looked up in the other state of the corpus."""
    hits = fingerprints(t.document_corpus(spark, sf_dir)).select(
        "path", "file_hash", F.lit(2).alias("start_line"), F.lit(4).alias("end_line")
    )
    shown = hydrate(hits, t.changed_corpus(spark, sf_dir))
    return shown.select("path", F.md5("content").alias("lines_hash"), "stale")


@register
def formatted_results(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    hits = docs.select(
        t.doc_path().alias("path"),
        (F.col("doc_id") % 50 + 1).cast("int").alias("start_line"),
        F.when(F.col("doc_id") % 5 != 0, F.col("n_chars") / 7.0).alias("distance"),
        F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("content"),
    )
    plain = format_results(hits, "/src0").withColumnRenamed("line", "plain")
    return format_results(plain, "/src1/", scores=True).select(
        "path", F.md5("plain").alias("plain"), F.md5("line").alias("scored")
    )


@register
def search_documents(spark, sf_dir):
    """Flagship: documents to units to vectors; every benchmark item as a query; shown lines."""
    corpus = t.document_corpus(spark, sf_dir)
    index = embed(chunk_table(corpus, ("prose",), t.WHOLE), hashed_provider()).where("status = 'ok'")
    queries = t.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    found = search_index(index, queries, corpus, hashed_provider(), "/src0", k=5, scores=True)
    return found.select(
        "query_id",
        F.col("rank").cast("bigint").alias("rank"),
        "path",
        "distance",
        F.md5("line").alias("line_hash"),
        "status",
    )
