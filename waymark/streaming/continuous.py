"""Continuous sync: new, changed and removed sources as they arrive.

What a stream knows of each path, its modification time and fingerprint, is state of the stream, keyed by
buckets of paths (RocksDB, in its checkpoint), begun from the index as it is when the stream is first started: those
rows are written beside the checkpoint and come with the first batch. A batch therefore reads no index row: arrivals are compared with the state, late ones and those that
bring nothing new fall out there, and the rows of changed and removed paths are dropped by path.
Should something else publish into the namespace meanwhile, the state is no longer the whole truth, and
batches are compared with the index instead.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark.functions.hashing import content_hash
from waymark.operators.embed import FAILED, OK, SHORT, BatchProvider, ColumnProvider
from waymark.operators.filetypes import SUPPORTED_TYPES
from waymark.operators.filters import MAX_BYTES
from waymark.plans.sync import embedded_units, fingerprinted, sync
from waymark.schema import CORPUS
from waymark.session import counted, temporary
from waymark.sources.index import IndexStore

# Fixed value: what `op` says of a source that was removed. Any other value, or none, is an arrival.
DELETE = "delete"
# What begins the state of a path.
SEED = "known"
_STATE = T.StructType([T.StructField("known", T.StringType())])
# Buckets that paths are kept in, each one state row of some hundred bytes a path.
STATE_BUCKETS = 1024
_ROWS = T.StructType(
    [
        *CORPUS.fields,
        T.StructField("file_hash", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("news", T.BooleanType()),
        T.StructField("known", T.BooleanType()),
    ]
)


def stream_start(store: IndexStore, namespace: str, checkpoint: str) -> tuple[str, int | None]:
    """Identity and first version of the stream that a checkpoint belongs to, kept in its folder.

    Batch numbers begin again with every checkpoint, so they only name a batch together with it.
    """
    spark = store.spark
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(checkpoint, "stream-identity")
    fs = file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(file):
        stream = fs.create(file, False)
        try:
            stream.write(bytearray(json.dumps([uuid.uuid4().hex, store.version(namespace)]).encode()))
        finally:
            stream.close()
    stream = fs.open(file)
    try:
        identity, version = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return identity, version


def batch_token(identity: str, batch_id: int) -> str:
    return f"{identity}-batch-{batch_id}"


def newest(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of a bucket of paths, the newest arrival of each that is not older than what is known of it.

    Rows without a time are as old as can be among arrivals, but never older than the state. `news`
    says that the fingerprint differs from the known one, `known` that there was one. The state is
    {path: [time in microseconds, fingerprint]}.
    """
    known: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
    best: dict[str, tuple] = {}
    for part in parts:
        times = part["mtime"].astype("datetime64[us]").astype("int64").where(part["mtime"].notna(), None).astype(object)
        for row, when in zip(part.itertuples(index=False), times):
            when = None if when is None or when != when else int(when)
            if row.op == SEED:
                known[row.path] = [when, row.file_hash]
            elif row.path not in best or (when or 0, row.file_hash or "") > best[row.path][0]:
                best[row.path] = (when or 0, row.file_hash or ""), when, row
    out = []
    for path, (_, when, row) in best.items():
        at, mark = known.get(path, (None, None))
        if at is None or when is None or when >= at:
            known[path] = [at if when is None else when, row.file_hash]
            out.append((*row[: len(_ROWS) - 2], row.file_hash != mark, mark is not None))
    state.update((json.dumps(known),))
    yield pd.DataFrame(out, columns=_ROWS.fieldNames())


def arrived(arrivals: DataFrame) -> DataFrame:
    """Arrivals with a fingerprint, null for a removal."""
    op = F.col("op") if "op" in arrivals.columns else F.lit(None).cast("string")
    gone = F.coalesce(op == DELETE, F.lit(False))
    return arrivals.select(
        *CORPUS.fieldNames(),
        F.when(~gone, F.coalesce(content_hash(F.col("content")), F.lit(""))).alias("file_hash"),
        F.when(gone, DELETE).otherwise("arrival").alias("op"),
    )


def seeds(store: IndexStore, namespace: str, version: int | None, checkpoint: str) -> DataFrame:
    """A stream of what the index knew when the stream was begun, written once beside its checkpoint."""
    spark = store.spark
    path = f"{checkpoint.rstrip('/')}-known"
    schema = T.StructType(_ROWS.fields[:-2])
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(file):
        known = store.known_files(namespace, version or 0).withColumn("op", F.lit(SEED))
        absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in known.columns]
        known.select("*", *absent).select(*schema.fieldNames()).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def not_older(arrivals: DataFrame, store: IndexStore, namespace: str) -> DataFrame:
    """Arrivals whose modification time is not before the one stored for their path."""
    stored = store.known_files(namespace).select("path", F.col("mtime").alias("stored_mtime"))
    late = F.coalesce(F.col("mtime") < F.col("stored_mtime"), F.lit(False))
    return arrivals.join(stored, "path", "left").where(~late).drop("stored_mtime")


def continuous_sync(
    arrivals: DataFrame,
    store: IndexStore,
    namespace: str,
    provider: ColumnProvider | BatchProvider,
    checkpoint: str,
    types: tuple[str, ...] = SUPPORTED_TYPES,
    available_now: bool = False,
    interval: str = "1 minute",
    add_types: Callable[[DataFrame], DataFrame] | None = None,
    max_bytes: int = MAX_BYTES,
    state_buckets: int = STATE_BUCKETS,
) -> StreamingQuery:
    """Start a stream of corpus rows into an index.

    Each micro-batch takes the newest row per path, replaces the index rows of paths whose text has
    changed, and publishes one version under the stream's and the batch's token, so a replayed
    batch changes nothing. Arrivals older than what is known of their path are left out. A row whose
    column `op` is `delete` takes its path out of the index; it has a time like any other, so an
    older arrival does not bring the path back. `add_types` turns corpus rows into typed ones when
    the stream's are not. `store.crowded` says when a batch job should compact the index.
    `state_buckets`, fixed for a checkpoint, should leave some thousand paths to a bucket.
    """
    spark = arrivals.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    identity, start = stream_start(store, namespace, checkpoint)
    rows = seeds(store, namespace, start, checkpoint).unionByName(arrived(arrivals))
    # Python state has a price per key, so paths share one: a bucket of them.
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(state_buckets)))
    changes = rows.groupBy("bucket").applyInPandasWithState(newest, _ROWS, _STATE, "append", GroupStateTimeout.NoTimeout)

    def apply(batch: DataFrame, batch_id: int) -> None:
        token = batch_token(identity, batch_id)
        if store.published(namespace, token) is not None:
            return
        with temporary(spark):
            # Written first: whatever reads a batch twice runs its state twice.
            news = F.col("news")
            rows, seen = counted(
                batch, "arrivals", n=F.count("*"), news=F.count_if(news), replaced=F.count_if(news & F.col("known")),
                gone=F.count_if(F.col("op") == DELETE),
            )
            if seen["n"] and store.touched(namespace, start or 0, identity):
                by_index(rows, token)
            elif seen["n"]:
                by_state(rows, seen, token)

    def typed(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("op") != DELETE).select(*CORPUS.fieldNames(), "file_hash")
        return rows if add_types is None else add_types(rows)

    def by_state(rows: DataFrame, seen: dict[str, int], token: str) -> None:
        at = store.version(namespace)
        retry = store.retry_paths(namespace, at)
        waiting = None if retry.isEmpty() else retry.join(rows.select("path"), "path", "left_anti")
        replaced = rows.where("news AND known").select("path")
        if waiting is None:
            rows = rows.where("news")
        else:
            # Units that failed are tried again whenever their path arrives.
            again = retry.join(rows.select("path"), "path", "left_semi").select("path", F.lit(True).alias("again"))
            rows = rows.join(again, "path", "left").where(F.col("news") | F.col("again"))
            replaced = replaced.unionByName(again.select("path"))
        if not seen["news"] and waiting is None:
            return
        found = fingerprinted(typed(rows), types, max_bytes)
        files = found.prints.drop("file_ctime")
        if seen["gone"]:
            nothing = F.lit(None).cast("string").alias("file_hash")
            files = files.unionByName(rows.where(F.col("op") == DELETE).select("path", nothing, F.col("mtime").alias("file_mtime")))
        embedded, statuses = None, {}
        if found.types:
            embedded, statuses, _ = embedded_units(typed(rows), None, provider, found, max_bytes)
        if statuses.get(FAILED) or statuses.get(SHORT):
            failed = embedded.where(F.col("status").isin(FAILED, SHORT)).select("path")
            waiting = failed if waiting is None else waiting.unionByName(failed)
        store.publish(
            namespace,
            embedded.where(F.col("status") == OK) if statuses.get(OK) else None,
            gone_paths=replaced if seen["replaced"] or waiting is not None else None,
            retry=waiting,
            token=token,
            replace=False,
            files=files,
            expected=at,
            unique=True,
        )

    def by_index(rows: DataFrame, token: str) -> None:
        rows = not_older(rows, store, namespace)
        sync(store, namespace, typed(rows), provider, types, partial=True, token=token, max_bytes=max_bytes)
        gone, seen = counted(rows.where(F.col("op") == DELETE).select("path", "mtime"), "removed", n=F.count("*"))
        if seen["n"]:
            files = gone.select("path", F.lit(None).cast("string").alias("file_hash"), F.col("mtime").alias("file_mtime"))
            store.publish(namespace, gone_paths=gone, files=files, token=f"{token}-removed")

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
