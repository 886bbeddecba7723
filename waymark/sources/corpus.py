"""Corpus sources: a file tree or any table, brought to one row per path."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.filters import MAX_BYTES
from waymark.operators.filetypes import DEFAULT_RULES, TypeRule, assign_type, type_of
from waymark.schema import CORPUS
from waymark.session import materialise


# A path's scheme and authority, which a corpus does without.
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/+"
# `kind`: file, folder (still to be listed), or skipped for a `reason`; `unseen`: a name, or one of a
# folder above, that starts with `.` or `_`.
_LISTED = "uri string, length long, modificationTime timestamp, kind string, unseen boolean, reason string"
_OPENED = "path string, content binary, length long, modificationTime timestamp"
# Input bytes per core below which an input is dealt out.
SPREAD_BYTES = 32 << 20
# Paths up to this many are sent to every task.
MAX_NAMED = 200_000
# Entries that a task lists before it hands further folders on.
WALK = 10_000


class Scan(NamedTuple):
    """Source files, and what the scan passed over: `path, reason`.

    Reasons: `link` (links are not followed), `special` (neither file nor folder), `unreadable`
    and `missing`, for files, folders and roots.
    """

    files: DataFrame
    skipped: DataFrame


def scan_tree(
    spark: SparkSession,
    root: str | list[str],
    rules: tuple[TypeRule, ...] = DEFAULT_RULES,
    max_bytes: int = MAX_BYTES,
    hidden: bool = True,
) -> Scan:
    """Typed source files under `root`, decoded, and the entries that could not be taken.

    Files that are not UTF-8 are left out. Local trees are listed and read by tasks, regular files
    only; a link, to a file or a folder, is never followed, so a tree of loops ends. Other stores are
    read by Spark's file source, with names that start with `.` or `_`, which it does not list,
    found and read by tasks unless `hidden` is false. Neither the size rule nor the type rule
    opens a file it rejects; files that vanish between listing and reading are passed over. A
    relative root is one of the default file system's working folder; a root may be a file.
    """
    raw, skipped = _raw_files(spark, root, rules, hidden, (F.col("length") > 0) & (F.col("length") <= max_bytes))
    return Scan(decode_utf8(assign_type(raw, rules)), skipped)


def scan_files(
    spark: SparkSession,
    root: str | list[str],
    rules: tuple[TypeRule, ...] = DEFAULT_RULES,
    max_bytes: int = MAX_BYTES,
    hidden: bool = True,
) -> DataFrame:
    """The files of `scan_tree`."""
    return scan_tree(spark, root, rules, max_bytes, hidden).files


def scan_file_hashes(
    spark: SparkSession,
    root: str | list[str],
    rules: tuple[TypeRule, ...] = DEFAULT_RULES,
    hidden: bool = True,
) -> DataFrame:
    """Path, raw bytes and times of every typed file, for fingerprints: no size or text rule."""
    return _raw_files(spark, root, rules, hidden, F.lit(True))[0]


def qualified(spark: SparkSession, root: str) -> str:
    """A root with its scheme, absolute. One that is not there is an error, not an empty corpus."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(path):
        raise FileNotFoundError(root)
    return system.makeQualified(path).toString()


def _raw_files(
    spark: SparkSession, root: str | list[str], rules: tuple[TypeRule, ...], hidden: bool, sized: Column
) -> tuple[DataFrame, DataFrame]:
    roots = [qualified(spark, r) for r in ([root] if isinstance(root, str) else root)]
    local = [r.removeprefix("file:") for r in roots if r.startswith("file:")]
    local = ["/" + r.lstrip("/") for r in local]
    stores = [r for r in roots if not r.startswith("file:")]
    listed = list_tree(spark, local, stores) if local or hidden else spark.createDataFrame([], _LISTED)
    wanted = listed.where((F.col("kind") == "file") & sized)
    if not hidden:
        wanted = wanted.where("NOT unseen")
    found = open_files(wanted.where(type_of(F.col("uri"), rules).isNotNull()))
    if stores:
        seen = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("ignoreMissingFiles", "true")
            .load(stores)
            .where(sized & (F.col("length") > 0))
            .select("path", "content", "length", "modificationTime")
        )
        found = seen.unionByName(found)
    files = found.select(
        F.regexp_replace("path", _SCHEME, "/").alias("path"),
        "content",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        F.lit(None).cast("timestamp").alias("ctime"),
    ).where(type_of(F.col("path"), rules).isNotNull())
    skipped = listed.where("kind = 'skipped'")
    return files, skipped.select(F.regexp_replace("uri", _SCHEME, "/").alias("path"), "reason")


def _local_entries(folder: str, unseen: bool) -> Iterator[tuple]:
    """Rows of one local folder, or of a root that is a file; links stay what they are."""
    try:
        at_root = not stat.S_ISDIR(os.lstat(folder).st_mode)
        names = [folder] if at_root else sorted(os.listdir(folder))
    except FileNotFoundError:
        yield folder, 0, None, "skipped", unseen, "missing"
        return
    except OSError:
        yield folder, 0, None, "skipped", unseen, "unreadable"
        return
    for name in names:
        yield _local_entry(os.path.join(folder, name), unseen)


def _local_entry(name: str, unseen: bool) -> tuple:
    hidden = unseen or os.path.basename(name)[:1] in (".", "_")
    try:
        info = os.lstat(name)
    except OSError:
        return name, 0, None, "skipped", hidden, "missing"
    when = pd.Timestamp(info.st_mtime_ns // 1000, unit="us")
    if stat.S_ISDIR(info.st_mode):
        return name, 0, when, "folder", hidden, None
    if not stat.S_ISREG(info.st_mode):
        return name, 0, when, "skipped", hidden, "link" if stat.S_ISLNK(info.st_mode) else "special"
    if not os.access(name, os.R_OK):
        return name, info.st_size, when, "skipped", hidden, "unreadable"
    return name, info.st_size, when, "file", hidden, None


def _store_entries(uri: str, unseen: bool) -> Iterator[tuple]:
    """Rows of one folder of another store: its folders, and the files that Spark does not read."""
    try:
        system, path = fs.FileSystem.from_uri(uri)
        infos = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    except (OSError, ValueError) as error:
        yield uri, 0, None, "skipped", unseen, "missing" if isinstance(error, FileNotFoundError) else "unreadable"
        return
    lead = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    for info in infos:
        hidden = unseen or info.base_name[:1] in (".", "_")
        if info.type == fs.FileType.Directory:
            yield lead + info.path, 0, info.mtime, "folder", hidden, None
        elif info.type == fs.FileType.File and (hidden or not info.size):
            yield lead + info.path, info.size or 0, info.mtime, "file", hidden, None


def _walk(root: str, unseen: bool) -> Iterator[list[tuple]]:
    """`_LISTED` rows below a folder, at most `WALK` at a time however many one folder holds.

    After `WALK` entries the folders still to be listed come as rows.
    """
    rows, folders, seen = [], [(root, unseen)], 0
    while folders and seen < WALK:
        folder, below = folders.pop()
        entries = _local_entries if folder.startswith("/") else _store_entries
        for row in entries(folder, below):
            seen += 1
            if row[3] == "folder" and len(folders) < WALK:
                folders.append((row[0], row[4]))
                continue
            rows.append(row)
            if len(rows) >= WALK:
                yield rows
                rows = []
    for folder, below in folders:
        rows.append((folder, 0, None, "folder", below, None))
        if len(rows) >= WALK:
            yield rows
            rows = []
    yield rows


def list_tree(spark: SparkSession, local: list[str], stores: list[str]) -> DataFrame:
    """Files and skipped entries below folders, as `_LISTED` rows.

    Tasks list folders, each up to `WALK` entries deep and wide, and what is left is dealt out again.
    Of stores only files are listed that Spark's source leaves out: hidden names and empty files.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for root, unseen in zip(batch["uri"], batch["unseen"]):
                for rows in _walk(root, bool(unseen)):
                    made = pd.DataFrame(rows, columns=[c.split()[0] for c in _LISTED.split(", ")])
                    made["modificationTime"] = pd.to_datetime(made["modificationTime"], utc=True)
                    yield made

    level = spark.createDataFrame([(r, False) for r in dict.fromkeys([*local, *stores])], "uri string, unseen boolean")
    found = spark.createDataFrame([], _LISTED)
    while not level.isEmpty():
        inside = materialise(level.repartition("uri").mapInPandas(walk, _LISTED), "listing")
        found = found.unionByName(inside.where("kind <> 'folder'"))
        level = inside.where("kind = 'folder'").select("uri", "unseen")
    return found


def open_files(listed: DataFrame) -> DataFrame:
    """The bytes of listed files, read one by one in tasks; files that have gone are passed over."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                try:
                    if row.uri.startswith("/"):
                        # A link that has come in the file's place is not followed either.
                        with open(os.open(row.uri, os.O_RDONLY | os.O_NOFOLLOW), "rb") as stream:
                            content = stream.read()
                    else:
                        system, path = fs.FileSystem.from_uri(row.uri)
                        with system.open_input_stream(path) as stream:
                            content = stream.read()
                except OSError:
                    continue
                yield pd.DataFrame(
                    {
                        "path": [row.uri],
                        "content": [content],
                        "length": [len(content)],
                        "modificationTime": [row.modificationTime],
                    }
                )

    return listed.repartition("uri").mapInPandas(read, _OPENED)


def decode_utf8(df: DataFrame, column: str = "content") -> DataFrame:
    """Keep rows whose bytes are valid UTF-8 and decode them."""
    return df.where(F.is_valid_utf8(F.col(column))).withColumn(
        column, F.decode(F.col(column), "UTF-8")
    )


def corpus_from_table(
    df: DataFrame,
    path: Column | str,
    content: Column | str = "content",
    mtime: Column | str | None = None,
    ctime: Column | str | None = None,
) -> DataFrame:
    """Adapt any table to the corpus columns. `path` must be unique per row."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    stamp = lambda c: (F.lit(None) if c is None else col(c)).cast("timestamp")
    text = col(content)
    return df.select(
        col(path).alias("path"),
        text.alias("content"),
        F.octet_length(text).cast("bigint").alias("size"),
        stamp(mtime).alias("mtime"),
        stamp(ctime).alias("ctime"),
    )


class FileSource:
    """Source files below roots of one store, and single ones of them by path."""

    def __init__(
        self, spark: SparkSession, root: str | list[str], rules: tuple[TypeRule, ...] = DEFAULT_RULES, max_bytes: int = MAX_BYTES
    ):
        self.spark, self.rules, self.max_bytes = spark, rules, max_bytes
        self.roots = [root] if isinstance(root, str) else root
        leads = {qualified(spark, r).partition(":/")[0] + ":" for r in self.roots}
        if leads != {"file:"}:
            raise ValueError("single files are opened from local or mounted folders only; use scan_files")

    def scan(self) -> Scan:
        return scan_tree(self.spark, self.roots, self.rules, self.max_bytes)

    @property
    def files(self) -> DataFrame:
        return self.scan().files

    def open(self, paths: DataFrame, most: int | None = None) -> DataFrame:
        """`path, content` of the files named, as they are now; no other file is opened."""
        listed = paths.select(F.col("path").alias("uri"), F.lit(None).cast("timestamp").alias("modificationTime"))
        return decode_utf8(open_files(listed)).select("path", "content")


class TableSource:
    """A corpus stored in folders by a hash of its paths, so that single files are read from few."""

    def __init__(self, spark: SparkSession, at: str, buckets: int = 256):
        self.spark, self.at, self.buckets = spark, at, buckets
        self._bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")

    def write(self, corpus: DataFrame) -> TableSource:
        """Store a typed corpus. A bucket too large for one task is split."""
        rows = corpus.withColumn("bucket", self._bucket).hint("rebalance", "bucket")
        rows.write.partitionBy("bucket").parquet(self.at)
        return self

    @cached_property
    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.at)

    @property
    def files(self) -> DataFrame:
        return self._stored.drop("bucket")

    def open(self, paths: DataFrame, most: int | None = None) -> DataFrame:
        """`path, content` of the files named. Only the folders of their buckets are read."""
        buckets = [r.bucket for r in paths.select(self._bucket.alias("bucket")).distinct().collect()]
        wanted = paths.select("path")
        rows = self._stored.where(F.col("bucket").isin(buckets)).select("path", "content")
        return rows.join(F.broadcast(wanted) if most is not None and most <= MAX_NAMED else wanted, "path", "left_semi")


def spread_input(df: DataFrame) -> DataFrame:
    """Rows of a small input, dealt out to all cores ahead of per-row work such as embedding.

    An input large enough to keep the cluster busy is left as it is and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def latest_per_path(corpus: DataFrame) -> DataFrame:
    """One row per path: the newest, ties broken by content hash.

    `max_by` keeps one row per path on the map side, so many versions of one path never
    meet in one task.
    """
    columns = CORPUS.fieldNames()
    newest = F.max_by(
        F.struct(*columns), F.struct(F.coalesce("mtime", F.lit(0).cast("timestamp")), F.md5("content"))
    )
    return corpus.groupBy("path").agg(newest.alias("row")).select("row.*")
