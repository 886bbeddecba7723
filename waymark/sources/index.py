"""The stored index: parquet segments per namespace, published by small commit files.

A sync writes only what it changes: a segment of new rows and one of dropped ids, or dropped paths. A
drop hides rows of earlier segments, so a read is the union of the row segments minus what was
dropped. Commits count their drops: up to `MAX_DROPS` go to the rows as a broadcast, so no row
moves in a read, and `crowded` says when it is time to compact. Compacting sorts all rows by id into
one base segment, whose files' ranges are kept, so that a page of ids opens few of them. Readers pin
a version; a segment no commit names is never read, which makes a failed write harmless.
A commit is written aside and renamed into place, which fails if the version exists; a writer
that names the version its diff was made of also fails when another was published since.
Fingerprints of files that were handled are kept apart from rows, so that a file without any
stored unit is known too; a null hash marks a file that is gone.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.operators.cells import CellIndex
from waymark.operators.knn import DEFAULT_K
from waymark.schema import INDEX, INDEX_COLUMNS, INDEX_READ_COLUMNS
from waymark.session import materialise

_ROWS = T.StructType(INDEX.fields + [T.StructField("seq", T.LongType())])
_DROPS = T.StructType([T.StructField("id", T.StringType()), T.StructField("seq", T.LongType())])
_FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("file_mtime", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)
_GONE = T.StructType([T.StructField("path", T.StringType()), T.StructField("seq", T.LongType())])
_RANGES = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("low", T.StringType()),
        T.StructField("top", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)
# Dropped ids (of 32 characters) or paths that a read may broadcast; segments that it should open.
MAX_DROPS = 1 << 20
MAX_SEGMENTS = 64
# Cells are built anew when one row in this many is not of their version.
CELLS_STALE = 20
# Rows that a page's first files should hold, for every row of the page.
PAGE_SLACK = 2
# No version is expected: whatever is the latest will do.
ANY = object()
_PATHS = T.StructType([T.StructField("path", T.StringType())])


class Commit(NamedTuple):
    seq: int
    token: str | None
    base: bool
    rows: str | None
    drops: str | None
    retry: str | None
    files: str | None = None
    n_drops: int = 0
    gone: str | None = None
    n_gone: int = 0
    ranges: str | None = None
    # The rows are those of the version before.
    same: bool = False


class StaleVersion(Exception):
    """Another version was published since the one a change was made of."""


class IndexStore:
    """Index tables below one folder of a shared file system."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")
        # Commits never change, so each is opened once.
        self._opened: dict[tuple[str, str], Commit] = {}

    # --- reading ---

    def version(self, namespace: str) -> int | None:
        """Latest version, None when the namespace does not exist."""
        commits = self._commits(namespace)
        return commits[-1].seq if commits else None

    def read(
        self, namespace: str, version: int | None = None, vectors: bool = False
    ) -> DataFrame:
        """Rows of one version, without vectors unless asked for.

        Only a missing namespace reads as empty; any other failure is raised.
        """
        columns = INDEX_COLUMNS if vectors else INDEX_READ_COLUMNS
        return self._rows(self._live(self._commits(namespace), version)).select(*columns)

    def added(self, namespace: str, since: int, version: int | None = None) -> DataFrame:
        """Rows, with vectors, that versions after `since` added and that are still there."""
        live = self._live(self._commits(namespace), version)
        if any(c.base and c.seq > since for c in live):
            # A rewrite holds old rows and new ones alike.
            old = self.read(namespace, since).select("id")
            return self.read(namespace, version, vectors=True).join(old, "id", "left_anti")
        return self._rows([c._replace(rows=c.rows if c.seq > since else None) for c in live]).select(*INDEX_COLUMNS)

    def hidden(self, namespace: str, since: int, version: int | None = None) -> DataFrame:
        """`id` of the rows of version `since` that later ones, up to `version`, dropped."""
        old = self.read(namespace, since)
        drops, gone = self._drops([c for c in self._live(self._commits(namespace), version) if c.seq > since])
        by_id = old.select("id") if drops is None else old.select("id").join(drops, "id", "left_semi")
        by_path = old if gone is None else old.join(gone, "path", "left_semi")
        none = old.select("id").limit(0)
        return (none if drops is None else by_id).unionByName(none if gone is None else by_path.select("id")).distinct()

    def n_hidden(self, namespace: str, since: int, version: int | None = None) -> int:
        """Drops of the versions after `since`; at least as many as `hidden` ids, but for dropped paths."""
        live = self._live(self._commits(namespace), version)
        return sum(c.n_drops + c.n_gone for c in live if c.seq > since)

    def _drops(self, live: list[Commit]) -> tuple[DataFrame | None, DataFrame | None]:
        """When ids, and paths, were dropped last; broadcast if that is checked to be few."""

        def latest(at: list[str], schema: T.StructType, key: str, n: int) -> DataFrame | None:
            if not at:
                return None
            dropped = self.spark.read.schema(schema).parquet(*at).groupBy(key).agg(F.max("seq").alias("dropped_at"))
            return F.broadcast(dropped) if n <= MAX_DROPS else dropped

        ids = latest([c.drops for c in live if c.drops], _DROPS, "id", sum(c.n_drops for c in live))
        paths = latest([c.gone for c in live if c.gone], _GONE, "path", sum(c.n_gone for c in live))
        return ids, paths

    def _rows(self, live: list[Commit], only: list[str] | None = None) -> DataFrame:
        """Live rows; of the base segment, the files `only`."""
        rows = [c.rows for c in live if c.rows]
        if only is not None:
            rows = only + [c.rows for c in live if c.rows and not c.base]
        if not rows:
            return self.spark.createDataFrame([], _ROWS)
        table = self.spark.read.schema(_ROWS).parquet(*rows)
        for key, dropped in zip(("id", "path"), self._drops(live)):
            if dropped is not None:
                same = (F.col(f"r.{key}") == F.col(f"d.{key}")) & (F.col("d.dropped_at") > F.col("r.seq"))
                table = table.alias("r").join(dropped.alias("d"), same, "left_anti")
        return table

    def page(self, namespace: str, after: str | None, size: int, version: int | None = None) -> DataFrame:
        """The next `size` rows in order of id, without vectors.

        Of a compacted index only the files are opened whose range of ids the page touches, and what
        was published since.
        """
        live = self._live(self._commits(namespace), version)
        if not live or not live[0].base or not live[0].ranges:
            return keyset_page(self._rows(live).select(*INDEX_READ_COLUMNS), after, size)
        ahead = self.spark.read.schema(_RANGES).parquet(live[0].ranges)
        if after is not None:
            ahead = ahead.where(F.col("top") > after)
        # The files that hold enough rows, then twice as many, until the page is full.
        want = size * PAGE_SLACK
        while True:
            held = F.expr("sum(n) OVER (ORDER BY low, file) - n")
            files = ahead.withColumn("before", held).where(F.col("before") < want).orderBy("low").collect()
            rows = self._rows(live, [f.file for f in files]).select(*INDEX_READ_COLUMNS)
            # Rows of later segments beyond the last file opened wait for the files between.
            whole = sum(f.n for f in files) < want
            if files and not whole:
                rows = rows.where(F.col("id") <= files[-1].top)
            page = materialise(keyset_page(rows, after, size), "page")
            if whole or page.count() == size:
                return page.orderBy("id")
            want *= 2

    def files(self, namespace: str, version: int | None = None) -> DataFrame:
        """`path, file_hash, file_mtime` of the files that were handled, the latest of each path."""
        live = self._live(self._commits(namespace), version)
        at = [c.files for c in live if c.files]
        if not at:
            return self.spark.createDataFrame([], _FILES).drop("seq")
        latest = F.max_by(F.struct("file_hash", "file_mtime"), "seq").alias("f")
        table = self.spark.read.schema(_FILES).parquet(*at).groupBy("path").agg(latest)
        return table.where("f.file_hash IS NOT NULL").select("path", "f.file_hash", "f.file_mtime")

    def known_files(self, namespace: str, version: int | None = None) -> DataFrame:
        """`path, mtime, file_hash` of every path ever handled, the newest; the hash of a removed one is null."""
        live = self._live(self._commits(namespace), version)
        rows = self._rows(live).select("path", F.col("file_mtime").alias("mtime"), "file_hash", "seq").distinct()
        at = [c.files for c in live if c.files]
        if at:
            files = self.spark.read.schema(_FILES).parquet(*at)
            rows = rows.unionByName(files.select("path", F.col("file_mtime").alias("mtime"), "file_hash", "seq"))
        latest = rows.groupBy("path").agg(F.max("mtime").alias("mtime"), F.max_by("file_hash", "seq").alias("file_hash"))
        return latest.select("path", "mtime", "file_hash")

    def _known(self, namespace: str, version: int) -> DataFrame:
        """Files as `files` has them, and those that were removed."""
        return self.known_files(namespace, version).withColumnRenamed("mtime", "file_mtime")

    def touched(self, namespace: str, since: int, identity: str) -> bool:
        """Whether a version after `since` was published that is none of a stream's and changed anything."""
        later = [c for c in self._commits(namespace) if c.seq > since and not c.same]
        return any(c.token is None or not c.token.startswith(identity) for c in later)

    def retry_paths(self, namespace: str, version: int | None = None) -> DataFrame:
        """Paths with units that could not be embedded yet."""
        commits = [c for c in self._commits(namespace) if version is None or c.seq <= version]
        if not commits or not commits[-1].retry:
            return self.spark.createDataFrame([], _PATHS)
        return self.spark.read.schema(_PATHS).parquet(commits[-1].retry)

    def published(self, namespace: str, token: str) -> int | None:
        """Version a token was published as."""
        for commit in self._commits(namespace):
            if commit.token == token:
                return commit.seq
        return None

    # --- writing ---

    def publish(
        self,
        namespace: str,
        upserts: DataFrame | None = None,
        delete_ids: DataFrame | None = None,
        retry: DataFrame | None = None,
        token: str | None = None,
        base: bool = False,
        replace: bool = True,
        files: DataFrame | None = None,
        expected: object = ANY,
        unique: bool = False,
        gone_paths: DataFrame | None = None,
        ranged: bool = False,
        same: bool = False,
    ) -> int:
        """Publish a new version: delete `delete_ids`, then upsert rows by id.

        Deletions are applied whether or not there are upserts. `replace=False` skips the
        drop of rows an upsert overwrites, for upserts known to be absent from the index.
        With `base` the new version starts from nothing. A `token` already published is a
        replay and changes nothing. Vectors are written, content and distance never are.
        The retry list and the files of earlier versions stay unless others are given (or, with
        `base`, are cleared). `expected` is the version this change was made of, None for no
        version: if another is the latest, StaleVersion is raised and nothing is published. With
        `unique` the caller knows that no id comes twice. All rows of earlier versions on
        `gone_paths` are deleted. `ranged` clusters the new rows by id; `same` marks a mere rewrite.
        """
        replayed = None if token is None else self.published(namespace, token)
        if replayed is not None:
            return replayed
        commits = self._commits(namespace)
        last = commits[-1].seq if commits else None
        if expected is not ANY and expected != last:
            raise StaleVersion(f"made of version {expected}, but {last} is the latest")
        seq = (last or 0) + 1
        rows_at = drops_at = gone_at = ranges_at = None
        n_drops = n_gone = 0
        if upserts is not None:
            rows = upserts.select(*INDEX_COLUMNS)
            rows = rows if unique else rows.dropDuplicates(["id"])
            if ranged:
                rows = rows.repartitionByRange("id").sortWithinPartitions("id")
            rows_at = self._write(namespace, "rows", rows.withColumn("seq", F.lit(seq)))
            if ranged:
                written = self.spark.read.schema(_ROWS).parquet(rows_at).groupBy(F.input_file_name().alias("file"))
                extent = written.agg(F.min("id").alias("low"), F.max("id").alias("top"), F.count("*").alias("n"))
                ranges_at = self._write(namespace, "ranges", extent)
        if not base:
            # The written segment, not the plan again: upserts may hold an embedding step.
            gone = [] if delete_ids is None else [delete_ids.select("id")]
            if upserts is not None and replace and self._live(commits, None):
                gone.append(self.spark.read.schema(_ROWS).parquet(rows_at).select("id"))
            if gone:
                ids = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
                ids = ids if unique and len(gone) == 1 else ids.distinct()
                drops_at, n_drops = self._write_counted(namespace, "drops", ids.withColumn("seq", F.lit(seq)))
            if gone_paths is not None:
                paths = gone_paths.select("path").distinct().withColumn("seq", F.lit(seq))
                gone_at, n_gone = self._write_counted(namespace, "gone", paths)
        files_at = None
        if files is not None:
            known = files.select("path", "file_hash", "file_mtime").withColumn("seq", F.lit(seq))
            files_at = self._write(namespace, "files", known)
        retry_at = None if base or not commits else commits[-1].retry
        if retry is not None:
            retry_at = self._write(namespace, "retry", retry.select("path").distinct())
        commit = Commit(seq, token, base, rows_at, drops_at, retry_at, files_at, n_drops, gone_at, n_gone, ranges_at, same)
        self._commit(namespace, commit)
        return seq

    def reset(self, namespace: str) -> int | None:
        """Publish an empty version; a missing namespace is left alone."""
        version = self.version(namespace)
        if version is None:
            return None
        return self.publish(namespace, base=True, expected=version)

    def compact(self, namespace: str) -> int | None:
        """Rewrite the live rows, by id, as one base segment; keeps unfinished retries and known files."""
        version = self.version(namespace)
        if version is None:
            return None
        return self.publish(
            namespace,
            self.read(namespace, version, vectors=True),
            retry=self.retry_paths(namespace, version),
            files=self._known(namespace, version),
            base=True,
            expected=version,
            unique=True,
            ranged=True,
            same=True,
        )

    def crowded(self, namespace: str) -> bool:
        """Whether a read opens too many segments, or more drops than it may broadcast."""
        live = self._live(self._commits(namespace), None)
        drops = max(sum(c.n_drops for c in live), sum(c.n_gone for c in live))
        return self.segments(namespace) > MAX_SEGMENTS or drops > MAX_DROPS

    def segments(self, namespace: str) -> int:
        """How many segments a read of the latest version opens."""
        live = self._live(self._commits(namespace), None)
        return sum((c.rows is not None) + (c.drops is not None) + (c.gone is not None) for c in live)

    # --- cells ---

    def cells(self, namespace: str, version: int, payload: tuple[str, ...], k: int = DEFAULT_K) -> tuple[CellIndex, int]:
        """The rows of a version by cell, and the version they are of: an earlier one will do.

        Built again when more than a `CELLS_STALE`th of the rows, or as many as a read may broadcast,
        were published or dropped since.
        """
        base = f"{self.base}/{namespace}/cells"
        jvm, folder, fs = self._folder(namespace, "cells")
        live = self._live(self._commits(namespace), version)
        if fs.exists(folder):
            built = sorted(s.getPath().getName() for s in fs.listStatus(folder))
            # The schema is written last; cells of a build that was cut off have none.
            built = [n for n in built if int(n[:12]) <= version and fs.exists(jvm.org.apache.hadoop.fs.Path(folder, f"{n}/schema/_SUCCESS"))]
            for name in reversed(built[-1:]):
                at, stored = int(name[:12]), CellIndex(self.spark, f"{base}/{name}")
                hidden, rows = self.n_hidden(namespace, at, version), stored.n_rows
                fresh = not any(c.base and c.seq > at and not c.same for c in live) and not any(c.n_gone for c in live if c.seq > at)
                if fresh and set(payload) <= set(stored.schema.fieldNames()) and hidden <= min(MAX_DROPS, rows // CELLS_STALE):
                    if self.added(namespace, at, version).count() <= rows // CELLS_STALE:
                        return stored, at
        path = f"{base}/{version:012d}-{uuid.uuid4().hex}"
        return CellIndex.build(self.read(namespace, version, vectors=True), path, k, payload), version

    # --- files ---

    def _write(self, namespace: str, kind: str, df: DataFrame) -> str:
        path = f"{self.base}/{namespace}/{kind}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _write_counted(self, namespace: str, kind: str, df: DataFrame) -> tuple[str, int]:
        path = self._write(namespace, kind, df)
        return path, self.spark.read.schema(df.schema).parquet(path).count()

    def _live(self, commits: list[Commit], version: int | None) -> list[Commit]:
        if version is not None:
            commits = [c for c in commits if c.seq <= version]
        starts = [i for i, c in enumerate(commits) if c.base]
        return commits[starts[-1] if starts else 0 :]

    def _folder(self, namespace: str, name: str = "commits"):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{namespace}/{name}")
        return jvm, path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _commits(self, namespace: str) -> list[Commit]:
        jvm, folder, fs = self._folder(namespace)
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        names = [n for n in names if n.isdigit()]
        out = []
        for name in names:
            if (namespace, name) not in self._opened:
                stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
                try:
                    text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                self._opened[namespace, name] = Commit(**json.loads(text))
            out.append(self._opened[namespace, name])
        return out

    def _commit(self, namespace: str, commit: Commit) -> None:
        jvm, folder, fs = self._folder(namespace)
        file = jvm.org.apache.hadoop.fs.Path
        aside = file(folder, f"_{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(commit._asdict()).encode()))
        finally:
            stream.close()
        # A reader never meets half a commit, and the rename fails when another writer has
        # published this version.
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(
            fs.makeQualified(aside), fs.makeQualified(file(folder, f"{commit.seq:012d}")), plain
        )


def keyset_page(df: DataFrame, after: str | int | None, size: int, key: str = "id") -> DataFrame:
    """The next page in key order: keys above `after`, at most `size` rows."""
    rest = df if after is None else df.where(F.col(key) > after)
    return rest.orderBy(key).limit(size)


def upload_projection(df: DataFrame) -> DataFrame:
    """The columns a write stores: no content, no distance, vector optional."""
    if "vector" not in df.columns:
        df = df.withColumn("vector", F.lit(None).cast("array<float>"))
    return df.select(*INDEX_COLUMNS)
