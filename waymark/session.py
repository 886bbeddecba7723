"""Session settings and the shared folder used for cut lineage and written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession

# Settings the library's plans are written for. AQE splits skewed join partitions and
# merges small ones, so shuffle width only has to be large enough, not exact.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # Units may be up to a megabyte each, so batches are bounded by bytes as well as rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
}

# Bytes of an Arrow batch of whole files; Python holds a batch several times over.
FILE_BATCH_BYTES = 8 << 20


def small_file_batches(spark: SparkSession) -> None:
    """Bound what Python holds of whole files at a time; call before such a stage is planned.

    Only bytes are bounded: batches of short rows stay as they are.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(FILE_BATCH_BYTES))


def build_session(master: str | None = None, app: str = "waymark", **conf: str) -> SparkSession:
    """A session with the recommended settings; `conf` overrides them (dots as `__`)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`).

    A local-mode session without one gets a fresh temporary folder; on a cluster a
    machine-local folder would be lost with its executor, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    fresh = tempfile.mkdtemp(prefix="waymark-")
    spark.sparkContext.setCheckpointDir(fresh)
    return fresh


# Paths given out within the innermost `temporary` block.
_GIVEN: ContextVar[list[str] | None] = ContextVar("given", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, what was written to the `fresh_path`s given out inside it.

    For calls that return no table that still reads them.
    """
    given: list[str] = []
    token = _GIVEN.set(given)
    try:
        yield
    finally:
        _GIVEN.reset(token)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for name in given:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has written to."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    given = _GIVEN.get()
    if given is not None:
        given.append(path)
    return path


def materialise(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder, in folders `by` a column, and read it back.

    Cuts lineage so that a lost executor does not repeat the work (an embedding call,
    for example), and gives Spark the written size for its join decisions.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, by: str | None = None, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """`materialise`, and aggregates over what was written: an observed plan that turns out empty never reports."""
    out = materialise(df, name, by)
    return out, out.agg(*[c.alias(m) for m, c in metrics.items()]).first().asDict()
