"""Search results: current source lines of a hit, and its printed row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.hashing import content_hash
from waymark.functions.text import line_range, preview, relative_path
from waymark.sources.corpus import MAX_NAMED, FileSource, TableSource

def hydrate(hits: DataFrame, corpus: DataFrame | FileSource | TableSource, max_hits: int | None = None) -> DataFrame:
    """Add `content`, the current source's lines of each hit, and `stale`.

    A path that is gone gives null content. `stale` tells that the source has changed or
    gone since it was indexed. `max_hits` is a bound the caller knows (queries times k). A source that
    can open single files reads those of the hits only; of a plain table of files the paths wanted
    go to its scan, within `MAX_NAMED` of them as a broadcast, and the corpus is not shuffled.
    """
    wanted = hits.select("path").distinct()
    if isinstance(corpus, DataFrame):
        named = F.broadcast(wanted) if max_hits is not None and max_hits <= MAX_NAMED else wanted
        files = corpus.select("path", "content").join(named, "path", "left_semi")
    else:
        files = corpus.open(wanted, max_hits)
    # Hashed once per file, not per hit.
    current = content_hash(F.col("content")) if "file_hash" in hits.columns else F.lit(None).cast("string")
    sources = files.select("path", F.col("content").alias("source"), current.alias("source_hash"))
    stale = F.lit(None).cast("boolean")
    if "file_hash" in hits.columns:
        stale = ~F.coalesce(F.col("source_hash") == F.col("file_hash"), F.lit(False))
    return (
        hits.join(sources, "path", "left")
        .withColumn(
            "content", line_range(F.col("source"), F.col("start_line"), F.col("end_line"))
        )
        .withColumn("stale", stale)
        .drop("source", "source_hash")
    )


def format_results(hits: DataFrame, root: str | Column, scores: bool = False) -> DataFrame:
    """Add `line`: `path:line[:distance]:preview`, the path below `root`."""
    root = F.lit(root) if isinstance(root, str) else root
    parts = [relative_path(F.col("path"), root), F.col("start_line").cast("string")]
    if scores:
        shown = F.format_string("%.4f", F.col("distance"))
        parts.append(F.when(F.col("distance").isNull(), "n/a").otherwise(shown))
    return hits.withColumn("line", F.concat_ws(":", *parts, preview(F.col("content"))))
