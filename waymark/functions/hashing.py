"""Content hashes, unit ids and namespace keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column | str) -> Column:
    """128-bit hex digest of text or bytes. 64 bits would collide at 100 TB of units."""
    return F.md5(content)


def unit_id(
    path: Column | str = "path",
    start_line: Column | str = "start_line",
    end_line: Column | str = "end_line",
    file_hash: Column | str = "file_hash",
    chunk_hash: Column | str = "chunk_hash",
) -> Column:
    """Id of a unit: any change anywhere in its file changes it (the file hash is inside).

    Line numbers enter 0-based.
    """
    col = _as_column
    return F.md5(
        F.concat_ws(
            ":",
            col(path),
            (col(start_line) - 1).cast("string"),
            (col(end_line) - 1).cast("string"),
            col(file_hash),
            col(chunk_hash),
        )
    )


def namespace_key(root: Column | str, provider: str) -> Column:
    """One index namespace per project root and embedding provider."""
    return F.concat(F.lit(f"ix_{provider}_"), F.md5(_as_column(root)))


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
