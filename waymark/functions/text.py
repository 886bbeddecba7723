"""Line, path and preview expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_EXTENSION = "no extension"
NO_CONTENT = "[no content]"


def source_lines(content: Column) -> Column:
    """Lines as a reader sees them: no trailing `\\r`, no empty piece after the last newline."""
    unix = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    body = F.regexp_replace(unix, r"\n\z", "")
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def line_range(content: Column, start_line: Column, end_line: Column) -> Column:
    """Text of lines `[start_line, end_line]` (1-based, inclusive); null when none exists."""
    picked = F.slice(source_lines(content), start_line, end_line - start_line + 1)
    return F.when(F.size(picked) > 0, F.array_join(picked, "\n"))


def count_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    """Directory of a path, without a trailing slash; empty for a bare name."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def extension(path: Column) -> Column:
    return F.coalesce(
        F.nullif(F.regexp_extract(path, r"\.([^./]+)$", 1), F.lit("")), F.lit(NO_EXTENSION)
    )


def relative_path(path: Column, root: Column) -> Column:
    """`path` below `root`, compared by whole path components; unchanged when outside."""
    prefix = F.concat(F.regexp_replace(root, r"/+\z", ""), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def preview(content: Column) -> Column:
    """First line of the content, or a fixed marker when there is no line at all."""
    first = F.regexp_replace(F.split_part(content, F.lit("\n"), F.lit(1)), r"\r\z", "")
    return F.when(F.coalesce(content, F.lit("")) == "", F.lit(NO_CONTENT)).otherwise(first)


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+", ""), F.lit("")) == ""


def epoch_seconds(ts: Column) -> Column:
    return F.coalesce(F.unix_timestamp(ts), F.lit(0))
