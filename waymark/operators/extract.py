"""Units of a typed corpus, whatever the types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.code import brace_units, indent_units
from waymark.operators.filetypes import BRACE_TYPES, INDENT_TYPES, SUPPORTED_TYPES
from waymark.operators.filters import MAX_BYTES, size_filter
from waymark.operators.html import page_units
from waymark.operators.identity import identify
from waymark.operators.markdown import markdown_units
from waymark.operators.prose import prose_units

_EXTRACTORS = (
    (BRACE_TYPES, brace_units),
    (INDENT_TYPES, indent_units),
    (("markdown",), markdown_units),
    (("html",), page_units),
    (("prose",), prose_units),
)


def extract_units(
    corpus: DataFrame, types: tuple[str, ...] = SUPPORTED_TYPES, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """One row per unit; files that give none disappear.

    Files over `max_bytes` are left out (`left_out` lists them): a file's pieces meet in one
    task, so the bound is what its memory has to hold.

    Each kind of file has its own plan over its own rows, so name the `types` a corpus can
    hold when they are few: every plan left out is one scan less.
    """
    corpus = size_filter(corpus, max_bytes)
    plans = []
    for group, extractor in _EXTRACTORS:
        chosen = [t for t in group if t in types]
        if chosen:
            plans.append(extractor(corpus.where(F.col("type").isin(chosen))))
    if not plans:
        raise ValueError(f"no supported type among {types}")
    return reduce(DataFrame.unionByName, plans)


def chunk_table(
    corpus: DataFrame, types: tuple[str, ...] = SUPPORTED_TYPES, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """The chunk table of a typed corpus."""
    return identify(extract_units(corpus, types, max_bytes))


def left_out(
    corpus: DataFrame, types: tuple[str, ...] = SUPPORTED_TYPES, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """`path, size, reason` of files that `extract_units` does not look at."""
    reason = (
        F.when(F.coalesce(F.col("size"), F.lit(0)) <= 0, "empty")
        .when(F.col("size") > max_bytes, "too_large")
        .when(~F.coalesce(F.col("type").isin(*types), F.lit(False)), "type")
    )
    return corpus.select("path", "size", reason.alias("reason")).where("reason IS NOT NULL")
