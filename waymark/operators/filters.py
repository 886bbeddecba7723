"""Row filters on a corpus or an index."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import is_blank

# Fixed value: larger sources are not taken for text worth indexing.
MAX_BYTES = 1_000_000


def size_filter(corpus: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Keep sources of 1 to `max_bytes` bytes. Also what bounds every per-path window."""
    return corpus.where((F.col("size") > 0) & (F.col("size") <= max_bytes))


def attribute_filter(*terms: tuple[str, str, Any]) -> Column:
    """Predicate from `(column, operator, value)` terms joined by OR; operators Eq and Gt."""
    if not terms:
        raise ValueError("at least one term is needed")
    return reduce(or_, (_term(*t) for t in terms))


def _term(column: str, operator: str, value: Any) -> Column:
    if operator == "Eq":
        return F.col(column) == value
    if operator == "Gt":
        return F.col(column) > value
    raise ValueError(f"unknown operator {operator!r}")


def where_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a table of keys: the form an OR over many equal-tests takes."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def split_blank_queries(queries: DataFrame, text: str = "query") -> tuple[DataFrame, DataFrame]:
    """(usable queries with their text untouched, blank ones with an error status)."""
    blank = is_blank(F.col(text))
    rejected = queries.where(blank).withColumn("status", F.lit("empty_query"))
    return queries.where(~blank), rejected
