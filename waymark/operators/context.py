"""Context carried into a unit: the heading above it, the comments leading it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from waymark.operators.spans import before, so_far

# Fixed value: a comment ending at most this many lines above counts as attached.
COMMENT_GAP = 2


def heading_above(is_heading: Column, value: Column, spec: WindowSpec) -> Column:
    """Value of the nearest earlier heading row, null when there is none."""
    return F.last(F.when(is_heading, value), ignorenulls=True).over(before(spec))


def leading_comments(
    items: DataFrame,
    spec: WindowSpec,
    is_comment: Column,
    first_line: Column,
    last_line: Column,
    start: Column,
    code_before: Column,
    is_item: Column,
) -> DataFrame:
    """Add `lead`: offset where the comments leading each row start, null when none do.

    `items` are the children of one parent, ordered by `spec` (which must be keyed by that
    parent). The nearest earlier comment counts if it ends at most `COMMENT_GAP` lines above,
    whatever lies between; from there the run goes up through comments with nothing but
    such a gap between them. `code_before` marks a comment with code directly before it,
    `is_item` the rows that are children other than comments.
    """
    previous_item = F.last(
        F.when(is_comment, "comment").when(is_item, "item"), ignorenulls=True
    ).over(before(spec))
    previous_end = F.last(F.when(is_comment, last_line), ignorenulls=True).over(before(spec))
    opens_run = is_comment & (
        code_before
        | F.coalesce(previous_item != "comment", F.lit(True))
        | (first_line - previous_end > COMMENT_GAP)
    )
    labelled = items.withColumn("run_start", F.when(opens_run, start)).withColumn(
        "run_start", F.last("run_start", ignorenulls=True).over(so_far(spec))
    )
    nearest = F.last(
        F.when(is_comment, F.struct(F.col("run_start"), last_line.alias("end"))), ignorenulls=True
    ).over(before(spec))
    return labelled.withColumn("nearest", nearest).withColumn(
        "lead",
        F.when(first_line - F.col("nearest.end") <= COMMENT_GAP, F.col("nearest.run_start")),
    )
