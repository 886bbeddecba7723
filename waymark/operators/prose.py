"""Units of plain prose: runs of lines between blank lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.spans import carried, cut_units, explode_lines, in_order, so_far, span


def prose_units(corpus: DataFrame) -> DataFrame:
    lines = explode_lines(corpus, text=~F.rlike("piece", F.lit(r"^\s*$")))
    order = in_order("path")
    opens = F.col("text") & ~F.coalesce(F.lag("text").over(order), F.lit(False))
    blocks = (
        lines.withColumn("opens", opens.cast("int"))
        .withColumn("block", F.when(F.col("text"), F.sum("opens").over(so_far(order))))
        .groupBy("path", "block")
        .agg(
            carried("file"),
            F.min("n").alias("first"),
            F.max("n").alias("last"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
        )
    )
    unit = F.when(
        F.col("block").isNotNull(),
        span(F.lit("paragraph"), F.col("first"), F.col("last"), F.col("start"), F.col("end")),
    )
    return cut_units(blocks.select("path", "file", unit.alias("unit")))
