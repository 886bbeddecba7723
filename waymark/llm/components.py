"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.shared import joined_by, written


def _priority(node: str) -> Column:
    # A hashed order: ids that rise along a chain would contract it one step a round.
    return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("id"))


def components(links: DataFrame) -> DataFrame:
    """`node, root` for every node of `links` (`a`, `b`: long); root is one of the component.

    Each round every node points at the neighbour of least priority if that is less than its
    own, pointers are followed once more, and links are redrawn between what they point at.
    Only links between different nodes go on, so the table shrinks by a factor each round.
    The tables of a round are written to the shared folder, and are broadcast only if they have few
    rows. A hub's links are counted before they are shuffled, and the joins on it are ones that Spark
    can split.
    """
    both = links.where("a <> b").select("a", "b")
    edges = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = None
    while not edges.isEmpty():
        least = edges.groupBy("a").agg(F.min(_priority("b")).alias("m"))
        step = least.select(
            "a", F.when(F.col("m") < _priority("a"), F.col("m")["id"]).otherwise(F.col("a")).alias("p")
        )
        step = written(step, "steps")
        placed = joined_by(step)
        after = placed(step.select(F.col("a").alias("p"), F.col("p").alias("pp")))
        moved = written(step.join(after, "p").select("a", F.col("pp").alias("p")), "moved")
        ends = placed(moved.select(F.col("a").alias("b"), F.col("p").alias("q")))
        redrawn = edges.join(placed(moved), "a").join(ends, "b").where("p <> q")
        edges = written(redrawn.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "links")
        if labels is None:
            labels = moved.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            onward = placed(moved.select(F.col("a").alias("root"), F.col("p").alias("next")))
            labels = written(
                labels.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels"
            )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
