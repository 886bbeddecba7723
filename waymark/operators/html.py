"""Units of web pages: paragraphs, lists and preformatted code, with heading or comments.

The page is split into tags, comments and text runs; block boundaries are running sums over
windows keyed by page, so unclosed paragraphs and nested lists need no tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import count_newlines
from waymark.operators.context import heading_above, leading_comments
from waymark.operators.spans import (
    before,
    carried,
    cut_units,
    explode_pieces,
    in_order,
    running_offset,
    so_far,
    span,
)

# How a page is cut into tokens, and what its tags mean for blocks.
TOKEN = (
    r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[a-z/!][^>]*>|[^<]+|<"
)
TAG_NAME = r"^</?([a-zA-Z][a-zA-Z0-9]*)"
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
LISTS = ["ul", "ol"]
BLOCKS = ["p", "pre"] + HEADINGS
CONTAINERS = [
    "html", "head", "body", "main", "article", "section", "nav", "aside", "header", "footer",
    "div", "form", "table", "blockquote", "script", "style",
]


def page_tokens(corpus: DataFrame) -> DataFrame:
    """Tokens with their character range, lines, and list depth before and after."""
    order = in_order("path")
    token = F.col("piece")
    name = F.lower(F.regexp_extract(token, TAG_NAME, 1))
    tokens = explode_pieces(corpus, F.regexp_extract_all("content", F.lit(TOKEN), 0)).select(
        "path",
        "n",
        "file",
        name.alias("tag"),
        F.startswith(token, F.lit("</")).alias("closes"),
        F.startswith(token, F.lit("<!--")).alias("comment"),
        (F.btrim(token, F.lit(" \t\r\n")) == "").alias("blank"),
        F.length(token).alias("width"),
        count_newlines(token).alias("newlines"),
    )
    step = F.when(F.col("tag").isin(LISTS), F.when(F.col("closes"), -1).otherwise(1)).otherwise(0)
    return (
        tokens.withColumn("start", running_offset(F.col("width"), order))
        .withColumn("end", F.col("start") + F.col("width") - 1)
        .withColumn("last_line", (F.sum("newlines").over(so_far(order)) + 1).cast("int"))
        .withColumn("first_line", F.col("last_line") - F.col("newlines"))
        .withColumn("sum", F.sum(step).over(so_far(order)))
        # A stray closing tag must not hide later lists, so depth counts from the lowest sum.
        .withColumn("floor", F.least(F.lit(0), F.min("sum").over(so_far(order))))
        .withColumn("depth", F.col("sum") - F.col("floor"))
        .withColumn("depth_before", F.coalesce(F.lag("depth").over(order), F.lit(0)))
    )


def page_blocks(corpus: DataFrame, comments: bool = False) -> DataFrame:
    """All blocks: path, kind, first and last line, start and end offset, `file` carrier.

    The outermost list is one block whatever it contains; code inside it is a block as well.
    With `comments`, `lead` is where the comments leading a block start (null otherwise).
    """
    order = in_order("path")
    tokens = page_tokens(corpus).withColumn("lead", F.lit(None).cast("int"))
    if comments:
        tokens = leading_comments(
            tokens.drop("lead"),
            order,
            is_comment=F.col("comment"),
            is_item=~F.col("comment") & ~F.col("blank"),
            code_before=F.lit(False),
            first_line=F.col("first_line"),
            last_line=F.col("last_line"),
            start=F.col("start"),
        )
    tag, closes = F.col("tag"), F.col("closes")
    top = F.col("depth_before") == 0
    opens_list = top & (F.col("depth") == 1)
    opens_block = opens_list | (top & ~closes & tag.isin(BLOCKS))
    gap = top & tag.isin(CONTAINERS)
    closes_block = closes & (
        (top & tag.isin(BLOCKS)) | ((F.col("depth") == 0) & (F.col("depth_before") == 1))
    )
    inner_open = ~top & ~closes & (tag == "pre")
    inner_close = ~top & closes & (tag == "pre")
    tokens = (
        tokens.withColumn("opens", opens_block)
        .withColumn("after_close", F.coalesce(F.lag(closes_block).over(order), F.lit(False)))
        .withColumn(
            "block",
            F.sum((F.col("opens") | gap | F.col("after_close")).cast("int")).over(so_far(order)),
        )
        .withColumn("inner_no", F.sum(inner_open.cast("int")).over(so_far(order)))
        .withColumn(
            "inner_closed", F.coalesce(F.sum(inner_close.cast("int")).over(before(order)), F.lit(0))
        )
    )
    member = F.array_compact(
        F.array(
            F.struct(F.lit("outer").alias("layer"), F.col("block").alias("no")),
            F.when(
                F.col("inner_no") > F.col("inner_closed"),
                F.struct(F.lit("inner").alias("layer"), F.col("inner_no").alias("no")),
            ),
        )
    )
    kind = (
        F.when(F.col("layer") == "inner", "code")
        .when(~F.col("opens"), F.lit(None))
        .when(F.col("tag").isin(HEADINGS), "heading")
        .when(F.col("tag").isin(LISTS), "list")
        .when(F.col("tag") == "pre", "code")
        .otherwise("paragraph")
    )
    solid = ~F.col("blank")
    return (
        tokens.withColumn("members", member)
        .select("*", F.explode_outer("members").alias("m"))
        .select("*", "m.layer", "m.no")
        .groupBy("path", "layer", "no")
        .agg(
            carried("file"),
            F.min_by(kind, "n").alias("kind"),
            F.min("first_line").alias("first"),
            F.max(F.when(solid, F.col("last_line"))).alias("last"),
            F.min("start").alias("start"),
            F.max(F.when(solid, F.col("end"))).alias("end"),
            F.min_by("lead", "n").alias("lead"),
        )
        .select("path", "file", "kind", "first", "last", "start", "end", "lead")
    )


def page_block_units(corpus: DataFrame) -> DataFrame:
    """Every block of a page as a unit of its own, headings included, without context."""
    unit = F.when(
        F.col("kind").isNotNull(),
        span(F.col("kind"), F.col("first"), F.col("last"), F.col("start"), F.col("end")),
    )
    return cut_units(page_blocks(corpus).select("path", "file", unit.alias("unit")))


def page_units(corpus: DataFrame) -> DataFrame:
    """Paragraphs and lists under the nearest heading above, and code blocks."""
    order = in_order("path", by=("start", "kind"))
    heading = heading_above(
        F.col("kind") == "heading", F.struct(F.col("start"), F.col("end")), order
    )
    blocks = page_blocks(corpus).withColumn("above", heading)
    prose = F.col("kind") != "code"
    unit = F.when(
        F.col("kind").isin("paragraph", "list", "code"),
        span(
            F.col("kind"),
            F.col("first"),
            F.col("last"),
            F.col("start"),
            F.col("end"),
            F.when(prose, F.col("above.start")),
            F.when(prose, F.col("above.end")),
        ),
    )
    return cut_units(blocks.select("path", "file", unit.alias("unit")))


def page_comment_units(corpus: DataFrame) -> DataFrame:
    """Every block of a page, its text starting at the comments that lead it."""
    unit = F.when(
        F.col("kind").isNotNull(),
        span(
            F.col("kind"),
            F.col("first"),
            F.col("last"),
            F.coalesce("lead", "start"),
            F.col("end"),
        ),
    )
    blocks = page_blocks(corpus, comments=True)
    return cut_units(blocks.select("path", "file", unit.alias("unit")))
