"""Units of markdown: paragraphs and lists with the heading above, and fenced code.

Line classes and gaps-and-islands over windows keyed by path. Known limits of working
without a grammar: a list's continuation is judged by indentation, fences toggle, and
structure inside block quotes is not looked into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.context import heading_above
from waymark.operators.spans import carried, cut_units, explode_lines, in_order, so_far, span

# Line patterns of the format, and the tags that open a markup block.
BLANK = r"^\s*$"
FENCE = r"^\s*(?:```|~~~)"
ATX_HEADING = r"^ {0,3}#{1,6}(?:\s|$)"
UNDERLINE = r"^ {0,3}(?:=+|-+)\s*$"
RULE = r"^ {0,3}(?:-\s*-\s*-[\s-]*|\*\s*\*\s*\*[\s*]*|_\s*_\s*_[\s_]*)$"
LIST_ITEM = r"^ {0,3}(?:[-*+]|\d{1,9}[.)])(?:\s|$)"
TABLE_RULE = r"^\s*\|?\s*:?-+:?\s*\|[\s:|-]*$"
INDENTED = r"^(?: {2}|\t)"
CODE_INDENT = r"^(?: {4}|\t)"
MARKUP_OPEN = (
    r"(?i)^ {0,3}(?:<!--|</?(?:address|article|aside|blockquote|body|center|dd|details|dialog|div"
    r"|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|li|link|main|menu|nav"
    r"|ol|p|pre|script|section|style|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul)"
    r"(?:\s|/?>|$))"
)


def markdown_blocks(corpus: DataFrame) -> DataFrame:
    """All blocks, headings included: path, kind, line and character range, `file` carrier.

    Kinds: heading, paragraph, list, code, and other (tables, markup, rules, indented code).
    """
    order = in_order("path")
    like = lambda pattern: F.rlike("piece", F.lit(pattern))
    lines = (
        explode_lines(
            corpus,
            blank=like(BLANK),
            mark=like(FENCE),
            hash_line=like(ATX_HEADING),
            line_rule=like(RULE),
            underlining=like(UNDERLINE),
            bullet=like(LIST_ITEM),
            indented=like(INDENTED),
            quote=like(r"^ {0,3}>"),
            table=like(TABLE_RULE),
            foreign=like(CODE_INDENT) | like(MARKUP_OPEN),
        )
        .withColumn("fences", F.sum(F.col("mark").cast("int")).over(so_far(order)))
        .withColumn("fenced", F.col("mark") | (F.col("fences") % 2 == 1))
        .withColumn("fence_no", F.when(F.col("fenced"), F.ceil(F.col("fences") / 2)))
        .withColumn("after_blank", F.coalesce(F.lag("blank").over(order), F.lit(True)))
    )
    opens_fence = F.col("mark") & (F.col("fences") % 2 == 1)
    plain = ~F.col("fenced") & ~F.col("blank")
    rule = plain & F.col("line_rule")
    heading = plain & F.col("hash_line")
    item = plain & F.col("bullet") & ~rule
    outside = (
        ~item
        & ~F.col("indented")
        & ((plain & F.col("after_blank")) | heading | rule | opens_fence)
    )
    lines = (
        lines.withColumn("item", item)
        .withColumn("heading", heading)
        .withColumn("rule", rule)
        .withColumn("list_state", F.when(item, True).when(outside, False))
        .withColumn(
            "in_list",
            F.coalesce(F.last("list_state", ignorenulls=True).over(so_far(order)), F.lit(False)),
        )
        .withColumn("was_list", F.coalesce(F.lag("in_list").over(order), F.lit(False)))
        .withColumn(
            "list_no",
            F.sum((F.col("in_list") & ~F.col("was_list")).cast("int")).over(so_far(order)),
        )
        .withColumn("loose", plain & ~F.col("in_list") & ~F.col("heading"))
        .withColumn("was_loose", F.coalesce(F.lag("loose").over(order), F.lit(False)))
        .withColumn("underline", F.col("loose") & F.col("was_loose") & F.col("underlining"))
        .withColumn("loose", F.col("loose") & (F.col("underline") | ~F.col("rule")))
        .withColumn("was_quote", F.coalesce(F.lag("quote").over(order), F.lit(False)))
        .withColumn("was_underline", F.coalesce(F.lag("underline").over(order), F.lit(False)))
    )
    opens_run = F.col("loose") & (
        ~F.col("was_loose")
        | F.col("was_underline")
        | (F.col("quote") & ~F.col("was_quote"))
        | F.coalesce(F.lag("rule").over(order) & ~F.col("was_underline"), F.lit(False))
    )
    lines = lines.withColumn("run_no", F.sum(opens_run.cast("int")).over(so_far(order)))
    # A line is in at most two blocks: a list, and fenced code inside that list.
    member = F.array_compact(
        F.array(
            F.when(F.col("fenced"), _member("code", F.col("fence_no"))),
            F.when(F.col("in_list"), _member("list", F.col("list_no"))),
            F.when(F.col("heading"), _member("heading", F.col("n"))),
            F.when(F.col("loose"), _member("run", F.col("run_no"))),
        )
    )
    blocks = (
        lines.withColumn("members", member)
        .select(
            "path",
            "file",
            "n",
            "start",
            "blank",
            "fenced",
            "underline",
            "end",
            "foreign",
            "table",
            F.explode_outer("members").alias("m"),
        )
        .groupBy("path", F.col("m.kind").alias("kind"), F.col("m.no").alias("no"))
        .agg(
            carried("file"),
            F.min("n").alias("first"),
            F.max(F.when(~F.col("blank") | F.col("fenced"), F.col("n"))).alias("last"),
            F.min("start").alias("start"),
            F.max(F.when(~F.col("blank") | F.col("fenced"), F.col("end"))).alias("end"),
            F.min_by("foreign", "n").alias("foreign"),
            F.bool_or("table").alias("table"),
            F.bool_or("underline").alias("underlined"),
        )
    )
    kind = (
        F.when(F.col("kind") != "run", F.col("kind"))
        .when(F.col("underlined"), "heading")
        .when(F.col("foreign") | F.col("table"), "other")
        .when(F.col("kind") == "run", "paragraph")
    )
    return blocks.select("path", "file", kind.alias("kind"), "first", "last", "start", "end")


def markdown_units(corpus: DataFrame) -> DataFrame:
    """Paragraphs, outermost lists and fenced code, the first two under their heading."""
    # Code inside a list starts after the list does, so starts order blocks; a block's own
    # row is never a heading it could take.
    order = in_order("path", by=("start", "kind"))
    heading = heading_above(
        F.col("kind") == "heading",
        F.struct(F.col("start"), F.col("end")),
        order,
    )
    blocks = markdown_blocks(corpus).withColumn("above", heading)
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


def _member(kind: str, no: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), no.cast("int").alias("no"))
