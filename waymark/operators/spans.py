"""Shared steps of unit extraction: pieces of a file in, text spans out.

Every extractor has the same shape. The typed corpus is shuffled by path once, while each
file is still one compact row; its pieces (lines, tags, code events) are exploded after
that, so every window keyed by path finds its rows in place. Callers bound the size of files
(`extract.extract_units`), which bounds each window. The file itself rides on its first piece
and meets the finished spans again in one aggregation per path, so nothing is read or
shuffled a second time. Spans are cut from blocks of a file's text, found by number and not by
counting characters from its start, so the work grows with the file and not with its square.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from waymark.functions.hashing import content_hash
from waymark.functions.text import count_newlines

UNIT_COLUMNS = [
    "path",
    "kind",
    "start_line",
    "end_line",
    "file_hash",
    "file_mtime",
    "file_ctime",
    "content",
]


# Fixed value: characters that are not part of a unit's text at its ends.
BLANKS = " \t\r\n"
# Characters of a block of a file's text; a cut unit costs its own blocks.
BLOCK = 1024
# Characters at a file's end that are trimmed before the whole of it is.
TAIL = 64


def explode_pieces(
    corpus: DataFrame, pieces: Column, *keep: str, code: Column | None = None
) -> DataFrame:
    """One row per piece: path, kept columns, `n` (1-based), `piece`, `file` (first row only).

    `code`, a rewriting of the content that `pieces` may use, is worked out ahead of the shuffle: behind a
    Python function Spark no longer knows how rows are placed, and would shuffle every piece again.
    """
    placed = corpus.where(F.col("size") > 0)
    if code is not None:
        placed = placed.withColumn("code", code)
    placed = placed.repartition("path")
    # The pieces are a column of their own: a generator over an expression Spark cannot
    # compile would copy the whole file into the row of every piece. And the generator is an
    # outer one: for an inner one Spark adds a filter that works the pieces out once more.
    placed = placed.withColumn("pieces", pieces).withColumn("blanks", blanks_behind(F.col("content")))
    # Worked out here, where it is done once per file and not once per unit.
    whole_file = F.struct(
        blocks_of(F.col("content")).alias("blocks"),
        "mtime",
        "ctime",
        content_hash("content").alias("hash"),
        (F.length("content") - F.length("blanks")).alias("end"),
        (count_newlines(F.col("content")) - count_newlines(F.col("blanks")) + 1).alias("last_line"),
    )
    return placed.select(
        "path", *keep, "content", "blanks", "mtime", "ctime", F.posexplode_outer("pieces").alias("pos", "piece")
    ).select(
        "path",
        *keep,
        (F.col("pos") + 1).alias("n"),
        "piece",
        F.when(F.col("pos") == 0, whole_file).alias("file"),
    ).where(F.col("n").isNotNull())


def explode_lines(
    corpus: DataFrame, *keep: str, code: Column | None = None, **features: Column
) -> DataFrame:
    """Lines of `code` (else the content), reduced to `features` of `piece` before any window.

    Adds `start` and `end`, the 1-based character range of the line without its newline.
    """
    text = "content" if code is None else "code"
    lines = explode_pieces(corpus, F.split(text, "\n"), *keep, code=code).select(
        "path",
        *keep,
        "n",
        "file",
        (F.length("piece") + 1).alias("width"),
        *[value.alias(name) for name, value in features.items()],
    )
    return (
        lines.withColumn("start", running_offset(F.col("width"), in_order("path")))
        .withColumn("end", F.col("start") + F.col("width") - 2)
        .drop("width")
    )


def in_order(*keys: str, by: tuple = ("n",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*by)


def so_far(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def throughout(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def running_offset(width: Column, spec: WindowSpec) -> Column:
    """1 + total width of the earlier rows."""
    return (F.sum(width).over(so_far(spec)) - width + 1).cast("int")


def span(kind, start_line, end_line, start, end, head_start=None, head_end=None) -> Column:
    """A unit: lines, 1-based character range `[start, end]`, optional heading range.

    A null end stands for the end of the file.
    """
    nothing = F.lit(None).cast("int")
    return F.struct(
        kind.alias("kind"),
        start_line.cast("int").alias("start_line"),
        end_line.cast("int").alias("end_line"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        (nothing if head_start is None else head_start.cast("int")).alias("head_start"),
        (nothing if head_end is None else head_end.cast("int")).alias("head_end"),
    )


def cut_units(rows: DataFrame) -> DataFrame:
    """`path`, `file`, `unit` rows (either may be null) to units with their text.

    Blanks around a unit are not part of its text.
    """
    files = rows.groupBy("path").agg(
        carried("file"), F.collect_list("unit").alias("units")
    )
    text = lambda u: F.concat_ws(
        "\n",
        cut_text(F.col("file.blocks"), u["head_start"], u["head_end"]),
        cut_text(F.col("file.blocks"), u["start"], F.coalesce(u["end"], F.col("file.end"))),
    )
    # One column, so that the explode does not work the texts out for each of them. The file's own
    # text ends here: a unit's row takes what it needs of the file, not the file.
    cut = files.select(
        "path",
        F.col("file.last_line").alias("last_line"),
        F.col("file.hash").alias("file_hash"),
        F.col("file.mtime").alias("file_mtime"),
        F.col("file.ctime").alias("file_ctime"),
        F.transform("units", lambda u: F.struct(u.alias("unit"), text(u).alias("text"))).alias("cut"),
    )
    # An outer generator: for an inner one Spark adds a filter that cuts every text once more.
    return cut.select("*", F.explode_outer("cut").alias("c")).where(F.col("c").isNotNull()).select(
        "path",
        "c.unit.kind",
        "c.unit.start_line",
        F.coalesce("c.unit.end_line", "last_line").alias("end_line"),
        "file_hash",
        "file_mtime",
        "file_ctime",
        F.col("c.text").alias("content"),
    )


def carried(column: str) -> Column:
    """The one value of a group that is not null. `first` would copy it again for every row of the group."""
    return F.get(F.collect_list(column), F.lit(0)).alias(column)


def blocks_of(text: Column) -> Column:
    """A text in blocks of `BLOCK` characters, so that a place in it is found by number."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut_text(blocks: Column, start: Column, end: Column) -> Column:
    """Characters `[start, end]` (1-based) of a text in blocks, without the blanks around them.

    Looks at the blocks they lie in only; null if either is.
    """
    first = F.floor((start - 1) / BLOCK).cast("int")
    count = F.greatest(F.floor((end - 1) / BLOCK).cast("int") - first + 1, F.lit(0))
    held = F.array_join(F.slice(blocks, first + 1, count), "")
    own = F.substr(held, start - first * BLOCK, F.greatest(end - start + 1, F.lit(0)))
    return F.when(end.isNotNull(), F.get(F.transform(F.array(own), _trimmed), F.lit(0)))


def blanks_behind(text: Column) -> Column:
    """The blanks at a text's end. Spark's trim looks at every character, so it gets the end of the text first."""
    behind = lambda x: F.substr(x, F.length(F.rtrim(x, F.lit(BLANKS))) + 1)
    tail = F.right(text, F.lit(TAIL))
    return F.when(F.rlike(tail, F.lit(f"[^{BLANKS}]")), behind(tail)).otherwise(behind(text))


def _trimmed(text: Column) -> Column:
    """A text without blanks at its ends, most often as it is."""
    ends = [test(text, F.lit(c)) for c in BLANKS for test in (F.startswith, F.endswith)]
    return F.when(reduce(or_, ends), F.btrim(text, F.lit(BLANKS))).otherwise(text)
