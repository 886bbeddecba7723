"""Units of source code: functions and the like, with the comments leading them.

Without a grammar, a file is reduced to events on nesting levels and every question is a
running window over them, linear in the file:

1. String and comment text is blanked in place, so offsets stay true and quoted braces
   are harmless.
2. Brace languages give events at braces, semicolons, comments and unit headers; indented
   languages give events at lines.
3. A unit ends at the first closing event of its own level, so nested units come out
   overlapping, each on its own level.

Literals that nest (templates, here-documents, interpolations) are blanked by `operators/modes.py`.

Known limits: structure made by macros or preprocessor conditions, and object types between a
TypeScript parameter list and its body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import count_newlines
from waymark.operators.context import leading_comments
from waymark.operators.filetypes import BRACE_TYPES, INDENT_TYPES
from waymark.operators.modes import nested
from waymark.operators.spans import (
    before,
    cut_units,
    explode_lines,
    explode_pieces,
    in_order,
    running_offset,
    so_far,
    span,
    throughout,
)
from waymark.session import small_file_batches

# Marks written over blanked text, each one character per character replaced.
LINE_COMMENT, BLOCK_COMMENT_HEAD, BLOCK_COMMENT, QUOTED, QUOTED_MORE = (
    "\x01", "\x02", "\x03", "_", "\x04",
)

# Comment and string syntax by language family (possessive, so that long
# literals cost no regex stack).
_SLASH_COMMENTS = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
_DOUBLE = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+(?:"|\z)'
_DOUBLE_LINE = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"?'
_SINGLE_LINE = r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'?"
_CHAR = r"'(?:\\[^\n']*+'?|[^\\'\n])'"
_BACKTICK = r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+(?:`|\z)"
_TRIPLE = r'"""(?s:.*?)(?:"""|\z)' + r"|'''(?s:.*?)(?:'''|\z)"
_HASH = r"(?<![^\s;(){}])#[^\n]*+"
LITERALS = {
    "rust": [_SLASH_COMMENTS, r'\bb?r"[^"]*+"', r'\bb?r#"(?s:.*?)"#', r'\bb?r##"(?s:.*?)"##',
             _DOUBLE, _CHAR],
    "js": [_SLASH_COMMENTS, _DOUBLE_LINE, _SINGLE_LINE, _BACKTICK],
    "ts": [_SLASH_COMMENTS, _DOUBLE_LINE, _SINGLE_LINE, _BACKTICK],
    "go": [_SLASH_COMMENTS, _DOUBLE_LINE, r"`[^`]*+`", _CHAR],
    "java": [_SLASH_COMMENTS, r'"""(?s:.*?)(?:"""|\z)', _DOUBLE_LINE, _CHAR],
    "c": [_SLASH_COMMENTS, _DOUBLE_LINE, _CHAR],
    "cpp": [_SLASH_COMMENTS, r'\bR"\((?s:.*?)\)"', _DOUBLE_LINE, _CHAR],
    "bash": [_HASH, _DOUBLE, r"'[^']*+'"],
    "python": [r"#[^\n]*+", _TRIPLE, _DOUBLE_LINE, _SINGLE_LINE],
    "ruby": [r"(?md:^=begin\b)(?s:.*?)(?md:^=end\b[^\n]*+|\z)", r"(?<![^\s;(){}])#[^\n]*+",
             _DOUBLE, r"'[^'\\]*+(?:\\(?s:.)[^'\\]*+)*+(?:'|\z)"],
}

# Text in which no such literal can start. It is passed over in one piece, since each
# piece is looked at on its own.
_PLAIN_SLASH = r"/(?![/*])"
PLAIN = {
    "rust": rf"(?:[^/'\"rb]++|{_PLAIN_SLASH}|(?!b?r#{{0,2}}\")[rb])++",
    "js": rf"(?:[^/'\"`]++|{_PLAIN_SLASH})++",
    "ts": rf"(?:[^/'\"`]++|{_PLAIN_SLASH})++",
    "go": rf"(?:[^/'\"`]++|{_PLAIN_SLASH})++",
    "java": rf"(?:[^/'\"]++|{_PLAIN_SLASH})++",
    "c": rf"(?:[^/'\"]++|{_PLAIN_SLASH})++",
    "cpp": rf"(?:[^/'\"R]++|{_PLAIN_SLASH}|R(?!\"))++",
    "bash": r"[^#'\"]++",
    "python": r"[^#'\"]++",
    "ruby": r"(?:[^#'\"=]++|=(?!begin))++",
}

# The characters that a literal of any type begins with.
OPENERS = tuple("#/=bRr\"'`")
HASH_COMMENTS = ("bash", "python", "ruby")
BACKTICKS = ("js", "ts", "go")

# Parentheses up to four deep.
_P0 = r"\([^()]*+\)"
_P1 = rf"\((?:[^()]++|{_P0})*+\)"
_P2 = rf"\((?:[^()]++|{_P1})*+\)"
PARENS = rf"\((?:[^()]++|{_P2})*+\)"

_GENERICS = r"(?:<[^{};]*?>)?"
_BRACKETED = r"[^{;\[]*+(?:\[[^\]]*+\][^{;\[]*+)*+"
_RUST_VISIBLE = r"(?:pub(?:\s*\([^)]*+\))?\s+)?"
_CONTROL = r"if|for|while|switch|catch|return|sizeof|else|do|new|throw|case|goto|delete|typedef"
_JAVA_MODIFIER = (
    r"public|protected|private|static|final|abstract|native|synchronized|default|strictfp"
)
_JAVA_NOT_TYPE = (
    rf"(?!(?:{_JAVA_MODIFIER}|{_CONTROL}|class|interface|enum|record|assert|package|import"
    r"|instanceof|extends|implements|throws|yield)\b)"
)

# What opens a unit, by type (searched in blanked text, line starts as ^).
HEADERS = {
    "rust": rf"\b{_RUST_VISIBLE}(?:(?:const|async|unsafe|default|extern(?:\s+_\x04*+)?)\s+)*+fn\s+\w++"
            rf"\s*{_GENERICS}\s*{PARENS}(?:\s*->{_BRACKETED})?"
            rf"|\b{_RUST_VISIBLE}struct\s+\w++\s*{_GENERICS}(?:\s*{PARENS})?"
            rf"|^[ \t]*+(?:unsafe\s+)?impl\b{_BRACKETED}",
    "js": rf"\b(?:async\s+)?function\b(?!\s*\*)\s*[\w$]*+\s*{PARENS}",
    "ts": rf"\b(?:async\s+)?function\b(?!\s*\*)\s*[\w$]*+\s*{_GENERICS}\s*{PARENS}",
    "go": rf"^func\s*(?:{PARENS}\s*)?\w++\s*(?:\[[^\]]*+\])?\s*{PARENS}",
    "java": rf"^[ \t]*+(?:@[\w.]++(?:{PARENS})?\s+)*+(?:(?:{_JAVA_MODIFIER})\s+)*+"
            rf"(?:<[^{{}};()]*>\s*)?{_JAVA_NOT_TYPE}[\w.]++(?:<[^{{}};()]*>)?(?:\s*\[\s*\])*+\s+"
            rf"(?!(?:{_CONTROL})\b)\w++\s*{PARENS}",
    "c": rf"^[ \t]*+(?!(?:{_CONTROL})\b)(?:\w++[\s*]++){{1,8}}?\**(?!(?:{_CONTROL})\b)\w++\s*{PARENS}",
    "cpp": rf"^[ \t]*+(?!(?:{_CONTROL})\b)(?:[\w~]++(?:::~?\w++)*+(?:<[^{{}};()]*>)?(?:::\w++)*+[\s*&]++){{0,8}}?"
           rf"(?!(?:{_CONTROL})\b)(?:~?\w++(?:::~?\w++)*+|(?:\w++::)*+operator\s*[^\s(\w]{{1,3}}+)\s*{PARENS}",
    "bash": r"^[ \t]*+(?:function\s+[\w:.-]++\s*(?:\(\s*\))?|[\w:.-]++\s*\(\s*\))",
}

# Indented languages' headers, and one-line units of theirs.
DEFINITION = {
    "python": r"^[ \t]*+(?:async[ \t]+)?def[ \t]+\w",
    "ruby": r"^[ \t]*+(?:\w++[ \t]+)?def[ \t]+[^\s(;]",
}
ONE_LINE = {
    "ruby": r"\bend\s*(?:\x01*+)$|^[ \t]*+(?:\w++[ \t]+)?def[ \t]+[^\s(=]++(?:\([^)]*+\))?\s*=\s",
}

_COMMENT_EVENT = (
    f"{BLOCK_COMMENT_HEAD}{BLOCK_COMMENT}*+(?:\\n++{BLOCK_COMMENT}++)*+|{LINE_COMMENT}++"
)


def code_units(corpus: DataFrame) -> DataFrame:
    """Units of every code file of a typed corpus (`type` column)."""
    return brace_units(corpus).unionByName(indent_units(corpus))


def brace_units(corpus: DataFrame) -> DataFrame:
    """Units of brace languages."""
    small_file_batches(corpus.sparkSession)
    typed = corpus.where(F.col("type").isin(list(BRACE_TYPES)))
    return cut_units(brace_spans(typed))


def indent_units(corpus: DataFrame) -> DataFrame:
    """Units of languages whose blocks show in the indentation."""
    small_file_batches(corpus.sparkSession)
    typed = corpus.where(F.col("type").isin(list(INDENT_TYPES)))
    return cut_units(indent_spans(typed))


def blanked(content: Column, kind: Column, types: tuple[str, ...]) -> Column:
    """Content with string and comment text overwritten, newlines and length kept.

    Files with literals that nest go through `modes.nested`, the others through flat patterns.
    """
    by_modes = nested(content, kind, types)
    content = F.when(by_modes.isNull(), content)
    tokens = {
        name: "|".join(LITERALS[name] + [PLAIN[name], "(?s:.)"]) for name in types
    }
    pieces = F.regexp_extract_all(content, pattern_of(kind, tokens), F.lit(0))
    hashes = kind.isin(*HASH_COMMENTS)

    def over(text: Column, mark: str) -> Column:
        one = F.repeat(F.lit(mark), F.length(text))
        return F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r"[^\n]", mark)).otherwise(one)

    def blank(piece: Column) -> Column:
        fill = lambda mark: over(piece, mark)
        head = lambda first, more: F.concat(F.lit(first), over(F.substr(piece, F.lit(2)), more))
        like = lambda pattern: F.rlike(piece, F.lit(pattern))
        begins = lambda text: F.startswith(piece, F.lit(text))
        return (
            F.when(~F.left(piece, F.lit(1)).isin(*OPENERS), piece)
            .when(hashes & begins("#"), fill(LINE_COMMENT))
            .when(~hashes & begins("//"), fill(LINE_COMMENT))
            .when(~hashes & begins("/*"), head(BLOCK_COMMENT_HEAD, BLOCK_COMMENT))
            .when((kind == "ruby") & begins("=begin"), head(BLOCK_COMMENT_HEAD, BLOCK_COMMENT))
            # A lone quote is no literal.
            .when(like(r"(?s)^(?:b?r#*|R)?[\"']."), head(QUOTED, QUOTED_MORE))
            .when(kind.isin(*BACKTICKS) & like("(?s)^`."), head(QUOTED, QUOTED_MORE))
            .otherwise(piece)
        )

    return F.coalesce(by_modes, F.array_join(F.transform(pieces, blank), ""))


def pattern_of(kind: Column, patterns: dict[str, str]) -> Column:
    """The pattern of a row's type, so that one regex expression serves all types."""
    return F.coalesce(*[F.when(kind == name, F.lit(p)) for name, p in patterns.items()])


# --- brace languages ---------------------------------------------------------------------


def brace_events(corpus: DataFrame) -> DataFrame:
    """Events in file order: header, open, close, semi, comment, or the rest of the file.

    Each has its character range and lines, and whether code stands between it and the
    event before.
    """
    kind, piece = F.col("type"), F.col("piece")
    # An empty interface or struct type is no block.
    code = F.regexp_replace(
        blanked(F.col("content"), kind, BRACE_TYPES), r"\b(interface|struct)\{\}", "$1__"
    )
    events = {
        name: rf"(?s:.*?)(?:(?md:{HEADERS[name]})|[{{}};]|{_COMMENT_EVENT}|\z)"
        for name in BRACE_TYPES
    }
    headers = {name: rf"(?md:{HEADERS[name]})\z" for name in BRACE_TYPES}
    pieces = F.regexp_extract_all("code", pattern_of(kind, events), F.lit(0))
    header = F.call_function("regexp_extract", piece, pattern_of(kind, headers), F.lit(0))
    last = F.right(piece, F.lit(1))
    comment = F.regexp_extract(piece, rf"(?:{_COMMENT_EVENT})\z", 0)
    text = (
        F.when(last.isin("{", "}", ";"), last)
        .when(last.isin(LINE_COMMENT, BLOCK_COMMENT, BLOCK_COMMENT_HEAD), comment)
        .otherwise(F.ltrim(header, F.lit(" \t")))
    )
    event = (
        F.when(last == "{", "open")
        .when(last == "}", "close")
        .when(last == ";", "semi")
        .when(last.isin(LINE_COMMENT, BLOCK_COMMENT, BLOCK_COMMENT_HEAD), "comment")
        .when(F.col("text") != "", "header")
        .otherwise("rest")
    )
    unit_kind = (
        F.when(F.rlike("text", F.lit(r"^(?:unsafe\s+)?impl\b")) & (kind == "rust"), "impl")
        .when(F.rlike("text", F.lit(r"\bstruct\s+\w++(?!.*\bfn\b)")) & (kind == "rust"), "struct")
        .otherwise("function")
    )
    order = in_order("path")
    return (
        explode_pieces(corpus, pieces, "type", code=code)
        .withColumn("text", text)
        .select(
            "path",
            "n",
            "file",
            event.alias("event"),
            F.when(event == "header", unit_kind).alias("kind"),
            # A unit that may end without a body.
            ((kind == "java") | ((kind == "rust") & (unit_kind == "struct"))).alias("bodiless"),
            F.rlike(
                F.substr(piece, F.lit(1), F.length(piece) - F.length("text")), F.lit(r"\S")
            ).alias("code_before"),
            F.length("text").alias("width"),
            F.length(piece).alias("piece_width"),
            count_newlines(F.col("text")).alias("newlines"),
            count_newlines(piece).alias("piece_newlines"),
        )
        .withColumn("end", F.sum("piece_width").over(so_far(order)).cast("int"))
        .withColumn("start", F.col("end") - F.col("width") + 1)
        .withColumn("last_line", (F.sum("piece_newlines").over(so_far(order)) + 1).cast("int"))
        .withColumn("first_line", F.col("last_line") - F.col("newlines"))
        .drop("width", "piece_width", "newlines", "piece_newlines")
    )


def brace_spans(corpus: DataFrame) -> DataFrame:
    """`path`, `file`, `unit` rows of brace languages."""
    event = F.col("event")
    step = F.when(event == "open", 1).when(event == "close", -1).otherwise(0)
    depth = F.sum(step).over(so_far(in_order("path")))
    level = lambda value, name: F.struct(
        value.cast("int").alias("level"), name.alias("event")
    )
    # A closing brace ends a block of its own level and the scope one level further in.
    leveled = (
        brace_events(corpus)
        .withColumn("depth", depth)
        .withColumn(
            "at",
            F.explode(
                F.when(event == "open", F.array(level(F.col("depth") - 1, event)))
                .when(
                    event == "close",
                    F.array(level(F.col("depth"), event), level(F.col("depth") + 1, F.lit("scope"))),
                )
                .otherwise(F.array(level(F.col("depth"), event)))
            ),
        )
        .drop("event", "depth")
        .select("*", "at.level", "at.event")
        .drop("at")
    )
    backward = in_order("path", "level", by=(F.desc("n"),))
    here = F.struct("end", "last_line")
    # Most events are inside bodies; a level without a header has no unit to find.
    headed = F.max(event == "header").over(throughout(backward))
    closed = leveled.withColumn("headed", headed).where(
        F.col("headed") | F.col("file").isNotNull()
    ).withColumn(
        "match",
        F.last(F.when(event == "close", here), ignorenulls=True).over(before(backward)),
    ).withColumn(
        "next",
        F.last(
            F.when(
                event.isin("open", "semi", "scope"),
                F.struct(
                    event.alias("event"),
                    F.when(event == "open", F.col("match"))
                    .when(event == "semi", here)
                    .alias("stop"),
                ),
            ),
            ignorenulls=True,
        ).over(before(backward)),
    )
    unit_ends = (F.col("next.event") == "open") | (
        (F.col("next.event") == "semi") & F.col("bodiless")
    )
    scope = F.sum((event == "scope").cast("int")).over(so_far(in_order("path", "level")))
    led = leading_comments(
        closed.withColumn("scope", scope),
        in_order("path", "level", "scope"),
        is_comment=event == "comment",
        is_item=event.isin("header", "open", "close", "semi"),
        code_before=F.col("code_before"),
        first_line=F.col("first_line"),
        last_line=F.col("last_line"),
        start=F.col("start"),
    )
    unit = F.when(
        (event == "header") & unit_ends,
        span(
            F.col("kind"),
            F.col("first_line"),
            F.col("next.stop.last_line"),
            F.coalesce("lead", "start"),
            F.col("next.stop.end"),
        ),
    )
    return led.select("path", "file", unit.alias("unit")).where(
        F.col("file").isNotNull() | F.col("unit").isNotNull()
    )


# --- indented languages ------------------------------------------------------------------


def indent_spans(corpus: DataFrame) -> DataFrame:
    """`path`, `file`, `unit` rows of indented languages."""
    kind, piece = F.col("type"), F.col("piece")
    like = lambda pattern: F.rlike("piece", F.lit(pattern))
    # A pattern per type: one chosen by row would be compiled for every line.
    by_type = lambda table: F.coalesce(
        *[F.when(kind == name, like(pattern)) for name, pattern in table.items()], F.lit(False)
    )
    margin = F.length(piece) - F.length(F.ltrim(piece, F.lit(" \t")))
    tabs = lambda text: F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\t"), F.lit("")))
    without = lambda char: F.octet_length(F.replace(piece, F.lit(char), F.lit("")))
    lines = explode_lines(
        corpus,
        "type",
        code=blanked(F.col("content"), kind, INDENT_TYPES),
        python=kind == "python",
        has_code=like(r"[^\s\x01\x02\x03]"),
        inside=F.startswith(piece, F.lit(QUOTED_MORE)),
        comment_at=F.length(F.regexp_extract(piece, r"^[^\x01-\x03]*+", 0)),
        has_comment=like(r"[\x01-\x03]"),
        indent=margin + 7 * tabs(F.left(piece, margin)),
        margin=margin,
        nesting=without(")") + without("]") + without("}") - without("(") - without("[") - without("{"),
        definition=by_type(DEFINITION),
        one_line=by_type(ONE_LINE),
        ender=like(r"^[ \t]*+end\b") & (kind == "ruby"),
        decorator=like(r"^[ \t]*+@") & (kind == "python"),
    )
    order = in_order("path")
    spot = F.struct("n", "end")
    lines = (
        lines.withColumn("open_parens", F.coalesce(F.sum("nesting").over(before(order)), F.lit(0)))
        .withColumn("logical", F.col("has_code") & ~F.col("inside") & (F.col("open_parens") <= 0))
        .withColumn(
            "previous",
            F.last(F.when(F.col("has_code"), spot), ignorenulls=True).over(before(order)),
        )
        .withColumn(
            "was_indent",
            F.last(F.when(F.col("logical"), F.col("indent")), ignorenulls=True).over(before(order)),
        )
        .withColumn(
            "whole",
            F.max(F.when(F.col("has_code"), spot)).over(throughout(order)),
        )
    )
    # A line closes every level from its own indent up to that of the line before.
    at = lambda level, rank, event: F.struct(
        level.alias("level"), F.lit(rank).alias("rank"), event.alias("event")
    )
    none = F.array().cast(f"array<{'struct<level:int,rank:int,event:string>'}>")
    levels = F.concat(
        F.array(at(F.col("indent"), 1, F.lit("item"))),
        F.when(
            F.col("was_indent") > F.col("indent"),
            F.transform(
                F.sequence(F.col("indent") + 1, "was_indent"), lambda k: at(k, 1, F.lit("scope"))
            ),
        ).otherwise(none),
    )
    header = F.array(at(F.col("indent"), 0, F.lit("header")))
    comment = F.array(at(F.col("indent"), 2, F.lit("comment")))
    events = (
        lines.withColumn(
            "ats",
            F.concat(
                F.when(F.col("logical") & F.col("definition"), header).otherwise(none),
                F.when(F.col("logical"), levels).otherwise(none),
                F.when(F.col("has_comment"), comment).otherwise(none),
                # Keeps the file's first row whatever it holds.
                F.when(
                    F.col("file").isNotNull(), F.array(at(F.lit(-1), 3, F.lit("file")))
                ).otherwise(none),
            ),
        )
        .withColumn("at", F.explode_outer("ats"))
        .select("*", "at.*")
        .drop("ats", "at")
        .where(F.col("level").isNotNull())
    )
    event = F.col("event")
    backward = in_order("path", "level", by=(F.desc("n"), F.asc("rank")))
    stop = (
        F.when(F.col("python"), F.when(event.isin("item", "scope"), F.col("previous")))
        .when(event == "scope", F.col("previous"))
        .when((event == "item") & F.col("ender"), spot)
    )
    closed = events.withColumn(
        "next", F.last(stop, ignorenulls=True).over(before(backward))
    ).withColumn(
        "stop", F.when(F.col("one_line"), spot).otherwise(F.coalesce("next", "whole"))
    )
    forward = in_order("path", "level", by=("n", "rank"))
    scope = F.sum((event == "scope").cast("int")).over(so_far(forward))
    siblings = in_order("path", "level", "scope", by=("n", "rank"))
    led = leading_comments(
        closed.withColumn("scope", scope),
        siblings,
        is_comment=event == "comment",
        is_item=event.isin("header", "item"),
        code_before=F.col("has_code"),
        first_line=F.col("n"),
        last_line=F.col("n"),
        start=F.col("start") + F.col("comment_at"),
    ).withColumn(
        # Comments above a decorator lead the decorated definition, not the function in it.
        "decorated",
        F.last(
            F.when(event == "item", F.when(F.col("decorator"), F.col("n")).otherwise(0)),
            ignorenulls=True,
        ).over(before(siblings)),
    )
    lead = F.when(F.coalesce("decorated", F.lit(0)) < F.col("nearest.end"), F.col("lead"))
    unit = F.when(
        event == "header",
        span(
            F.lit("function"),
            F.col("n"),
            F.col("stop.n"),
            F.coalesce(lead, F.col("start") + F.col("margin")),
            F.col("stop.end"),
        ),
    )
    return led.select(
        "path", F.when(event == "file", F.col("file")).alias("file"), unit.alias("unit")
    ).where(F.col("file").isNotNull() | F.col("unit").isNotNull())
