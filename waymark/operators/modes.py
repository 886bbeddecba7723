"""Blanking of literals that nest, by a pushdown scan over modes.

A flat pattern cannot tell where a template ends that holds code that holds a template, nor where a
here-document begins whose tag stands earlier. Here a stack of modes does: code, interpolating
text, and the code interpolated in it. Each mode has one pattern for what may change it, and one for
text in which that cannot begin, which is passed over in one piece, so the scan is linear. Only files
whose text shows such a construct (`NESTING`) come here, in Arrow batches; the others are blanked by
the flat patterns of `operators/code.py`, with the same marks.

A tag without an end line is no here-document; what a file leaves open reaches to its end. Known
limits: division behind `)` or `}` is never taken for a regular expression, case patterns with a lone
parenthesis inside a quoted command substitution, characters like Ruby's `?"`.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of blanked text, as in `operators/code.py`.
LINE_COMMENT, BLOCK_COMMENT_HEAD, BLOCK_COMMENT, QUOTED, QUOTED_MORE = "\x01", "\x02", "\x03", "_", "\x04"

# What tells that a file may hold nesting literals, by type.
NESTING = {
    "js": r"`|(?<![/*<])/(?![/*>])",
    "ts": r"`|(?<![/*<])/(?![/*>])",
    "rust": r'/\*(?s:.*?)/\*|\br?b?r#{3}',
    "cpp": r'\bR"[^(]',
    "python": r"""(?i)\b(?:f|fr|rf|t|tr|rt)["']""",
    "ruby": r"""#\{|<<[~\-A-Z"'`]|[^/]/[^/]|%[qQwWiIr]?[\[({<|!/]|`""",
    "bash": r"""<<|\$[({']|\\["'#]|\(\(""",
}

_SLASH_LINE = r"(?P<line>//[^\n]*)"
_SLASH_BLOCK = r"(?P<block>/\*(?s:.*?)(?:\*/|\Z))"
_DOUBLE_LINE = r'"(?:[^"\\\n]|\\(?s:.))*+"?'
_SINGLE_LINE = r"'(?:[^'\\\n]|\\(?s:.))*+'?"
_DOUBLE = r'"(?:[^"\\]|\\(?s:.))*+(?:"|\Z)'
_CHAR = r"'(?:\\[^\n']*+'?|[^\\'\n])'"
_TRIPLE = r'"""(?s:.*?)(?:"""|\Z)' + r"|'''(?s:.*?)(?:'''|\Z)"
_SHELL_HASH = r"(?P<line>(?<![^\s;(){}])#[^\n]*)"
_REGEX = r"/(?![*/\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
_JS_REGEX = (
    r"(?P<regex>(?:(?<=[(,=:\[!&|?{;*%~^+-])(?<!\+\+)(?<!--)|(?<==>)|(?<=\breturn)|(?<=\btypeof)|(?<=\bcase)|\A)"
    rf"\s*+{_REGEX})"
)
_RUBY_REGEX = (
    r"(?P<regex>(?:(?<=[(,=~!|&\[{;\n])|(?<=\bif)|(?<=\bunless)|(?<=\bwhen)|(?<=\band)|(?<=\bor)|\A)"
    rf"[ \t]*+{_REGEX})"
)
_PERCENT = (
    r"(?<![\w)\]}])%[qQwWiIr]?(?:\[[^\[\]]*+\]|\((?:[^()]|\([^()]*+\))*+\)|\{(?:[^{}]|\{[^{}]*+\})*+\}|<[^<>\s][^<>]*+>)"
)
_JS_CODE = rf"{_SLASH_LINE}|{_SLASH_BLOCK}|(?P<flat>{_DOUBLE_LINE}|{_SINGLE_LINE})|(?P<template>`)|{_JS_REGEX}"
_PY_CODE = rf"""(?P<line>#[^\n]*)|(?P<fstring>\b(?i:f|fr|rf|t|tr|rt)(?:\"\"\"|'''|"|'))|(?P<flat>{_TRIPLE}|{_DOUBLE_LINE}|{_SINGLE_LINE})"""
_RUBY_CODE = (
    r"(?P<block>(?m:^=begin\b)(?s:.*?)(?:(?m:^=end\b[^\n]*)|\Z))|" + _SHELL_HASH
    + r"""|(?P<document>(?:<<[~-]|(?<![\w)\]}])<<)(?:["'`](?P<quoted>[^\n"'`]+)["'`]|(?P<bare>[A-Z_]\w*)))"""
    + r"""|(?P<double>")|(?P<backquote>`)|(?P<flat>'(?:[^'\\]|\\(?s:.))*+(?:'|\Z)|""" + _PERCENT + r")|" + _RUBY_REGEX + r"|(?P<newline>\n)"
)
_BASH_CODE = (
    _SHELL_HASH
    + r"""|(?P<skip>\\(?s:.)|<<<|\$?\(\([^\n]*?\)\))"""
    + r"""|(?P<document><<-?[ \t]*+(?:'(?P<single>[^'\n]+)'|"(?P<quoted>[^"\n]+)"|\\?(?P<bare>[A-Za-z_]\w*)))"""
    + r"""|(?P<expansion>\$\{)|(?P<double>")|(?P<flat>\$'(?:[^'\\]|\\(?s:.))*+(?:'|\Z)|'[^']*+(?:'|\Z))|(?P<newline>\n)"""
)

# Text of code in which nothing begins that changes the mode; `§` stands for brackets that do.
_JS_PLAIN = r"""[^/"'`\s§]++|\s++(?!/)|(?<=\s)\s++"""
_PY_PLAIN = r"""[^#"'fFrRtT§]++|(?![fFrRtT]{1,2}["'])[fFrRtT]"""
_RUBY_PLAIN = r"""[^=#<"'`%/ \t\n§]++|[ \t]++(?!/)|(?<=[ \t])[ \t]++|=(?!begin)|<(?!<)"""
_BASH_PLAIN = r"""[^#\\<$("'\n§]++|<(?!<)|\$(?![({'])"""


class Mode(NamedTuple):
    """`pattern` finds what may change the mode; `code` modes are blanked only where hidden.

    `plain` passes over text in which `pattern` cannot match; it may stop too early, never too late.
    """

    pattern: re.Pattern
    plain: re.Pattern
    code: bool = False

    def search(self, text: str, at: int) -> re.Match | None:
        """The first match of the pattern from a place on."""
        while (at := self.plain.match(text, at).end()) < len(text):
            if found := self.pattern.match(text, at):
                return found
            at += 1
        return None


def _code(pattern: str, plain: str, brackets: str = "") -> Mode:
    return Mode(re.compile(pattern), re.compile(f"(?:{plain.replace('§', brackets)})*+"), True)


def _text(hot: str, close: str, *others: str) -> Mode:
    """Text up to `close`. What may change the mode begins with a backslash or one of `hot`."""
    return Mode(
        re.compile("|".join([r"(?P<skip>\\(?s:.))", *others, f"(?P<close>{close})"])), re.compile(rf"[^\\{hot}]*+")
    )


def _inside(code: str, plain: str, brackets: str, up: str, down: str, *others: str) -> Mode:
    """Interpolated code: brackets are counted, and the one too many ends it."""
    return _code("|".join([code, *others, f"(?P<up>{up})", f"(?P<down>{down})"]), plain, brackets)


def _fstring(quote: str) -> Mode:
    end = quote if len(quote) > 1 else rf"{quote}|(?=\n)"
    return _text(rf"{{}}\n{quote[0]}", end, r"(?P<doubled>\{\{|\}\})", r"(?P<enter>\{)")


# Modes by type. The mode an event opens has the event's name (f-strings: their quote).
MODES: dict[str, dict[str, Mode]] = {
    "js": {
        "code": _code(_JS_CODE, _JS_PLAIN),
        "template": _text("`$", "`", r"(?P<enter>\$\{)"),
        "enter": _inside(_JS_CODE, _JS_PLAIN, "{}", r"\{", r"\}"),
    },
    "python": {
        "code": _code(_PY_CODE, _PY_PLAIN),
        **{quote: _fstring(quote) for quote in ('"""', "'''", '"', "'")},
        "enter": _inside(_PY_CODE, _PY_PLAIN, r"{(\[})\]:", r"[{(\[]", r"[})\]]", "(?P<spec>:)"),
        "spec": Mode(re.compile(r"(?P<enter>\{)|(?P<close>\})"), re.compile(r"[^{}]*+")),
    },
    "ruby": {
        "code": _code(_RUBY_CODE, _RUBY_PLAIN),
        "double": _text('"#', '"', r"(?P<enter>#\{)"),
        "backquote": _text("`#", "`", r"(?P<enter>#\{)"),
        "enter": _inside(_RUBY_CODE, _RUBY_PLAIN, "{}", r"\{", r"\}"),
    },
    "bash": {
        "code": _code(_BASH_CODE, _BASH_PLAIN),
        "double": _text('"$', '"', r"(?P<enter>\$\()", r"(?P<quoted>\$\{)"),
        "expansion": _text(r"}'\"$", r"\}", r"""(?P<flat>'[^']*+')""", r'(?P<double>")', r"(?P<enter>\$\()", r"(?P<expansion>\$\{)"),
        "quoted": _text(r"}\"$", r"\}", r'(?P<double>")', r"(?P<enter>\$\()", r"(?P<quoted>\$\{)"),
        "enter": _inside(_BASH_CODE, _BASH_PLAIN, "()", r"\(", r"\)"),
    },
    "rust": {
        "code": _code(rf"""{_SLASH_LINE}|(?P<nest>/\*)|(?P<flat>\bb?r(?P<hashes>#*)"(?s:.*?)(?:"(?P=hashes)|\Z)|{_DOUBLE}|{_CHAR})""", r"""[^/"'br]++|(?!b?r#*")[br]"""),
    },
    "cpp": {
        "code": _code(rf"""{_SLASH_LINE}|{_SLASH_BLOCK}|(?P<flat>\bR"(?P<tag>[^()\\\s]{{0,16}})\((?s:.*?)(?:\)(?P=tag)"|\Z)|{_DOUBLE_LINE}|{_CHAR})""", r"""[^/"'R]++|R(?!")"""),
    },
}
MODES["ts"] = MODES["js"]
# Interpolated code stays code in these; elsewhere no unit can begin in it.
SHOWN = ("js", "ts")
_NEST = re.compile(r"/\*|\*/")


def _fill(text: str, mark: str, head: str = "") -> str:
    return head + "\n".join([mark * len(line) for line in text[len(head) :].split("\n")])


def _document_end(kind: str, found: re.Match) -> re.Pattern:
    parts = found.groupdict()
    tag = re.escape(parts.get("single") or parts.get("quoted") or parts["bare"])
    loose = found.group()[2] in "~-"
    margin = (r"[ \t]*+" if kind == "ruby" else r"\t*+") if loose else ""
    return re.compile(rf"(?m)^{margin}{tag}\r?$")


def blank_nested(text: str, kind: str) -> str:
    """Text of a type in `MODES` with literals and comments overwritten, newlines and length kept."""
    modes, out, at = MODES[kind], [], 0
    stack: list[list] = [["code", False, 0]]  # mode, hidden, open brackets
    waiting: list[re.Pattern] = []
    absent: set[str] = set()
    while at < len(text):
        name, hidden, depth = stack[-1]
        mode = modes[name]
        found = mode.search(text, at)
        begin = found.start() if found else len(text)
        quiet = hidden or not mode.code
        out.append(_fill(text[at:begin], QUOTED_MORE) if quiet else text[at:begin])
        if not found:
            break
        event, piece, at = found.lastgroup, found.group(), found.end()
        if event == "nest":
            level, at = 1, begin + 2
            while level and (edge := _NEST.search(text, at)):
                level, at = level + (1 if edge.group() == "/*" else -1), edge.end()
            piece = text[begin : (at := len(text) if level else at)]
        show = piece
        if event in ("line", "block", "nest"):
            show = _fill(piece, LINE_COMMENT) if event == "line" else _fill(piece, BLOCK_COMMENT, BLOCK_COMMENT_HEAD)
        elif event in ("flat", "regex"):
            lead = len(piece) - len(piece.lstrip()) if event == "regex" else 0
            if len(piece) > 1:  # a lone quote is no literal
                show = piece[:lead] + _fill(piece[lead:], QUOTED_MORE, QUOTED)
        elif event == "fstring":
            quote = piece.lstrip("fFrRtT")
            show = piece[: -len(quote)] + QUOTED + QUOTED_MORE * (len(quote) - 1)
            stack.append([quote, hidden, 0])
        elif event == "document":
            end = _document_end(kind, found)
            if end.pattern not in absent and end.search(text, at):
                waiting.append(end)
            else:
                absent.add(end.pattern)
        elif event == "newline" and waiting:
            for end in waiting:
                body = end.search(text, at)
                if body:
                    piece, at = piece + text[at : body.end()], body.end()
            waiting = []
            show = _fill(piece, QUOTED_MORE)
        elif event == "enter":
            show = _fill(piece, QUOTED_MORE)
            stack.append(["enter", hidden or kind not in SHOWN, 0])
        elif event == "spec":
            if not depth:
                stack.append(["spec", hidden, 0])
        elif event == "up":
            stack[-1][2] += 1
        elif event == "down":
            if depth:
                stack[-1][2] -= 1
            else:
                stack.pop()
                show = _fill(piece, QUOTED_MORE)
        elif event == "close":
            stack.pop()
            if name == "spec":  # a format spec ends with its interpolation
                stack.pop()
            show = _fill(piece, QUOTED_MORE)
        elif event in modes:
            show = _fill(piece, QUOTED_MORE, QUOTED)
            stack.append([event, hidden, 0])
        out.append(_fill(piece, QUOTED_MORE) if quiet else show)
    return "".join(out)


def nested(content: Column, kind: Column, types: tuple[str, ...]) -> Column:
    """Blanked content of files that show nesting literals, null for all others."""
    shows = F.lit(False)
    for name in types:
        if name in NESTING:
            shows = F.when(kind == name, F.rlike(content, F.lit(NESTING[name]))).otherwise(shows)

    def blank(contents: pd.Series, kinds: pd.Series) -> pd.Series:
        made = [None if c is None else blank_nested(c, k) for c, k in zip(contents, kinds)]
        return pd.Series(made, dtype=object)

    return F.pandas_udf(blank, "string")(F.when(shows, content), kind)
