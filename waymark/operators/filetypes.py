"""File-type assignment from names: globs, the last matching supported rule wins."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import file_name


class TypeRule(NamedTuple):
    glob: str
    type: str


# Types units can be extracted from, grouped by how their units are found.
BRACE_TYPES = ("rust", "js", "ts", "go", "java", "c", "cpp", "bash")
INDENT_TYPES = ("python", "ruby")
CODE_TYPES = BRACE_TYPES + INDENT_TYPES
SUPPORTED_TYPES = CODE_TYPES + ("markdown", "html", "prose")

# Order matters: for a name several globs match, the last supported one decides.
DEFAULT_RULES = tuple(
    TypeRule(glob, kind)
    for kind, globs in {
        "rust": ["*.rs"],
        "python": ["*.py", "*.pyi"],
        "js": ["*.js", "*.jsx", "*.mjs", "*.cjs", "*.vue"],
        "ts": ["*.ts", "*.tsx", "*.mts", "*.cts"],
        "go": ["*.go"],
        "java": ["*.java"],
        "c": ["*.c", "*.h"],
        "cpp": ["*.h", "*.cpp", "*.cc", "*.cxx", "*.hpp", "*.hh", "*.hxx"],
        "ruby": ["*.rb", "*.gemspec", "Gemfile", "Rakefile"],
        "bash": ["*.sh", "*.bash"],
        "markdown": ["*.md", "*.markdown", "*.mdown", "*.mkd"],
    }.items()
    for glob in globs
)

# For corpora adapted from tables of web pages and plain prose.
TABLE_RULES = DEFAULT_RULES + (TypeRule("*.html", "html"), TypeRule("*.prose", "prose"))


def type_of(path: Column, rules: tuple[TypeRule, ...] = DEFAULT_RULES) -> Column:
    """Type of a path as one expression (no join), null when no supported rule matches."""
    name = file_name(path)
    tests = [
        F.when(_matches(name, rule.glob), F.lit(rule.type))
        for rule in reversed(rules)
        if rule.type in SUPPORTED_TYPES
    ]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def assign_type(corpus: DataFrame, rules: tuple[TypeRule, ...] = DEFAULT_RULES) -> DataFrame:
    """Add `type` and drop rows no rule gives one to."""
    return corpus.withColumn("type", type_of(F.col("path"), rules)).where(F.col("type").isNotNull())


def _matches(name: Column, glob: str) -> Column:
    if re.fullmatch(r"\*\.[\w.]+", glob):
        return F.endswith(name, F.lit(glob[1:]))
    if re.fullmatch(r"[\w.\-]+", glob):
        return name == glob
    return F.rlike(name, F.lit(_glob_regex(glob)))


def _glob_regex(glob: str) -> str:
    """Regex of a file-name glob: `*`, `?`, `[...]` and `{a,b}`."""
    out, alternatives = [], 0
    for piece in re.findall(r"\[[^\]]+\]|\\.|.", glob):
        if piece == "*":
            out.append(".*")
        elif piece == "?":
            out.append(".")
        elif piece[0] == "[" and len(piece) > 2:
            out.append(piece.replace("[!", "[^", 1))
        elif piece == "{":
            alternatives += 1
            out.append("(?:")
        elif piece == "}" and alternatives:
            alternatives -= 1
            out.append(")")
        elif piece == "," and alternatives:
            out.append("|")
        else:
            out.append(re.escape(piece[-1]))
    return "^(?s:" + "".join(out) + r")\z"
