"""Nearest project root of every path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import parent_dir
from waymark.operators.skew import lookup_join

# Names whose presence makes a directory a project root.
MARKERS = [
    ".git", ".hg", ".svn", "_darcs", ".bzr",
    "Cargo.toml", "package.json", "tsconfig.json", "deno.json", "deno.jsonc",
    "pyproject.toml", "setup.py", "requirements.txt", "Pipfile", "poetry.lock",
    "environment.yml", "go.mod", "Gemfile", "composer.json",
    "mkdocs.yml", "_config.yml", "gatsby-config.js", "next.config.js", "nuxt.config.js",
    "docusaurus.config.js", "hugo.toml", "hugo.yaml",
    "stack.yaml", "cabal.project", "Gemfile.lock", "yarn.lock", "pnpm-lock.yaml", "bun.lockb",
    "pubspec.yaml", "mix.exs", "rebar.config", "deps.edn", "project.clj", "build.sbt",
    "Package.swift", "Podfile", "Cartfile",
    "pom.xml", "build.gradle", "build.gradle.kts", "build.xml", "CMakeLists.txt", "Makefile",
    "meson.build", "configure.ac", "configure.in", "Dockerfile", "docker-compose.yml",
    "Vagrantfile", ".editorconfig", ".vscode", ".idea",
]


def marker_dirs(paths: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """Distinct `dir` holding a marker, itself a file or a directory with files below."""
    names = markers or MARKERS
    steps = F.split("path", "/")
    found = F.transform(
        F.filter(
            F.sequence(F.lit(1), F.size(steps)), lambda i: F.element_at(steps, i).isin(names)
        ),
        lambda i: F.array_join(F.slice(steps, 1, i - 1), "/"),
    )
    return paths.select(F.explode(found).alias("dir")).distinct()


def assign_root(paths: DataFrame, marked: DataFrame, path: str = "path") -> DataFrame:
    """Add `root`: the nearest ancestor directory of `path` in `marked`, else its own directory.

    Roots are found once per directory. An ancestor can be shared by most directories, and
    a directory can hold much of the corpus, so both joins spread the rows of a key.
    """
    placed = paths.withColumn("dir", parent_dir(F.col(path)))
    climbs = (
        placed.select("dir").distinct().select("dir", F.explode(_ancestors(F.col("dir"))).alias("up"))
    )
    marked = marked.select(F.col("dir").alias("up")).distinct()
    roots = (
        lookup_join(climbs, marked, "up", spread_by="dir")
        .groupBy("dir")
        .agg(F.max_by("up", F.length("up")).alias("root"))
    )
    return (
        lookup_join(placed, roots, "dir", spread_by=path, how="left")
        .withColumn("root", F.coalesce("root", "dir"))
        .select(*paths.columns, "root")
    )


def _ancestors(directory: Column) -> Column:
    """The directory and all directories above it."""
    steps = F.split(directory, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda i: F.array_join(F.slice(steps, 1, i), "/"),
    )
