import os
import tempfile

import pytest
from pyspark.sql import functions as F

from waymark.functions import text as tx
from waymark.functions.hashing import namespace_key, unit_id
from waymark.operators.filetypes import DEFAULT_RULES, TypeRule, assign_type, type_of
from waymark.operators.filters import attribute_filter, size_filter, split_blank_queries, where_in
from waymark.operators.identity import fingerprints
from waymark.operators.roots import assign_root, marker_dirs
from waymark.sources.corpus import (
    corpus_from_table,
    decode_utf8,
    latest_per_path,
    scan_file_hashes,
    scan_files,
    scan_tree,
    _local_entries,
)


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("main.rs", "rust"), ("a.py", "python"), ("a.pyi", "python"), ("a.js", "js"),
        ("a.jsx", "js"), ("a.mjs", "js"), ("a.ts", "ts"), ("a.tsx", "ts"), ("a.go", "go"),
        ("A.java", "java"), ("a.c", "c"), ("a.h", "cpp"), ("a.cpp", "cpp"), ("a.cc", "cpp"),
        ("a.cxx", "cpp"), ("a.hpp", "cpp"), ("a.rb", "ruby"), ("a.sh", "bash"),
        ("README.md", "markdown"), ("x.unknown", None), ("x.txt", None), ("noext", None),
        ("/deep.rs/file", None), ("/deep/dir.x/file.rs", "rust"),
    ],
)
def test_type_of_name(spark, name, expected):
    assert one(spark, type_of(F.lit(name))) == expected


def test_last_supported_rule_wins(spark):
    rules = (
        TypeRule("*.x", "rust"),
        TypeRule("test_*.x", "python"),
        TypeRule("test_?.{x,y}", "cobol"),
        TypeRule("[!a]*.y", "go"),
    )
    got = [one(spark, type_of(F.lit(n), rules)) for n in ("a.x", "test_1.x", "b.y", "a.y")]
    assert got == ["rust", "python", "go", None]
    assert DEFAULT_RULES[0].type == "rust"


def test_size_filter_bounds(spark, make_corpus):
    df = make_corpus({"a": "", "b": "x", "c": "y" * 1_000_000, "d": "z" * 1_000_001})
    assert {r.path for r in size_filter(df).collect()} == {"b", "c"}


def test_invalid_utf8_is_dropped(spark):
    df = spark.createDataFrame([("a", b"ok \xc3\xa9"), ("b", b"\xff\xfe")], "path string, content binary")
    assert [(r.path, r.content) for r in decode_utf8(df).collect()] == [("a", "ok é")]


def test_scan_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.rs").write_text("fn a() {}\n")
    (tmp_path / "sub" / "b.py").write_text("def b(): pass\n")
    (tmp_path / "c.txt").write_text("no type")
    (tmp_path / "bad.go").write_bytes(b"\xff\xff")
    (tmp_path / "empty.go").write_text("")
    (tmp_path / "big.go").write_text("x" * 1_000_001)
    rows = {r.path: r for r in scan_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {f"{tmp_path}/a.rs", f"{tmp_path}/sub/b.py"}
    assert rows[f"{tmp_path}/a.rs"].type == "rust" and rows[f"{tmp_path}/a.rs"].size == 10
    prints = fingerprints(scan_file_hashes(spark, str(tmp_path))).collect()
    assert {r.path.rsplit("/", 1)[1] for r in prints} == {"a.rs", "b.py", "bad.go", "big.go", "empty.go"}


def test_scan_finds_hidden_names(spark, tmp_path):
    for name in ("pkg/a.py", "pkg/__init__.py", "pkg/_internal/b.py", ".github/c.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    got = {r.path: r.content for r in scan_files(spark, str(tmp_path)).collect()}
    names = ("pkg/a.py", "pkg/__init__.py", "pkg/_internal/b.py", ".github/c.py")
    assert got == {f"{tmp_path}/{n}": f"# {n}\n" for n in names}
    assert scan_files(spark, f"file://{tmp_path}", hidden=False).count() == 1
    assert {r.path for r in scan_files(spark, f"file://{tmp_path}").collect()} == set(got)


def test_scan_of_a_store_pushes_size_and_prunes_content(spark, tmp_path):
    (tmp_path / "a.rs").write_text("fn a() {}\n")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.scans.link./top", f"file://{tmp_path}")
    df = scan_files(spark, "viewfs://scans/top", hidden=False).select("path")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(length,0)" in plan and "LessThanOrEqual(length,1000000)" in plan
    assert [r.path for r in df.collect()] == ["/top/a.rs"]


def test_scan_follows_no_link_and_tells(spark, tmp_path, monkeypatch):
    for name in ("pkg/a.py", "pkg/.hid/b.py", "other/c.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    (tmp_path / "pkg/.hid/loop").symlink_to("..")
    (tmp_path / "pkg/linked.py").symlink_to("a.py")
    (tmp_path / "pkg/dangling.py").symlink_to("nowhere.py")
    (tmp_path / "outside").symlink_to(tmp_path / "other")
    os.mkfifo(tmp_path / "pkg/pipe.py")
    root = str(tmp_path)
    monkeypatch.setattr("waymark.sources.corpus.WALK", 1)
    found = scan_tree(spark, root)
    assert {r.path: r.content for r in found.files.collect()} == {f"{root}/{n}": f"# {n}\n" for n in ("pkg/a.py", "pkg/.hid/b.py", "other/c.py")}
    links = ("pkg/.hid/loop", "pkg/linked.py", "pkg/dangling.py", "outside")
    want = {(f"{root}/{n}", "link") for n in links} | {(f"{root}/pkg/pipe.py", "special")}
    assert {tuple(r) for r in found.skipped.collect()} == want
    # A folder that ends in a link, a single file, a relative root, a root that is not there.
    assert {tuple(r) for r in scan_tree(spark, f"{root}/outside").skipped.collect()} == {(f"{root}/outside", "link")}
    assert scan_files(spark, [f"{root}/pkg/a.py", f"{root}/pkg"]).select("path").distinct().count() == 2
    with pytest.raises(FileNotFoundError):
        scan_files(spark, f"{root}/nowhere")


def test_relative_roots(spark, tmp_path):
    folder = tempfile.mkdtemp(dir=".")
    try:
        with open(f"{folder}/a.py", "w") as file:
            file.write("# a\n")
        assert [r.path for r in scan_files(spark, folder).collect()] == [os.path.abspath(f"{folder}/a.py")]
    finally:
        os.remove(f"{folder}/a.py")
        os.rmdir(folder)


def test_unreadable_entries_are_told(tmp_path, monkeypatch):
    (tmp_path / "a.py").write_text("a")
    (tmp_path / "sub").mkdir()
    monkeypatch.setattr(os, "access", lambda *_: False)
    assert [(r[3], r[5]) for r in _local_entries(str(tmp_path), False)] == [("skipped", "unreadable"), ("folder", None)]

    def refuse(_):
        raise PermissionError

    monkeypatch.setattr(os, "listdir", refuse)
    assert [(r[0], r[5]) for r in _local_entries(str(tmp_path), False)] == [(str(tmp_path), "unreadable")]
    assert [r[5] for r in _local_entries(str(tmp_path / "gone"), False)] == ["missing"]


def test_latest_per_path(spark):
    df = spark.sql(
        """SELECT * FROM VALUES ('a', 'old', timestamp'2024-01-01'), ('a', 'new', timestamp'2024-01-02'),
           ('b', 'x', null), ('b', 'y', timestamp'2024-01-01') AS t(path, content, mtime)"""
    )
    rows = latest_per_path(corpus_from_table(df, "path", mtime="mtime")).collect()
    assert {r.path: r.content for r in rows} == {"a": "new", "b": "y"}


@pytest.mark.parametrize(
    "content, expected",
    [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("a\r\nb\r\n", ["a", "b"]), ("\n", [""])],
)
def test_source_lines(spark, content, expected):
    assert one(spark, tx.source_lines(F.lit(content))) == expected


def test_text_helpers(spark):
    assert one(spark, tx.extension(F.lit("/a/b.tar.gz"))) == "gz"
    assert one(spark, tx.extension(F.lit("/a.d/b"))) == "no extension"
    assert one(spark, tx.relative_path(F.lit("/project/src/a"), F.lit("/project"))) == "src/a"
    assert one(spark, tx.relative_path(F.lit("/projects/a"), F.lit("/project"))) == "/projects/a"
    assert one(spark, tx.preview(F.lit("\nsecond"))) == ""
    assert one(spark, tx.preview(F.lit(""))) == "[no content]"
    assert one(spark, tx.preview(F.lit(None).cast("string"))) == "[no content]"
    assert one(spark, tx.line_range(F.lit("a\nb\nc"), F.lit(2), F.lit(9))) == "b\nc"
    assert one(spark, tx.line_range(F.lit("a"), F.lit(2), F.lit(3))) is None


def test_unit_id_changes_with_every_part(spark):
    make = lambda *v: one(spark, unit_id(*[F.lit(x) for x in v]))
    base = ("p", 1, 10, "fh", "ch")
    assert make(*base) == make(*base)
    for other in [("q", 1, 10, "fh", "ch"), ("p", 2, 10, "fh", "ch"), ("p", 1, 11, "fh", "ch"),
                  ("p", 1, 10, "xx", "ch"), ("p", 1, 10, "fh", "xx")]:
        assert make(*other) != make(*base)
    assert one(spark, namespace_key(F.lit("/r"), "p")).startswith("ix_p_")


def test_attribute_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, path string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(df.where(attribute_filter(("path", "Eq", "a"), ("id", "Gt", 2)))) == [1, 3]
    assert ids(where_in(df, spark.createDataFrame([("b",), ("b",)], "path string"), "path")) == [2]
    with pytest.raises(ValueError):
        attribute_filter(("id", "Lt", 1))


def test_blank_queries_are_rejected_untrimmed_kept(spark):
    df = spark.createDataFrame([(1, " find me "), (2, " \t\n"), (3, ""), (4, None)], "query_id int, query string")
    usable, blank = split_blank_queries(df)
    assert [r.query for r in usable.collect()] == [" find me "]
    assert {(r.query_id, r.status) for r in blank.collect()} == {(i, "empty_query") for i in (2, 3, 4)}


def test_nearest_root(spark):
    files = ["/w/a/.git/HEAD", "/w/a/x/y/f.rs", "/w/a/x/package.json", "/w/b/f.py", "/w/a/x/z.rs"]
    df = spark.createDataFrame([(f,) for f in files], "path string")
    rows = {r.path: r.root for r in assign_root(df, marker_dirs(df)).collect()}
    assert rows == {
        "/w/a/.git/HEAD": "/w/a",
        "/w/a/x/y/f.rs": "/w/a/x",
        "/w/a/x/package.json": "/w/a/x",
        "/w/b/f.py": "/w/b",
        "/w/a/x/z.rs": "/w/a/x",
    }
    assert assign_type(df.withColumn("content", F.lit(""))).count() == 3


def test_a_large_folder_is_listed_in_pieces(spark, tmp_path, monkeypatch):
    from waymark.sources import corpus

    for n in range(25):
        (tmp_path / f"f{n}.py").write_text("x")
        (tmp_path / f"d{n}").mkdir()
        (tmp_path / f"d{n}" / "g.py").write_text("y")
    monkeypatch.setattr(corpus, "WALK", 10)
    pieces = list(corpus._walk(str(tmp_path), False))
    assert max(map(len, pieces)) <= 10
    rows = [row for piece in pieces for row in piece]
    assert sum(row[3] == "file" for row in rows) >= 25 and len({row[0] for row in rows}) == len(rows)
    found = corpus.list_tree(spark, [str(tmp_path)], []).where("kind = 'file'")
    assert found.count() == found.select("uri").distinct().count() == 50
