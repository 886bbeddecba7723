import re
import time
from unittest import mock

from pyspark.sql import functions as F

from waymark.operators.code import PLAIN, blanked, code_units
from waymark.operators.extract import chunk_table, extract_units
from waymark.operators.filetypes import BRACE_TYPES, INDENT_TYPES, TABLE_RULES, assign_type
from waymark.operators.html import page_block_units, page_comment_units, page_units
from waymark.operators.markdown import markdown_units
from waymark.operators.modes import MODES, blank_nested
from waymark.operators.prose import prose_units
from waymark.operators.spans import BLOCK, blocks_of, cut_text
from waymark.operators.stats import check_chunks, corpus_stats

RUST = '''// file note


/// Doc of Point { "
#[derive(Debug)]
pub struct Point<T> { x: T, y: T }

struct Unit;
struct Pair(i32, [u8; 4]);

impl<T: Fn(i32) -> i32> Point<T> {
    // makes } one
    pub async fn new<'a>(x: &'a T) -> Self where T: Copy {
        let s = "} {"; let c = '{';
        Self { x, y }
    }

    /* block
       comment */

    fn arr(&self) -> [u8; 32] { if true { [0; 32] } else { [1; 32] } }
}

trait Shape { fn sig(&self); fn def(&self) { } }
fn last() -> impl Iterator<Item = u8> {
    r#"raw " } string"#;
}
'''

PYTHON = '''import os

# about f
# second
def f(
    a,
    b=")",
):
    """doc
def not_real():
    """
    def inner():
        return 1
    return inner

class A:
    # first
    @property
    def p(self):
        return 1

    @staticmethod
    # between
    def q():
        pass
    async def r(self): return 2

if __name__ == "__main__":
    f(1)
'''

JS = '''/** doc */
function a(x = {}) { return `}${x}`; }
class B { m() { return function inner() { return 1 } } }
const f = async function() { };
function* g() { }
const arrow = () => { return 1; };
foo(function cb() {
  x();
}, function cb2() { y(); });
'''

GO = '''package x

// Add adds
func Add(a, b interface{}) interface{} {
	return map[string]interface{}{"a": 1}
}

func (s *S) Get() (int, error) {
	f := func() { }
	return 1, nil
}
'''

JAVA = '''public class A {
    private int x = foo(1);
    /** ctor */
    public A(int x) { this.x = x; }
    // doc
    @Override
    public List<String> get(int a) throws X {
        if (a > 0) { return bar(a); } else if (a < 0) { return null; }
        for (int i = 0; i < 3; i++) { call(i); }
        return new Foo(a);
    }
    abstract void none();
}
'''

C = '''#include <x.h>
typedef struct { int x; } P;
int decl(int a);
/* mk */
static struct point *make(int a, char c) {
  if (a) { return 0; }
  while (c == '}') { c++; }
  return foo(a);
}
int
main(void)
{
  return 0;
}
'''

CPP = '''class A {
 public:
  A(int a) : x_(a) {}
  ~A() {}
  int get() const { return x_; }
  bool operator==(const A& o) { return true; }
 private:
  int x_;
};
std::vector<int> ns::make(int n) { return {}; }
int main() { std::sort(a, b, [](int x) { return x; }); return 0; }
'''

RUBY = '''# lead
class A
  # doc m
  def m(x)
    if x
      1
    end
  end

  def self.s; 1; end
  def e(x) = x + 1
  private def z
    2
  end
end
'''

BASH = '''#!/bin/bash

# hello
hello() {
  echo "${x}" # }
}
function bye {
  echo 1
}
'''


def spans(units):
    return sorted((r.start_line, r.end_line, r.kind) for r in units.collect())


def texts(units):
    return {(r.start_line, r.kind): r.content for r in units.collect()}


def units_of(make_corpus, name, text):
    return code_units(assign_type(make_corpus({name: text})))


def test_rust(spark, make_corpus):
    units = units_of(make_corpus, "a.rs", RUST)
    assert spans(units) == [
        (6, 6, "struct"), (8, 8, "struct"), (9, 9, "struct"), (11, 22, "impl"),
        (13, 16, "function"), (21, 21, "function"), (24, 24, "function"), (25, 27, "function"),
    ]
    got = texts(units)
    assert got[6, "struct"].startswith('/// Doc of Point { "\n#[derive(Debug)]\npub struct')
    assert got[8, "struct"] == "struct Unit;"
    assert got[13, "function"].startswith("// makes } one\n    pub async fn new")
    assert got[21, "function"].startswith("/* block\n       comment */\n\n    fn arr")
    assert "fn sig" not in got[24, "function"]


def test_python(spark, make_corpus):
    units = units_of(make_corpus, "a.py", PYTHON)
    assert [s[:2] for s in spans(units)] == [(5, 14), (12, 13), (19, 20), (24, 25), (26, 26)]
    got = texts(units)
    assert got[5, "function"].startswith("# about f\n# second\ndef f(")
    assert got[5, "function"].endswith("return inner")
    # A comment above a decorator belongs to the decorated definition.
    assert got[19, "function"].startswith("def p(self)")
    assert got[24, "function"].startswith("# between")


def test_javascript(spark, make_corpus):
    units = units_of(make_corpus, "a.js", JS)
    assert [s[:2] for s in spans(units)] == [(2, 2), (3, 3), (4, 4), (7, 9), (9, 9)]
    assert texts(units)[2, "function"].startswith("/** doc */\nfunction a")
    assert "arrow" not in "".join(texts(units).values())


def test_other_brace_languages(spark, make_corpus):
    files = {"a.go": GO, "a.java": JAVA, "a.c": C, "a.cpp": CPP, "a.sh": BASH}
    units = code_units(assign_type(make_corpus(files))).collect()
    got = {}
    for r in sorted(units, key=lambda r: r.start_line):
        got.setdefault(r.path, []).append((r.start_line, r.end_line))
    assert got == {
        "a.go": [(4, 6), (8, 11)],
        "a.java": [(6, 11), (12, 12)],
        "a.c": [(5, 9), (10, 14)],
        "a.cpp": [(3, 3), (4, 4), (5, 5), (6, 6), (10, 10), (11, 11)],
        "a.sh": [(4, 6), (7, 9)],
    }
    # Java: the method with its annotation, the abstract method, no constructor.
    java = [r.content for r in units if r.path == "a.java"]
    assert len(java) == 2 and not any("public A(" in c for c in java)
    assert any(c.startswith("// doc\n    @Override") and c.endswith("return new Foo(a);\n    }") for c in java)
    c_make = next(r for r in units if r.path == "a.c" and r.start_line == 5)
    assert c_make.content.startswith("/* mk */")


def test_ruby(spark, make_corpus):
    units = units_of(make_corpus, "a.rb", RUBY)
    assert [s[:2] for s in spans(units)] == [(4, 8), (10, 10), (11, 11), (12, 14)]
    assert texts(units)[4, "function"].startswith("# doc m")


def test_long_comment_block_and_gap(spark, make_corpus):
    block = "".join(f"// line {i}\n" for i in range(25))
    text = f"fn before() {{}}\n// far\n\n\n\n{block}fn target() {{\n}}\n"
    got = texts(units_of(make_corpus, "a.rs", text))
    target = got[text[: text.index("fn target")].count("\n") + 1, "function"]
    assert target.startswith("// line 0\n") and "far" not in target and "before" not in target


def test_comment_walk_skips_items_only_before_the_nearest(spark, make_corpus):
    text = "// one\nstatic A: i32 = 1;\n// two\n#[inline]\nfn f() {}\n"
    got = texts(units_of(make_corpus, "a.rs", text))
    assert got[5, "function"] == "// two\n#[inline]\nfn f() {}"


def test_broken_empty_and_unknown(spark, make_corpus):
    files = {"a.rs": "fn broken( {\n  let x = ;\n", "b.rs": "", "c.zig": "fn x() {}", "d.rs": "fn open() {\n 1;\n"}
    units = code_units(assign_type(make_corpus(files))).collect()
    assert [(r.path, r.start_line, r.end_line) for r in units] == [("d.rs", 1, 2)]


def test_identity_follows_content(spark, make_corpus):
    first = chunk_table(assign_type(make_corpus({"a.rs": "fn a() { 1 }\n"})), ("rust",)).first()
    again = chunk_table(assign_type(make_corpus({"a.rs": "fn a() { 2 }\n"})), ("rust",)).first()
    assert (first.start_line, first.end_line) == (again.start_line, again.end_line)
    assert first.id != again.id and first.chunk_hash != again.chunk_hash
    copies = chunk_table(
        assign_type(make_corpus({"a.rs": "fn a() {}\n", "b.rs": "fn a() {}\n"})), ("rust",)
    ).collect()
    assert copies[0].file_hash == copies[1].file_hash and copies[0].id != copies[1].id


MARKDOWN = """Text before any heading

# Introduction

This is the introduction.

## Features

Here are the features:

- Feature 1
- Feature 2

  ```py
  # not a heading
  ```

After the list.

Setext title
============
below it
second line

```rust
fn a() {}

# no
```
---
| a | b |
|---|---|
| 1 | 2 |

1. one
2. two
lazy

<div>
markup
</div>

> quoted
> more

last
"""


def test_markdown(spark, make_corpus):
    got = texts(markdown_units(make_corpus({"a.md": MARKDOWN})))
    assert got == {
        (1, "paragraph"): "Text before any heading",
        (5, "paragraph"): "# Introduction\nThis is the introduction.",
        (9, "paragraph"): "## Features\nHere are the features:",
        (11, "list"): "## Features\n- Feature 1\n- Feature 2\n\n  ```py\n  # not a heading\n  ```",
        (14, "code"): "```py\n  # not a heading\n  ```",
        (18, "paragraph"): "## Features\nAfter the list.",
        (22, "paragraph"): "Setext title\n============\nbelow it\nsecond line",
        (25, "code"): "```rust\nfn a() {}\n\n# no\n```",
        (35, "list"): "Setext title\n============\n1. one\n2. two\nlazy",
        (43, "paragraph"): "Setext title\n============\n> quoted\n> more",
        (46, "paragraph"): "Setext title\n============\nlast",
    }


HTML = """<html><head><title>t</title><script>var x = "</p><ul>";</script></head><body>
<!-- one -->
<!-- two -->
<h1>Top</h1>
<p>first<br>
<p>second <b>bold</b></p></ul>
stray
<ul><li>a<ul><li>b</li></ul></li><li><pre>code</pre></li></ul>



<h2>Next</h2><ol><li>x</li></ol><pre>y
z</pre></body></html>"""


def test_page_blocks(spark, make_corpus):
    corpus = make_corpus({"a.html": HTML})
    blocks = [(r.start_line, r.end_line, r.kind, r.content) for r in page_block_units(corpus).collect()]
    assert sorted(blocks) == [
        (4, 4, "heading", "<h1>Top</h1>"),
        (5, 5, "paragraph", "<p>first<br>"),
        (6, 6, "paragraph", "<p>second <b>bold</b></p>"),
        (8, 8, "code", "<pre>code</pre>"),
        (8, 8, "list", "<ul><li>a<ul><li>b</li></ul></li><li><pre>code</pre></li></ul>"),
        (12, 12, "heading", "<h2>Next</h2>"),
        (12, 12, "list", "<ol><li>x</li></ol>"),
        (12, 13, "code", "<pre>y\nz</pre>"),
    ]
    got = {r.content for r in page_units(corpus).collect()}
    assert "<h1>Top</h1>\n<p>second <b>bold</b></p>" in got
    assert "<h2>Next</h2>\n<ol><li>x</li></ol>" in got and "<pre>y\nz</pre>" in got


def test_page_comments(spark, make_corpus):
    got = {(r.start_line, r.kind): r.content for r in page_comment_units(make_corpus({"a": HTML})).collect()}
    assert got[4, "heading"] == "<!-- one -->\n<!-- two -->\n<h1>Top</h1>"
    assert got[5, "paragraph"].startswith("<!-- one -->") and got[12, "heading"] == "<h2>Next</h2>"


def test_prose(spark, make_corpus):
    got = texts(prose_units(make_corpus({"a": "\n one\ntwo \n\n\n  \nthree", "b": " \n\n"})))
    assert got == {(2, "paragraph"): "one\ntwo", (7, "paragraph"): "three"}


def test_extract_all_types_and_checks(spark, make_corpus):
    files = {"a.rs": RUST, "b.py": PYTHON, "c.md": MARKDOWN, "d.html": HTML, "e.prose": "x\n\ny"}
    corpus = assign_type(make_corpus(files), TABLE_RULES)
    units = extract_units(corpus)
    assert {r.path for r in units.select("path").distinct().collect()} == set(files)
    chunks = chunk_table(corpus).cache()
    checks = check_chunks(chunks).first().asDict()
    assert checks.pop("n_chunks") == units.count() and not any(checks.values())
    stats = {r.extension: (r.n_files, r.n_chunks) for r in corpus_stats(chunks, corpus).collect()}
    assert stats["rs"] == (1, 8) and stats["prose"] == (1, 2)


def test_one_shuffle_per_extraction(spark, make_corpus):
    for extractor in (prose_units, markdown_units, page_units):
        plan = extractor(make_corpus({"a": "x"}))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def test_code_is_shuffled_once_and_cut_once(spark, make_corpus):
    from waymark.operators.code import brace_units, indent_units

    corpus = make_corpus({"a.rs": "fn a() {}", "b.py": "def b():\n    pass\n"})
    for extractor, kind in ((brace_units, "rust"), (indent_units, "python")):
        plan = extractor(corpus.withColumn("type", F.lit(kind)))._jdf.queryExecution().executedPlan().toString()
        # Python after the shuffle would make Spark shuffle the pieces; an inner explode would cut texts twice.
        assert plan.count("Exchange hashpartitioning") == 1, plan
        assert "Filter (size(transform(" not in plan, plan


def test_blanks_at_the_ends(spark, make_corpus):
    from waymark.operators.spans import BLANKS, TAIL, blanks_behind, blocks_of, cut_text

    long = "x" + BLANKS * TAIL
    texts = ["", "a", " a", "a ", "\t\r\n é \n", "a" * 3000, "\n" * 3000, long, long + "y", "ü" * 100 + "\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    cut = cut_text(blocks_of(F.col("t")), F.lit(1), F.length("t")).alias("cut")
    for r in df.select("t", blanks_behind(F.col("t")).alias("behind"), cut).collect():
        assert r.t == r.t.rstrip(BLANKS) + r.behind
        assert r.cut == r.t.strip(BLANKS)


def test_cutting_grows_with_the_file(spark, make_corpus):
    import time

    def seconds(paragraphs):
        corpus = make_corpus({"a": "\n\n".join(f"paragraph number {i:08d} of a long file." for i in range(paragraphs))})
        begin = time.perf_counter()
        assert prose_units(corpus).count() == paragraphs
        prose_units(corpus).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds(100)
    small, large = seconds(2_500), seconds(20_000)
    # Eight times the file: far from 64 times the work. The machine may be busy.
    assert large < 20 * small + 5 and large < 40


def test_units_are_cut_without_python(spark, make_corpus):
    for extractor in (prose_units, markdown_units, page_units):
        plan = extractor(make_corpus({"a": "x"}))._jdf.queryExecution().executedPlan().toString()
        # Files went to Python workers whole, a batch of thousands at a time.
        assert "EvalPython" not in plan
        # As an aggregate, `first` copies the file again for every row of its group.
        assert "first(file" not in plan


def test_cuts_are_slices_by_character(spark):
    text = ("ab \U0001f600é\n" * BLOCK)[: 3 * BLOCK + 5]
    places = [1, 2, BLOCK - 1, BLOCK, BLOCK + 1, 2 * BLOCK, 2 * BLOCK + 3, 3 * BLOCK, 3 * BLOCK + 5, 4 * BLOCK]
    asked = [(a, b) for a in places for b in [0, *places]] + [(None, 3), (3, None)]
    df = spark.createDataFrame([(text, asked)], "text string, asked array<struct<a: int, b: int>>")
    df = df.select(blocks_of(F.col("text")).alias("blocks"), "asked")
    got = df.select(F.transform("asked", lambda s: cut_text(F.col("blocks"), s["a"], s["b"])).alias("cut")).first().cut
    assert got == [None if a is None or b is None else text[a - 1 : b].strip(" \t\r\n") for a, b in asked]


def test_plain_text_is_one_piece(spark):
    samples = {
        "rust": 'let br = b"x"; r#"a"# rb \'c\' a / b // r"', "cpp": 'R"(x)" R R"', "ruby": "a = 1\n=begin\nx\n=end\n==begin",
        "bash": "$# # x\n'q' /", "js": "a / b /* c */ 'd'",
    }
    df = spark.createDataFrame(list(samples.items()), "type string, content string")
    types = tuple(samples)
    both = []
    for plain in (PLAIN, {name: "(?!)" for name in PLAIN}):  # without it every character is a piece
        with mock.patch.dict(PLAIN, plain):
            both.append(sorted(df.select("type", blanked(F.col("content"), F.col("type"), types)).collect()))
    assert both[0] == both[1]
    assert re.fullmatch(PLAIN["rust"], "a rather bare number / b")


def test_the_size_bound_is_a_parameter(spark, make_corpus):
    from waymark.operators.extract import extract_units, left_out

    corpus = make_corpus({"a.md": "# head\n\n" + "word " * 400, "b.md": "# short\n\ntext\n", "c.md": ""})
    corpus = corpus.withColumn("type", F.lit("markdown"))
    paths = lambda df: {r.path for r in df.collect()}
    assert paths(extract_units(corpus, ("markdown",), 1000)) == {"b.md"}
    assert paths(extract_units(corpus, ("markdown",), 10_000)) == {"a.md", "b.md"}
    assert {(r.path, r.reason) for r in left_out(corpus, ("markdown",), 1000).collect()} == {("a.md", "too_large"), ("c.md", "empty")}


def test_literals_that_nest():
    def kept(text, kind):
        made = blank_nested(text, kind)
        assert len(made) == len(text) and made.count("\n") == text.count("\n")
        return "".join(c for c in made if c >= " " or c == "\n")

    assert kept('a = `x ${ f(`{ ${"}"}`) } }`; b', "js") == "a = _ f(__) ; b"
    assert kept("a / b / c; x = /[/'\"]/g; y", "js") == "a / b / c; x = _; y"
    assert kept("<b>{x}</b> + <i/>", "js") == "<b>{x}</b> + <i/>"
    assert kept('f"{d["a"]:>{w}} }}" + 1', "python") == "f_ + 1"
    assert kept('f"{x!r:\'>4}"; f"open\nz', "python") == "f_; f_\nz"
    assert kept('<<~A + <<B + 1\n a "\n A\nb\nB\nc', "ruby") == "<<~A + <<B + 1\n\n\n\n\nc"
    assert kept("a <<B\nno end", "ruby") == "a <<B\nno end"
    assert kept('cat <<-"E F" | x\n} "\n\tE F\n{', "bash") == 'cat <<-"E F" | x\n\n\n{'
    assert kept('${#a} "${b:-"}"} $(c ")")" \\" $((1<<D)) <<< e', "bash") == '_ _ \\" $((1<<D)) <<< e'
    assert kept("/* /* */ { */ x", "rust") == " x"
    assert kept('r##"a"# }"## y', "rust") == "_ y"
    assert kept('R"q( )" )q" z', "cpp") == "_ z"
    # What no event can begin in is passed over, up to the very place.
    assert kept("a =   /[`]/ ; b  / c", "js") == "a =   _ ; b  / c"
    assert kept('barf"{x}" rf"{x}"', "python") == "barf_ rf_"
    assert kept("a = b < c if /[\"]/ =~ d", "ruby") == "a = b < c if _ =~ d"
    for kind in MODES:
        assert kept("", kind) == ""


def test_modes_agree_with_flat_patterns(spark):
    """Files without nesting literals are blanked alike by both."""
    files = [("js", "a = '}'; // {\nb = \"\\\"\" /* } */"), ("cpp", CPP), ("rust", RUST), ("python", PYTHON), ("ruby", RUBY), ("bash", BASH)]
    for types in (BRACE_TYPES, INDENT_TYPES):
        rows = spark.createDataFrame([f for f in files if f[0] in types], "kind string, content string")
        flat = blanked(F.col("content"), F.col("kind"), types).alias("flat")
        for r in rows.select("kind", "content", flat).collect():
            assert r.flat == blank_nested(r.content, r.kind), r.kind


def test_modes_are_linear():
    begin = time.time()
    many = 50_000
    hard = [("`${", "js"), ("x = / 1 ", "js"), ("a <<B\n", "ruby"), ('f"{', "python"), ("/*", "rust"), ('"$(', "bash")]
    for text, kind in hard:
        assert len(blank_nested(text * many, kind)) == len(text) * many
    assert time.time() - begin < 20


def test_whole_files_go_to_python_in_small_batches(spark, make_corpus):
    code_units(make_corpus({"a.py": "def f():\n    return f'{1}'\n"}).withColumn("type", F.lit("python")))

    @F.pandas_udf("long")
    def held(texts):
        return texts.map(len) * 0 + texts.map(len).sum()

    files = spark.range(0, 24, 1, 1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 1 << 20)).alias("text"))
    assert max(r.n for r in files.select(held("text").alias("n")).collect()) <= 9 << 20
