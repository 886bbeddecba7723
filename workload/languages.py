"""Source snippets of every code type, and the units in them.

`§` stands for a line of a document, `¤` for its number. A unit is its kind, its first and last line and
the first line of the comment that leads it (its own first line without one), counted from 1.
"""

from __future__ import annotations

LANGUAGES: dict[str, tuple[str, list[tuple[str, int, int, int]]]] = {
    "rs": (
        """/// note §
trait A¤ {
    fn m(&self) -> usize;
    fn n(&self) -> usize { 1 }
}

/* § { */
struct S¤ {
    a: usize,
}

""",
        [("function", 4, 4, 4), ("struct", 8, 10, 7)],
    ),
    "py": (
        '''class C¤:
    # inner §
    def f¤(self, a="§:"):
        def g¤(): return 1
        return a

    @property
    def h¤(self):
        """def fake(): §"""
        return 2

''',
        [("function", 3, 5, 2), ("function", 4, 4, 4), ("function", 8, 10, 8)],
    ),
    "js": (
        """// note §
function f¤(a) {
  const s = "§ } {";
  function g¤() { return "}"; }
  return s;
}

""",
        [("function", 2, 6, 1), ("function", 4, 4, 4)],
    ),
    "ts": (
        """/** note § */
export function f¤(a: number): string {
  const s = "§ } {";
  function g¤() { return "}"; }
  return s;
}

interface I¤ {
  m(x: number): void;
}

""",
        [("function", 2, 6, 1), ("function", 4, 4, 4)],
    ),
    "go": (
        """// note §
// and more
func f¤(a string) int {
	s := "§ } {"
	return len(s)
}

type T¤ struct {
	a int
}

""",
        [("function", 3, 6, 1)],
    ),
    "java": (
        """/** note § */
class C¤ {
  // inner §
  int f¤(int a) {
    String s = "§ } {";
    return 1;
  }
  int g¤() { return '}'; }
  abstract int h¤(int a);
}

""",
        [("function", 4, 7, 3), ("function", 8, 8, 8), ("function", 9, 9, 9)],
    ),
    "c": (
        """/* note § */
int f¤(const char *a) {
  const char *s = "§ } {";
  if (a) { return '{'; }
  return 1;
}

int p¤(int a);

struct S¤ {
  int a;
};

""",
        [("function", 2, 6, 1)],
    ),
    "hpp": (
        """// note §
class C¤ {
 public:
  int f¤() const { return '{'; }
  int g¤(int a);
};

// § {
int C¤::g¤(int a) {
  const char *s = "§ } {";
  return a;
}

""",
        [("function", 4, 4, 4), ("function", 9, 12, 8)],
    ),
    "rb": (
        """# note §
class C¤
  # inner §
  def f¤(a)
    s = "§ end"
    a
  end

  def g¤; 1; end
end

""",
        [("function", 4, 7, 3), ("function", 9, 9, 9)],
    ),
    "sh": (
        """# note §
f¤() {
  local s="§ } {"
  echo "$s"
}

function g¤ { echo '}'; }

""",
        [("function", 2, 5, 1), ("function", 7, 7, 7)],
    ),
}
# The same with literals that nest: templates, here-documents, interpolations, regular expressions.
NESTED: dict[str, tuple[str, list[tuple[str, int, int, int]]]] = {
    "js": (
        """// note §
function f¤(a) {
  const s = `§ ${a.map(
    function (x) { return `} ${x + "{"} §`; }
  )} {`;
  const r = /["'`{]§/g;
  return s / r.length;
}

""",
        [("function", 2, 8, 1), ("function", 4, 4, 4)],
    ),
    "ts": (
        """/** note § */
function f¤(a: string): string {
  return `} ${a ? `{ ${a} §` : /[/"}]/.source} {`;
}

""",
        [("function", 2, 4, 1)],
    ),
    "py": (
        '''# note §
def f¤(a):
    s = f"{a["def x(): §"]:>{len("#")}} {{ #"
    t = f"""{
def fake(): §
}"""
    return s

''',
        [("function", 2, 7, 1)],
    ),
    "rb": (
        """# note §
def f¤(a)
  s = <<~SQL + "#{a["end"]} end"
    def fake §
    "
  SQL
  t = s =~ /["#]§/
  u = %w[a " §]
  t
end

def g¤; 1; end

""",
        [("function", 2, 10, 1), ("function", 12, 12, 12)],
    ),
    "sh": (
        """# note §
f¤() {
  cat <<EOF | tr '}' "$(echo "{ §")"
} § "
EOF
  x=${#y}
  echo "${a:-"}"} §" $((1<<2)) <<< "}"
}

function g¤ { echo \\"; }

""",
        [("function", 2, 8, 1), ("function", 10, 10, 10)],
    ),
    "rs": (
        """/* note /* § } */ { */
fn f¤() {
    let s = r####"§ "### } "####;
}

""",
        [("function", 2, 4, 1)],
    ),
    "cpp": (
        """// note §
int f¤() {
  auto s = R"x(§ )" } )x";
  return '{';
}

""",
        [("function", 2, 5, 1)],
    ),
}
# Characters that would end a comment or string, left out of the lines.
UNSAFE = "\"'\\*/$`#{}()<>\r"
# A document long enough to pass the fixed size rule, made of one in so many documents.
LONG_BYTES, LONG_EVERY = 2_000_000, 250
