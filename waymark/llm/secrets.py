"""Secret scans: spans of credentials, and weak parts that only count together.

All of it is DataFrame expressions. A pattern splits the text; the lengths of what it splits
off and of what it matches, summed in order, are the places of its matches. Parts become rows
and meet in an interval join: identifiers, secrets and endpoints whose starts lie within
`SCOPE` characters of each other. Weak parts are reported only where the join finds their
complement: an identifier needs a secret, a secret an identifier, an endpoint both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.shared import table, written

SCOPE = 200
IDENTIFIER, SECRET, ENDPOINT = 0, 1, 2
MASK = "[secret]"
_SIGN = r"""["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Kind:
    """A pattern; `value` is the group whose length decides, `least` the length it needs."""

    name: str
    pattern: str
    value: int
    least: int
    part: int
    weak: bool = False


# In the order in which spans of one start are listed.
KINDS = (
    Kind("assign", rf"((?i:password|passwd|secret|token|api_?key)){_SIGN}([A-Za-z0-9+/_.=-]+)", 2, 12, SECRET),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18, IDENTIFIER),
    # Runs of hex digits are disjoint, so the shorter ones need not be matched at all.
    Kind("hex", r"[0-9a-f]{16,}", 0, 16, SECRET),
    Kind("ident", rf"(?i:access_?key_?id|client_?id|user_?name|login|account){_SIGN}([A-Za-z0-9_.@-]{{4,}})", 1, 4, IDENTIFIER, True),
    Kind("endpoint", r"(?i:https?|ftp|postgres|mysql|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}", 0, 4, ENDPOINT, True),
)
# An assignment whose value is too short to stand alone, but at least this long.
SHORT, SHORT_LEAST, SHORT_ORDER = "short", 4, len(KINDS)
BASE = 3


def _lengths(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.char_length(x))


def _parts(text: Column) -> Column:
    """Per kind with matches: its order, and for each match the gap before it, its size, its value's size."""
    none = F.array().cast("array<int>")
    found = []
    for order, kind in enumerate(KINDS):
        pattern = F.lit(kind.pattern)
        sizes = _lengths(F.regexp_extract_all(text, pattern, F.lit(0)))
        values = _lengths(F.regexp_extract_all(text, pattern, F.lit(kind.value)))
        hit = text.rlike(kind.pattern)
        found.append(
            F.struct(
                F.lit(order).alias("kind"),
                F.when(hit, _lengths(F.split(text, kind.pattern, -1))).otherwise(none).alias("gaps"),
                F.when(hit, sizes).otherwise(none).alias("sizes"),
                F.when(hit, values).otherwise(none).alias("vals"),
            )
        )
    return F.filter(F.array(*found), lambda k: F.size(k["sizes"]) > 0)


def _marked(docs: DataFrame, *keep: Column) -> DataFrame:
    """`row_id`, `keep` and the parts of each row; written, so that a row id stays what it is."""
    text = F.col("text").cast("string")
    return written(docs.select(F.monotonically_increasing_id().alias("row_id"), *keep, _parts(text).alias("parts")), "parts")


def _spans(marked: DataFrame, scope: int) -> DataFrame:
    """`row_id, spans` of rows with parts; spans: sorted structs of start, kind order, end."""
    each = marked.select("row_id", F.explode("parts").alias("p")).select(
        "row_id",
        F.col("p.kind").alias("kind"),
        F.posexplode(
            F.arrays_zip(
                F.slice("p.gaps", F.lit(1), F.size("p.sizes")).alias("gap"),
                F.col("p.sizes").alias("size"),
                F.col("p.vals").alias("val"),
            )
        ).alias("at", "m"),
    )
    before = Window.partitionBy("row_id", "kind").orderBy("at")
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(before)
    placed = each.select("row_id", "kind", (end - F.col("m.size")).alias("start"), end.alias("end"), F.col("m.val").alias("val"))
    least = F.array(*[F.lit(k.least) for k in KINDS])
    fails = F.col("val") < F.element_at(least, F.col("kind") + 1)
    short = (F.col("kind") == 0) & fails & (F.col("val") >= SHORT_LEAST)
    order = F.when(short, SHORT_ORDER).when(~fails, F.col("kind"))
    of_part = F.element_at(F.array(*[F.lit(k.part) for k in KINDS], F.lit(SECRET)), F.col("ord") + 1)
    weak = F.element_at(F.array(*[F.lit(k.weak) for k in KINDS], F.lit(True)), F.col("ord") + 1)
    parts = written(
        placed.select("row_id", "start", "end", order.alias("ord")).where("ord IS NOT NULL")
        .withColumns({"part": of_part, "weak": weak, "bin": F.expr(f"start div {scope}")}),
        "spans",
    )
    # The interval join: a bin's first and last start of a part stand for all of them, as the
    # next bins are entirely before or behind. Its size is that of the bins, not of the pairs.
    bins = parts.where(F.col("part") != ENDPOINT).groupBy("row_id", "part", "bin").agg(
        F.min("start").alias("first"), F.max("start").alias("last")
    )
    near = bins.select(
        "row_id",
        F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"),
        F.col("part").alias("other"),
        "first",
        "last",
    )
    weak_parts = parts.where("weak")
    joined = weak_parts.join(near, ["row_id", "bin"]).where(
        (F.col("other") != F.col("part"))
        & (F.col("first") <= F.col("start") + scope)
        & (F.col("last") >= F.col("start") - scope)
    )
    linked = joined.groupBy("row_id", "start", "end", "ord", "part").agg(
        F.countDistinct("other").alias("others")
    ).where((F.col("part") != ENDPOINT) | (F.col("others") == 2))
    kept = parts.where(~F.col("weak")).select("row_id", "start", "ord", "end").unionByName(
        linked.select("row_id", "start", "ord", "end")
    )
    return kept.groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "ord", "end"))).alias("spans")
    )


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS], F.lit(SHORT))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"], s["end"])), ","
    )


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """`doc_id, spans` per row of `docs` (`doc_id`, `text`).

    Spans are structs of start, kind order (`KINDS`, then `short`) and end in code points, end
    exclusive, sorted. A null or empty text has none; null and repeated ids give a row each;
    an empty table none; other columns are ignored.
    """
    marked = _marked(docs, F.col("doc_id"))
    none = F.array().cast("array<struct<start: bigint, ord: int, end: bigint>>")
    plain = marked.where(F.coalesce(F.size("parts"), F.lit(0)) <= 0).select("doc_id", none.alias("spans"))
    hit = marked.where(F.size("parts") > 0).select("row_id", "doc_id", "parts")
    found = hit.join(_spans(hit, scope), "row_id", "left")
    return plain.unionByName(found.select("doc_id", F.coalesce("spans", none).alias("spans")))


def mask_secrets(docs: DataFrame, scope: int = SCOPE, mask: str = MASK) -> DataFrame:
    """`docs` with every reported span of `text` replaced by `mask`; spans that meet, by one."""
    marked = _marked(docs, F.struct("*").alias("doc"))
    plain = marked.where(F.coalesce(F.size("parts"), F.lit(0)) <= 0).select("doc")
    hit = marked.where(F.size("parts") > 0)
    found = hit.join(_spans(hit.select("row_id", "parts"), scope), "row_id", "left")
    text = F.col("doc.text")
    # What stays lies between the furthest end so far and the next start.
    folded = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("done"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["done"], s["end"]).alias("done"),
            F.when(
                (s["start"] > acc["done"]) | (acc["out"] == ""),
                F.concat(acc["out"], F.substring(text, acc["done"] + 1, s["start"] - acc["done"]), F.lit(mask)),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["done"] + 1, F.char_length(text))),
    )
    cleaned = found.select(F.col("doc").withField("text", F.when(F.col("spans").isNull(), text).otherwise(folded)).alias("doc"))
    return plain.unionByName(cleaned).select("doc.*")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credential spans of every document."""
    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(order: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["ord"] == order)).cast("long")

    counts = [count(k).alias(f"n_{KINDS[k].name}") for k in range(BASE)]
    base = F.filter("spans", lambda s: s["ord"] < BASE)
    return found.select(
        "doc_id", *counts, F.sha2(_shown(base), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans")
    )


def _op4_sql() -> str:
    """The query in SQL: the same sums of lengths, and the linking as a plain EXISTS."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    matches = " UNION ALL ".join(
        f"SELECT r, {order} AS kind, {kind.least} AS least, regexp_split_to_array(t, {quoted(kind.pattern)}) AS gaps, "
        f"regexp_extract_all(t, {quoted(kind.pattern)}, 0) AS ms, regexp_extract_all(t, {quoted(kind.pattern)}, {kind.value}) AS vs "
        "FROM d"
        for order, kind in enumerate(KINDS)
    )
    parts = ", ".join(str(p) for p in [*(k.part for k in KINDS), SECRET])
    weak = ", ".join(str(w) for w in [*(k.weak for k in KINDS), True])
    names = ", ".join(quoted(n) for n in [*(k.name for k in KINDS), SHORT])
    near = f"EXISTS (FROM parts o WHERE o.r = w.r AND o.part = {{}} AND abs(o.start - w.start) <= {SCOPE})"
    has_id, has_secret = near.format(IDENTIFIER), near.format(SECRET)
    counts = ", ".join(f"count(*) FILTER (ord = {k}) AS n_{KINDS[k].name}" for k in range(BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({matches}),
e AS (SELECT r, kind, least, len(ms[i]) AS size, len(vs[i]) AS val,
    sum(len(gaps[i]) + len(ms[i])) OVER (PARTITION BY r, kind ORDER BY i) AS stop
  FROM m, unnest(range(1, len(ms) + 1)) AS u(i)),
o AS (SELECT r, (stop - size)::BIGINT AS start, stop::BIGINT AS stop, CASE WHEN val >= least THEN kind
    WHEN kind = 0 AND val >= {SHORT_LEAST} THEN {SHORT_ORDER} END AS ord FROM e),
parts AS (SELECT *, ([{parts}])[ord + 1] AS part, ([{weak}])[ord + 1] AS weak FROM o WHERE ord IS NOT NULL),
kept AS (SELECT r, start, stop, ord FROM parts w WHERE NOT weak OR CASE part WHEN {IDENTIFIER} THEN {has_secret}
    WHEN {SECRET} THEN {has_id} ELSE {has_id} AND {has_secret} END),
shown AS (SELECT *, ([{names}])[ord + 1] || ':' || start || ':' || stop AS s FROM kept)
SELECT doc_id, {counts},
  sha256(coalesce(string_agg(s, ',' ORDER BY start, ord, stop) FILTER (ord < {BASE}), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY start, ord, stop), '') AS spans
FROM d LEFT JOIN shown USING (r) GROUP BY r, doc_id"""


OP4_SQL = _op4_sql()
