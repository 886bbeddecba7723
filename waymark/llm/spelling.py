"""Spelling variants: sorted-list dynamic programming over groups of a vocabulary.

Two words one edit apart agree before the edit and behind it. For the length m of the shorter one,
a group `(m, i, j, head, tail)` holds the words of m or m + 1 letters whose first i letters are
`head` and whose last m - j are `tail`; what is between them is their middle. Every near pair is in
one of the two halves that `[0, m)` is cut into, and so on: a group of more than `CROWD` words
is cut in halves again, until its middles have at most two letters, so that the alphabet bounds it.

In a group the middles are sorted. Each word scans those behind it, row by row of the edit matrix, of
which only the band around the diagonal can hold one edit. Rows are kept as far as the next middle
shares its prefix with the last; where a row has no cell within one edit, all middles that share
that prefix are skipped. The scans of many words advance together as NumPy lanes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import crc32_sql, small_batches, table, written
from waymark.llm.simhash import LOWER
from waymark.llm.tokens import text_list

LEAST_LETTERS = 6
LEAST_COUNT = 5
# A form is at least this many times as common as its variant.
RATIO = 5
# One in so many (document, run) pairs, by checksum, loses a letter before words are counted.
DROPPED = 199
CROWD = 4096
# Distinct words whose counts a task holds, rows whose scans start together, lanes of one scan.
HELD_WORDS = 500_000
CHUNK_ROWS = 50_000
LANES = 1 << 15
PAIRS = "word string, near string, near_n long"


def word_counts(docs: DataFrame, letters: int = LEAST_LETTERS, dropped: int = DROPPED) -> DataFrame:
    """`word, n` of all words of at least `letters` code points in `docs` (`doc_id`, `text`)."""
    small_batches(docs.sparkSession)
    run = re.compile(f"[A-Za-zÀ-ÿ]{{{letters},}}")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], text_list(batch["text"])):
                own = Counter(run.findall(text.encode().translate(LOWER).decode()))
                if doc_id is not None:
                    start = zlib.crc32(f"{doc_id}:".encode())
                    for word, mark in [(w, c) for w in own if not (c := zlib.crc32(w.encode(), start)) % dropped]:
                        n, k = own.pop(word), mark % len(word)
                        if len(word) > letters:
                            held[word[:k] + word[k + 1 :]] += n
                held.update(own)
            if len(held) > HELD_WORDS:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held = Counter()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    # Ids travel as text: that is how they are marked, and a null stays one.
    read = docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string"))
    return read.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _halves(rows: DataFrame) -> DataFrame:
    """Both halves of the groups of `rows` (`word, n, size, m, i, j`), with their keys and middles."""
    half = F.expr("(i + j) div 2")
    cut = rows.withColumn("half", half).withColumn(
        "cut", F.explode(F.array(F.struct(F.col("half").alias("i"), F.col("j")), F.struct(F.col("i"), F.col("half").alias("j"))))
    )
    cut = cut.select("word", "n", "size", "m", F.col("cut.i").cast("int").alias("i"), F.col("cut.j").cast("int").alias("j"))
    head = F.expr("substring(word, 1, i)")
    tail = F.expr("substring(word, size - m + j + 1, m - j)")
    return cut.withColumn("key", F.concat_ws("|", "m", "i", "j", head, tail)).withColumn(
        "middle", F.expr("substring(word, i + 1, size - m + j - i)")
    )


def grouped(words: DataFrame, letters: int = LEAST_LETTERS, crowd: int = CROWD) -> DataFrame:
    """The words (`word, n`) in groups of at most `crowd`, or of middles of at most two letters."""
    sized = words.withColumn("size", F.char_length("word"))
    shorter = F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("m")
    rows = sized.select("word", "n", "size", shorter).where(F.col("m") >= letters)
    open_rows = _halves(rows.select("*", F.lit(0).alias("i"), F.col("m").alias("j")))
    done = None
    while True:
        sizes = open_rows.where("j - i > 1").groupBy("key").agg(F.count("*").alias("members"))
        crowded = written(sizes.where(F.col("members") > crowd).select("key"), "crowded")
        if crowded.isEmpty():
            return open_rows if done is None else done.unionByName(open_rows)
        fit = open_rows.join(crowded, "key", "left_anti")
        done = fit if done is None else done.unionByName(fit)
        again = open_rows.join(crowded, "key", "left_semi").select("word", "n", "size", "m", "i", "j")
        open_rows = written(_halves(again), "halves")


class SortedList:
    """Middles of several groups, sorted within each, as a matrix of letters with shared prefixes."""

    def __init__(self, middles: list[bytes], group: np.ndarray) -> None:
        self.sizes = np.array([len(m) for m in middles], dtype=np.int32)
        width = max(1, int(self.sizes.max()))
        self.letters = np.array(middles, dtype=f"S{width}").view(np.uint8).reshape(-1, width)
        n = len(middles)
        # Letters that a middle shares with the one before it; -1 at the start of a group.
        self.shared = np.full(n + 1, -1, dtype=np.int32)
        same = self.letters[1:] == self.letters[:-1]
        prefix = np.where(same.all(axis=1), width, same.argmin(axis=1))
        prefix = np.minimum(prefix, np.minimum(self.sizes[1:], self.sizes[:-1]))
        self.shared[1:n] = np.where(group[1:] == group[:-1], prefix, -1)
        # The first place behind each that shares fewer than d letters with the one before it.
        self.beyond = np.empty((width + 2, n), dtype=np.int32)
        for d in range(width + 2):
            bounds = np.flatnonzero(self.shared[1:] < d) + 1
            self.beyond[d] = bounds[np.searchsorted(bounds, np.arange(n), side="right")]

    def near(self, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place, later place of its group) of middles exactly one edit apart, for places `lanes`."""
        width = self.letters.shape[1]
        query, own, at = lanes, self.sizes[lanes], lanes + 1
        # Two letters that no word has stand outside the query; cells outside the band are two.
        padded = np.zeros((len(lanes), width + 4), dtype=np.uint8)
        padded[:, 2 : 2 + width] = self.letters[lanes]
        rows = np.full((width + 2, 3, len(lanes)), 2, dtype=np.uint8)
        rows[0, 1], rows[0, 2] = 0, np.where(own >= 1, 1, 2)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.flatnonzero(self.shared[at] >= 0)
        while len(live):
            place = at[live]
            size = self.sizes[place]
            # Rows up to the shared prefix stand; a lane's first middle starts from row 0.
            keep = np.where(place == query[live] + 1, 0, self.shared[place])
            dead = np.zeros(len(live), dtype=np.int32)
            for d in range(int(keep.min()) + 1, int(size.max()) + 1):
                go = np.flatnonzero((keep < d) & (size >= d) & (dead == 0))
                if not len(go):
                    continue
                lane = live[go]
                letter = self.letters[place[go], d - 1]
                above = rows[d - 1][:, lane]
                # Cells (d, d - 1), (d, d), (d, d + 1); columns behind the query's end are out.
                left = np.minimum(above[0] + (padded[lane, d] != letter), above[1] + 1)
                mid = np.minimum(np.minimum(above[1] + (padded[lane, d + 1] != letter), above[2] + 1), left + 1)
                right = np.minimum(above[2] + (padded[lane, d + 2] != letter), mid + 1)
                cells = np.minimum(np.stack([left, mid, right]), 2).astype(np.uint8)
                n = own[lane]
                cells[0][n < d - 1], cells[1][n < d], cells[2][n < d + 1] = 2, 2, 2
                rows[d][:, lane] = cells
                over = cells.min(axis=0) > 1
                dead[go[over]] = d
            gap = own[live] - size
            ends = np.flatnonzero((dead == 0) & (np.abs(gap) <= 1))
            hit = ends[rows[size[ends], gap[ends] + 1, live[ends]] == 1]
            if len(hit):
                found.append((query[live[hit]], place[hit]))
            at[live] = np.where(dead > 0, self.beyond[dead, place], place + 1)
            # What begins a group ends the scan; the place behind the last one begins one, too.
            after = at[live]
            passed = self.beyond[0, query[live]]
            live = live[after < passed]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, second = (np.concatenate(p) for p in zip(*found))
        return first, second


def _scan(rows: pd.DataFrame) -> pd.DataFrame:
    """Near pairs, both ways, of whole groups in order of (key, middle)."""
    keys = rows["key"].to_numpy()
    group = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
    several = np.bincount(group)[group] > 1
    rows, group = rows[several].reset_index(drop=True), group[several]
    if rows.empty:
        return rows[["word", "middle", "n"]].set_axis(["word", "near", "near_n"], axis=1)
    listed = SortedList([m.encode("latin-1") for m in rows["middle"]], group)
    # Scans of about equal length run together.
    lanes = np.argsort(np.bincount(group)[group], kind="stable")
    parts = [listed.near(lanes[k : k + LANES]) for k in range(0, len(lanes), LANES)]
    a, b = (np.concatenate(p) for p in zip(*parts))
    size, short = rows["size"].to_numpy(), rows["m"].to_numpy()
    # Two longer words belong to the groups of their own length.
    mine = (size[a] == short[a]) | (size[b] == short[b])
    # A group with a tail leaves out pairs that also agree in all letters before it: the other half has them.
    uneven = mine & (size[a] != size[b]) & (rows["j"].to_numpy()[a] < short[a])
    width = (rows["j"] - rows["i"]).to_numpy()
    for k in np.flatnonzero(uneven):
        n = width[a[k]]
        mine[k] = (listed.letters[a[k], :n] != listed.letters[b[k], :n]).any()
    a, b = a[mine], b[mine]
    words, n = rows["word"].to_numpy(), rows["n"].to_numpy()
    return pd.DataFrame(
        {"word": np.concatenate([words[a], words[b]]), "near": np.concatenate([words[b], words[a]]), "near_n": np.concatenate([n[b], n[a]])}
    )


def near_pairs(words: DataFrame, letters: int = LEAST_LETTERS, crowd: int = CROWD) -> DataFrame:
    """`word, near, near_n` for every two of `words` (`word, n`; distinct) exactly one edit apart, both ways.

    Words are of letters up to U+00FF, `letters` of them at least.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= CHUNK_ROWS:
                rows = pd.concat(held, ignore_index=True)
                last = rows["key"].to_numpy() == rows["key"].iloc[-1]
                # The last group may go on in the next batch.
                held = [rows[last]]
                if not last.all():
                    yield _scan(rows[~last].reset_index(drop=True))
        if held:
            yield _scan(pd.concat(held, ignore_index=True))

    rows = grouped(words, letters, crowd).repartition("key").sortWithinPartitions("key", "middle")
    return rows.select("key", "middle", "word", "n", "size", "m", "i", "j").mapInPandas(scan, PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """`word, root` for `word, form` rows: forms followed to the last, by pointer doubling.

    A form is several times as common as its word, so chains are short and never closed.
    """
    ends = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if ends.join(onward, "root", "left_semi").isEmpty():
            return ends
        ends = written(ends.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def group_variants(
    docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, ratio: int = RATIO,
    dropped: int = DROPPED, crowd: int = CROWD,
) -> DataFrame:
    """Words of `docs` (`doc_id`, `text`) with the commoner word each is a variant of.

    Words are runs of letters (A to Z in lower case, U+00C0 to U+00FF as they are) of `letters` code
    points or more that occur `least` times or more; one in `dropped` (document, run) pairs has lost a
    letter first. Returns `word, form, root, n, n_near, form_n`: the form is the commonest near word
    (ties: the least by code points) if it is `ratio` times as common, else null; the root is the last
    of the chain of forms, the word itself without one; n_near counts the words exactly one edit away.
    Null and empty texts have no words; runs of a null id lose no letter; repeated rows count as
    often as they come; an empty table gives no rows; other columns are ignored.
    """
    words = written(word_counts(docs, letters, dropped).where(F.col("n") >= least), "words")
    pairs = near_pairs(words, letters, crowd)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = written(near.select("word", "n_near", F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n")), "near")
    common: Column = F.col("near_n") >= ratio * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(common, F.col("near")).alias("form"), F.when(common, F.col("near_n")).alias("form_n"),
    )
    told = written(told, "variants")
    last = roots(told.where("form IS NOT NULL"))
    return told.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return group_variants(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, run, len(run) AS size, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
    ) WHERE len(run) >= 6 GROUP BY ALL
), marked AS (
    SELECT *, CASE WHEN doc_id IS NULL THEN 1 ELSE {crc32_sql("doc_id || ':' || run")} END AS h FROM runs
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word
        FROM marked
    ) WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), holes AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM words, unnest(range(1, len(word) + 1)) AS u(i)
), pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b USING (i, rest) WHERE a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM words a JOIN holes b ON a.word = b.rest
    UNION SELECT b.word, a.word, a.n FROM words a JOIN holes b ON a.word = b.rest
), best AS (
    SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n
    FROM pairs GROUP BY word
), told AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
        CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
    FROM words LEFT JOIN best USING (word)
), chain AS (
    SELECT word, word AS root FROM told
    UNION ALL SELECT c.word, t.form FROM chain c JOIN told t ON c.root = t.word WHERE t.form IS NOT NULL
), ends AS (
    SELECT c.word, c.root FROM chain c JOIN told t ON c.root = t.word WHERE t.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM told JOIN ends USING (word)
"""
