"""Repeated windows, spelling variants and the conversation trie against brute force, with odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.llm.spelling import SortedList, _scan, group_variants, near_pairs, word_counts
from waymark.llm.substring import _spans, remove_repeats, window_hashes
from waymark.llm.turn_trie import NO_IDS, TernaryTree, conversation_trie

WORDS = "the of and in stone river tree cloud light night wind rain sun moon star sea sand salt".split()
BLANKS = " \t\n\r\x0b\x0c"


# Repeated windows ------------------------------------------------------------------------------


def words_of(text):
    words, run = [], ""
    for c in (text or "") + " ":
        if c in BLANKS:
            words, run = words + [run] * bool(run), ""
        else:
            run += c
    return words


def plain_repeats(rows, window):
    """[(doc_id, words, removed flags)] by comparing all windows."""
    least = {}
    for doc_id, text in rows:
        own = words_of(text)
        for k in range(len(own) - window + 1):
            key = tuple(own[k : k + window])
            if doc_id is not None:
                least[key] = min(least.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        own = words_of(text)
        gone = [False] * len(own)
        for k in range(len(own) - window + 1):
            if doc_id is not None and least[tuple(own[k : k + window])] < doc_id:
                gone[k : k + window] = [True] * window
        out.append((doc_id, own, gone))
    return out


def odd_texts():
    rng = random.Random(5)
    passage = [rng.choice(WORDS) for _ in range(60)]
    rows = []
    for i in range(60):
        own = [rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 120))]
        if i % 3 == 0:
            a, b = sorted(rng.sample(range(61), 2))
            at = rng.randint(0, len(own))
            own[at:at] = passage[a:b]
        rows.append((i, rng.choice([" ", "\n", " \t ", "\x0b"]).join(own)))
    rows += [(100, None), (101, ""), (102, " \n\t "), (None, rows[3][1]), (None, None), (-5, rows[9][1])]
    rows += [(103, rows[3][1]), (103, rows[3][1]), (103, rows[6][1]), (104, "a " * 5000), (105, "b a " * 3000 + "a " * 40)]
    rows += [(106, "x" * 200_000), (107, "日本語 ñandú Größe " * 30), (108, "日本語 ñandú Größe " * 9)]
    return rows


@pytest.mark.parametrize("window,bucket_bytes,files", [(13, 32 << 20, 7), (13, 2000, 3), (2, 32 << 20, 1)])
def test_repeats_are_those_of_all_windows(spark, window, bucket_bytes, files):
    rows = odd_texts()
    docs = spark.createDataFrame([(i, t, 1, "k", True) for i, t in rows], "doc_id long, text string, hashes int, key string, unnamed boolean")
    got = remove_repeats(docs.repartition(files), window, bucket_bytes).collect()
    want = []
    for doc_id, own, gone in plain_repeats(rows, window):
        spans = _spans(np.array(gone, dtype=bool)) if own else []
        want.append((doc_id, len(own), sum(gone), spans, " ".join(w for w, g in zip(own, gone) if not g)))
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    found = [(r.doc_id, r.n_words, r.n_removed, [(s.first, s.end) for s in r.removed], r.kept_text) for r in got]
    assert sorted(found, key=key) == sorted(want, key=key)


def test_repeats_across_batches_and_in_an_empty_table(spark, monkeypatch):
    import waymark.llm.substring as module

    monkeypatch.setattr(module, "BATCH_WINDOWS", 50)
    rows = [(i, t) for i, t in odd_texts() if i is None or i < 100]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in remove_repeats(docs.coalesce(1)).collect() if r.doc_id is not None}
    assert got == {i: sum(gone) for i, _, gone in plain_repeats(rows, 13) if i is not None}
    assert remove_repeats(docs.limit(0)).count() == 0


def test_window_hashes_know_order_and_bounds():
    texts = [[b"a", b"b", b"c"], [], [b"b", b"c"], [b"c", b"b"], [b"x"], [b"a", b"b"]]
    hashes, second, counts = window_hashes(texts, 2)
    assert counts.tolist() == [2, 0, 1, 1, 0, 1]
    ab, bc, bc2, cb, ab2 = hashes.tolist()
    assert ab == ab2 and bc == bc2 and len({ab, bc, cb}) == 3 and len(set(second.tolist())) == 3


# Spelling variants -----------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def similar_words(rng, n, letters="abé", sizes=(6, 9)):
    found = set()
    while len(found) < n:
        found.add("".join(rng.choice(letters) for _ in range(rng.randint(*sizes))))
    return sorted(found)


@pytest.mark.parametrize("crowd", [4096, 8, 1])
def test_near_pairs_are_all_pairs(spark, crowd):
    rng = random.Random(crowd)
    words = similar_words(rng, 150) + similar_words(rng, 60, "abcdefghijÿ×", (6, 14)) + ["stonewall", "stonewalls", "tonewalls"]
    words = sorted(set(words))
    table = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = [(r.word, r.near, r.near_n) for r in near_pairs(table, crowd=crowd).collect()]
    want = [(a, b, j + 1) for a in words for j, b in enumerate(words) if one_edit(a, b)]
    assert sorted(got) == sorted(want)


def test_scan_skips_what_cannot_be_near():
    rng = random.Random(2)
    words = sorted(similar_words(rng, 300, "abcdefgh", (1, 12)))
    listed = SortedList([w.encode("latin-1") for w in words], np.zeros(len(words), dtype=int))
    a, b = listed.near(np.arange(len(words)))
    got = sorted(zip(a.tolist(), b.tolist()))
    assert got == [(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if i < j and one_edit(x, y)]
    assert _scan(pd.DataFrame({"key": ["k"], "middle": ["abc"], "word": ["abcabc"], "n": [5], "size": [6], "m": [6], "i": [3], "j": [6]})).empty


def plain_variants(rows, least, ratio, dropped):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            c = c.lower() if "A" <= c <= "Z" else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if doc_id is not None and h % dropped == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
            run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    out = {}
    for w, n in words.items():
        near = sorted((-m, x) for x, m in words.items() if one_edit(w, x))
        best = near[0] if near and -near[0][0] >= ratio * n else None
        out[w] = (best and best[1], n, len(near), best and -best[0])
    rows = []
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, n_near, form_n))
    return sorted(rows, key=lambda r: r[0])


def test_variants_are_those_of_all_words(spark):
    rng = random.Random(9)
    base = similar_words(rng, 25, "abcdeÉé", (5, 9))
    weights = [5 ** rng.randint(0, 5) for _ in base]
    rows = [(i, " ".join(rng.choices(base, weights, k=rng.randint(0, 400))) + rng.choice([".", " Öl-ABCDEF", "ABCDEF9abcdef"])) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "abcdef abcdee " * 9), (102, "the " + "abcdefg " * 30_000), (102, "the " + "abcdefg " * 30)]
    docs = spark.createDataFrame([(i, t, 3, "z") for i, t in rows], "doc_id long, text string, n int, word string")
    got = [tuple(r) for r in group_variants(docs.repartition(5), dropped=7).orderBy("word").collect()]
    want = plain_variants(rows, 5, 5, 7)
    assert sorted(got, key=lambda r: r[0]) == want
    assert any(r[1] and r[1] != r[2] for r in want), "a chain of two forms"
    assert group_variants(docs.limit(0)).count() == 0


def test_words_are_counted_past_the_held_ones(spark, monkeypatch):
    import waymark.llm.spelling as module

    monkeypatch.setattr(module, "HELD_WORDS", 3)
    docs = spark.createDataFrame([(i, f"common words stand in every text unlike onlyhere{'x' * i}") for i in range(9)], "doc_id long, text string")
    counts = {r.word: r.n for r in word_counts(docs.coalesce(1), dropped=1 << 40).collect()}
    assert counts["common"] == counts["unlike"] == 9 and len(counts) == 11


# Conversation trie -----------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv_id].append((turn is not None, turn or 0, mark, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(own[c])] for c in own}
    members = defaultdict(list)
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = turns.get(c - c % 100, [])[:h] + mine[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, len(whole)))
    out = []
    for node, who in members.items():
        below = [k for k in members if k[: len(node)] == node]
        leaf = [k for k in below if not any(len(j) == len(k) + 1 and j[: len(k)] == k for j in below)]
        ends = ",".join(str(c) for c, n in sorted(who) if n == len(node))
        out.append((
            min(who)[0], len(node), min(members[node[:-1]])[0] if node else None, len(who),
            sum(len(k) == len(node) + 1 for k in below), len(leaf),
            sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def odd_turns():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 250, 251, 399, 400, -7, -100]:
        for t in range(rng.choice([1, 2, 3, 8, 12])):
            rows.append((c, t, rng.choice(["user", "user", "assistant", None]), rng.choice(["yes", "no", "né", None, ""])))
    rows += [(5, None, "system", "first"), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (6, 1, None, "x" * 300_000), (7, None, None, None)]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None), (300, 0, "user", "yes"), (301, 0, "user", "yes")]
    return rows


@pytest.mark.parametrize("shards,files", [(4, 5), (61, 2)])
def test_trie_is_that_of_all_prefixes(spark, shards, files):
    rows = odd_turns()
    table = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "conv_id long, turn long, role string, text string, id int, n int, seq string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    try:
        got = [tuple(r) for r in conversation_trie(table.repartition(files)).collect()]
        assert conversation_trie(table.limit(0)).count() == 0
        assert conversation_trie(table.where("conv_id IS NULL")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=str) == plain_trie(rows)


def test_trie_of_many_equal_conversations(spark):
    rows = spark.range(12_000).select(
        (F.col("id") * 100 + 1).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text")
    )
    got = {r.depth: r for r in conversation_trie(rows).collect()}
    # Without a first conversation of the block, those of one turn or more in its head are left without turns.
    ids = [100 * k + 1 for k in range(12_000)]
    empty = [c for c in ids if zlib.crc32(str(c).encode()) % 6]
    kept = [c for c in ids if zlib.crc32(str(c).encode()) % 6 == 0]
    sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    assert set(got) == {0, 1} and got[0].n_convs == 12_000 and got[1].n_convs == len(kept)
    assert got[0].ends_sha256 == sha(empty) and got[1].ends_sha256 == sha(kept)
    assert got[1].saved_tokens == 2 * (len(kept) - 1) == got[0].saved_tokens and NO_IDS not in (got[0].ends_sha256, got[1].ends_sha256)


def test_medians_reach_everything_once_and_balance():
    order = list(TernaryTree.medians(1000))
    assert sorted(order) == list(range(1000)) and order[0] == 500
    tree = TernaryTree()
    for k in order:
        tree.insert([k], [1], 1, k, "")
    deepest = {}
    stack = [(tree.same[0], 1)]
    while stack:
        node, d = stack.pop()
        deepest[node] = d
        stack += [(c, d + 1) for c in (tree.low[node], tree.high[node]) if c >= 0]
    assert max(deepest.values()) == 10
