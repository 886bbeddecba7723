"""Classifiers, archives, embeddings, tool calls and the pipeline."""

import base64
import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm.chat import call_depths, canonical, conversation_calls, format_calls, format_turns, problems
from waymark.llm.cover_tree import build_tree, close_leaves, cosine_links, descend
from waymark.llm.quality import SLOTS, fit, ngram_slots, score_quality, train_quality
from waymark.llm.shared import held_out
from waymark.llm.toxicity import AIMED, DENIED, GRAMMAR, INSULT, NEGATION, OTHER, PLAIN, REPORT, REPORTED, TARGET, THREAT
from waymark.llm.toxicity import Grammar, score_toxicity, train_toxicity
from waymark.llm.warc import read_archives, verified_records, write_archives

CLEAN = "the river runs by stone and light over sand while trees stand in the wind of night".split()


def documents(spark, count=400):
    """Labelled documents: junk has signs or repeats, toxic ones hold an invented insult."""
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(count):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(8, 80))]
        junk, toxic = i % 5 == 0, i % 7 == 0
        if junk:
            words = [w + rng.choice(["$$$", "%%%"]) for w in words] if i % 2 else [words[0]] * len(words)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["grumblor", "snarkwit"]))
        docs.append((i, " ".join(words) + ".", 1))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(count, None, 1), (count + 1, "", 1), (None, "river stone", 1), (3, docs[3][1], 1)]
    labels += [(None, 1, 0), (count + 2, None, None), (3, labels[3][1], labels[3][2])]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score int"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def judged(scored, labels, label, threshold):
    rows = scored.select("doc.doc_id", "score").join(labels, "doc_id").where(held_out(F.col("doc_id")))
    rows = rows.where(F.col(label).isNotNull()).collect()
    return len(rows), sum((r.score >= threshold) == bool(r[label]) for r in rows)


def test_quality_on_held_out_rows(spark):
    docs, labels = documents(spark)
    model = train_quality(docs, labels, sample=150)
    scored = score_quality(docs, model)
    count, right = judged(scored, labels, "quality", 0.7)
    assert count > 60 and right / count > 0.95
    assert scored.count() == docs.count() and scored.where("score BETWEEN 0 AND 1").count() == docs.count()
    assert scored.select("doc.*").columns == docs.columns


def test_quality_without_labels_or_rows(spark):
    docs, labels = documents(spark, 20)
    assert {r.score for r in score_quality(docs, train_quality(docs, labels.limit(0))).collect()} == {0.5}
    good = train_quality(docs, labels.where("quality = 1"))
    assert all(r.score > 0.99 for r in score_quality(docs, good).collect())
    assert score_quality(docs.limit(0), good).count() == 0


def test_held_out_labels_teach_nothing(spark):
    docs, labels = documents(spark, 60)
    wrong = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = train_quality(docs, labels), train_quality(docs, wrong)
    assert np.array_equal(a.weight, b.weight) and (a.slope, a.shift) == (b.slope, b.shift)


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    seen = np.zeros(SLOTS, dtype=bool)
    slots = [ngram_slots("".join(rng.choice(list("abcd" if i % 2 else "cdef"), 30)), seen) for i in range(200)]
    labels = np.arange(200) % 2
    model = fit(slots, labels)
    assert not seen.any() and np.mean([(model.score(s) > 0.5) == l for s, l in zip(slots, labels)]) == 1


def run_grammar(symbols):
    state, out = 0, []
    for s in symbols:
        state, written = GRAMMAR[state, s]
        if written % 10 == INSULT:
            out.append(written // 10)
    return out


def test_grammar_clauses():
    assert run_grammar([OTHER, INSULT]) == [PLAIN]
    assert run_grammar([TARGET, OTHER, INSULT]) == [AIMED]
    assert run_grammar([TARGET, OTHER, OTHER, OTHER, OTHER, INSULT]) == [PLAIN]
    assert run_grammar([TARGET, NEGATION, INSULT, OTHER, OTHER, OTHER, INSULT]) == [DENIED, PLAIN]
    assert run_grammar([REPORT] + [OTHER] * 9 + [INSULT]) == [REPORTED]


def test_clauses_end_scopes():
    grammar = Grammar({"grumblor": 5.0}, {"snark": 4.0})
    plain = grammar.features("He said nothing. A grumblor")
    assert plain[PLAIN] > 0 and plain[REPORTED] == 0
    assert grammar.features("she said a Grumblor")[REPORTED] > 0
    assert grammar.features("snarkwits")[PLAIN] > 0 and not grammar.features("").any()


def plain_features(grammar, text):
    """The features by rules read off each match's surroundings, without any machine."""
    total, most, threats, hits, words = [0.0] * 4, [0.0] * 4, [0.0] * 4, 0, 0
    for clause in re.split(r"[.!?;:\n]+", text.lower()):
        found = [grammar.symbol(w) or (OTHER, 0.0) for w in re.findall(r"[^\W\d_]+", clause)]
        words += len(found)
        symbols, own = [s for s, _ in found], [0.0] * 4
        for i, (symbol, weight) in enumerate(found):
            if symbol not in (INSULT, THREAT):
                continue
            near = TARGET in symbols[max(0, i - 4) : i] or TARGET in symbols[i + 1 : i + 4]
            kind = AIMED if near else PLAIN
            kind = DENIED if NEGATION in symbols[max(0, i - 3) : i] else kind
            kind = REPORTED if REPORT in symbols[:i] else kind
            if symbol == THREAT:
                threats[kind] += 1
            else:
                hits += 1
                own[kind] += weight
        total = [a + b for a, b in zip(total, own)]
        most = [max(a, b) for a, b in zip(most, own)]
    share = hits / words if words else 0.0
    return [*np.log1p(total), *most, *np.log1p(threats), share]


def test_features_against_a_plain_reading():
    grammar = Grammar({"grumblor": 5.0, "vexnik": 3.5}, {"snark": 4.0})
    rng = random.Random(3)
    vocabulary = "grumblor vexnik snarkwits kill killing töten tuera you them not never said wrote stone river the".split()
    for _ in range(1000):
        text = "".join(rng.choice(vocabulary) + rng.choice([" "] * 9 + [". ", "; ", "\n"]) for _ in range(rng.randrange(40)))
        assert np.allclose(grammar.features(text), plain_features(grammar, text)), text
    long = "you grumblor " * 1000
    assert np.allclose(grammar.features(long), plain_features(grammar, long))
    # A clause of 400,000 words; the plain reading would look back over all of it for each.
    assert np.isclose(grammar.features(long * 200)[AIMED], np.log1p(5.0 * 200_000))


def test_threats_by_kind(spark):
    docs, labels = documents(spark)
    grammar = train_toxicity(docs, labels, sample=200)
    score = [grammar.score(t) for t in ("I will kill you", "I will not kill you", "He said I will kill you", "kill the process now please", "stone and river")]
    assert score[0] > max(score[1:4]) and min(score[:4]) > score[4]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = documents(spark)
    grammar = train_toxicity(docs, labels, sample=200)
    assert {"grumblor", "snarkwit"} <= set(grammar.words)
    scored = score_toxicity(docs, grammar)
    count, right = judged(scored, labels, "toxic", 0.3)
    assert count > 60 and right == count
    assert scored.count() == docs.count()


def test_toxicity_without_both_labels(spark):
    docs, labels = documents(spark, 20)
    for given, low, high in ((labels.limit(0), 0, 0.01), (labels.where("toxic = 1"), 0.99, 1)):
        scores = [r.score for r in score_toxicity(docs, train_toxicity(docs, given)).collect()]
        assert all(low <= s <= high for s in scores)


# --- archives ---


def test_archives(spark, tmp_path):
    magic = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "a\r\nb", ""), (5, "u", magic * 3), (6, "u", "é" * 90_000)]
    pages += [(None, "u", "same"), (7, "u", magic), (7, "u", magic), (8, "u", "x\r\n\r\n"), (None, None, "lone")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string")
    write_archives(df.coalesce(2), str(tmp_path / "w"), records=4)
    got = read_archives(spark, str(tmp_path / "w")).collect()
    first = {}
    for page_id, _, html in pages:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    want = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        again = (html or "") in first and page_id != first[html or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((page_id or -1, len(raw), digest, "revisit" if again else "response", first[html or ""] if again else -1))
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == sorted(want)
    # Small ranges: records, headers and payloads across their borders.
    small = verified_records(spark, str(tmp_path / "w"), range_bytes=37, tail_bytes=64)
    whole = verified_records(spark, str(tmp_path / "w"))
    assert sorted(small.collect()) == sorted(whole.collect()) and small.count() == len(pages)


def test_archives_with_long_headers(spark, tmp_path):
    pages = [(1, "u", "one"), (2, "v" * 200_000, "two"), (3, "w" * 70_000, "WARC/1.0\r\n" * 9), (4, "u", "last")]
    write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    for bytes_ in (50_000, 4 << 20):
        got = verified_records(spark, str(tmp_path / "w"), range_bytes=bytes_)
        assert sorted(r.page for r in got.collect()) == [f"<urn:page:{i}>" for i in (1, 2, 3, 4)]
    assert {(r.page_id, r.payload.decode()) for r in read_archives(spark, str(tmp_path / "w")).collect()} == {(i, t) for i, _, t in pages}


def test_cut_archives_are_errors(spark, tmp_path):
    write_archives(spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    [file] = (tmp_path / "w").glob("part-*")
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(file.read_bytes()[:-9])
    with pytest.raises(ValueError, match="records end at"):
        verified_records(spark, str(tmp_path / "cut"))


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    pages = [(i, "u", f"{i} " * (40_000 if i % 3 else 4)) for i in range(24)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    write_archives(df.coalesce(1), str(tmp_path / "w"), records=16, most=300_000)
    assert max(f.stat().st_size for f in (tmp_path / "w").glob("part-*")) <= 300_000
    assert {(r.page_id, r.payload.decode()) for r in read_archives(spark, str(tmp_path / "w")).collect()} == {(i, t) for i, _, t in pages}


def test_archives_of_nothing(spark, tmp_path):
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert read_archives(spark, str(tmp_path / "w")).count() == 0


# --- embeddings ---


def test_cover_tree_invariants():
    points = np.random.default_rng(1).standard_normal((120, 6))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points = np.vstack([points, points[:5]])
    parents, radii = build_tree(points)
    assert parents[0] == -1 and sum(p < 0 for p in parents) == 1
    for i, p in enumerate(parents[1:], 1):
        assert np.linalg.norm(points[i] - points[p]) <= 2 * radii[i] + 1e-9
    at = descend(points, points[:30], build_tree(points[:30])[0])
    assert ((0 <= at) & (at < 30)).all()


def test_no_close_pair_is_pruned():
    rng = np.random.default_rng(2)
    points = rng.standard_normal((300, 3))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    pivots = points[:20]
    parents, _ = build_tree(pivots)
    at = descend(points, pivots, parents)
    reach = np.full(20, -1.0)
    np.maximum.at(reach, at, np.linalg.norm(points - pivots[at], axis=1))
    kept = set(close_leaves(pivots, parents, reach, 0.2))
    gaps = np.linalg.norm(points[:, None] - points[None], axis=2)
    for i, j in zip(*np.nonzero(gaps <= 0.2)):
        assert (min(at[i], at[j]), max(at[i], at[j])) in kept


@pytest.mark.parametrize("leaf", [4, 512])
def test_cosine_links(spark, leaf):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            center = rng.standard_normal(8)
            for _ in range(rng.integers(1, 9)):
                rows.append((len(rows), (center + rng.standard_normal(8) * 0.08).tolist(), label))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(6)]
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 8, 0), (903, [float("nan")] * 8, 0), (904, [1.0] * 7 + [None], 0)]
    rows += [(905, [float("inf")] + [0.0] * 7, 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (None, rows[0][1], 0), (None, None, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, cid int")
    got = cosine_links(df, leaf=leaf).collect()

    def fine(r):
        v = r[1]
        return r[2] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = [np.array(r[1], dtype="f4").astype(float) if fine(r) else None for r in rows]
    units = [None if u is None else u / np.linalg.norm(u) for u in units]
    n = len(rows)
    near = [[bool(a != b and fine(rows[a]) and fine(rows[b]) and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.98) for b in range(n)] for a in range(n)]
    want = []
    for a in range(n):
        reached, todo = {a}, [a]
        while todo:
            x = todo.pop()
            more = [b for b in range(n) if near[x][b] and b not in reached]
            reached.update(more)
            todo += more
        ids = [rows[b][0] for b in reached if rows[b][0] is not None]
        want.append((-1 if rows[a][0] is None else rows[a][0], sum(near[a]), min(ids, default=-1)))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in got) == sorted(want)


def test_cosine_links_of_nothing(spark):
    assert cosine_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- tool calls ---

SCHEMA = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 0, "maximum": 9}, "s": {"type": "string", "maxLength": 3}, "l": {"type": "array", "items": {"enum": [1, "a"]}}}, "required": ["n"], "additionalProperties": False}


def test_schemas():
    assert problems({"n": 3, "s": "abc", "l": [1, "a"]}, SCHEMA) == []
    assert problems({"n": True}, SCHEMA) == ["$.n: not integer"]
    assert problems({"n": 10, "s": "abcd", "l": [2], "x": 0}, SCHEMA) == ["$.l[0]: not in enum", "$.n: above maximum", "$.s: too long", "$.x: unknown"]
    assert problems([], SCHEMA) == ["$: not object"] and problems({}, SCHEMA) == ["$.n: missing"]


def test_calls(spark):
    calls = [
        (1, 0, "a", "f", '{"n": 1, "s": "\\u00e9"}', None), (1, 2, "b", "f", '{"n":-1}', "a"), (1, 4, "c", "g", "{}", "b"),
        (2, 0, "x", "f", "{", "y"), (2, 1, "y", "f", None, "x"), (2, 2, "z", "f", '{"n":2}', "x"),
        (3, 0, None, "f", '{"n":2}', None), (None, None, "q", None, '{"n":2}', "gone"), (4, 0, "self", "f", '{"n":2}', "self"),
    ]
    results = [("a", "one"), ("a", "another"), ("z", None), (None, "lost"), ("nobody", "lost")]
    made = format_calls(
        spark.createDataFrame([(*c, 1) for c in calls], "conv_id long, turn long, call_id string, name string, arguments string, after string, status int"),
        spark.createDataFrame(results, "call_id string, content string"),
        {"f": SCHEMA},
    ).collect()
    got = {r.call_id: (r.depth, r.status, r.errors) for r in made}
    assert len(made) == len(calls)
    assert got["a"] == (0, "linked", []) and got["b"] == (1, "unanswered", ["$.n: below minimum"])
    assert got["c"] == (2, "unanswered", ["unknown tool"]) and got["z"] == (None, "linked", [])
    assert got["x"] == (None, "unanswered", ["$: not JSON"]) and got["y"][0] is None and got["self"][0] is None
    assert got[None] == (None, "unidentified", []) and got["q"] == (0, "unanswered", ["unknown tool"])
    line = {r.call_id: r.json for r in made}["a"]
    assert line == '{"role":"assistant","tool_call":{"arguments":{"n":1,"s":"é"},"id":"a","name":"f"},"tool_result":"another"}'
    assert canonical(json.loads(line)) == line


def test_depths_of_a_long_chain(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(200)]
    got = {r.call_id: r.depth for r in call_depths(spark.createDataFrame(chain, "call_id string, after string")).collect()}
    assert got == {str(i): i for i in range(200)}


def test_calls_of_nothing(spark):
    calls = spark.createDataFrame([], "conv_id long, turn long, call_id string, name string, arguments string, after string")
    assert format_calls(calls, spark.createDataFrame([], "call_id string, content string")).count() == 0


def test_every_turn_is_a_message(spark):
    turns = [
        (1, 0, "system", "rules"), (1, 1, "user", "é?"), (1, 2, "assistant", "a b c d e"), (1, 3, "user", None),
        (2, 0, "user", "alone"), (3, 0, "assistant", "a b c d e"), (3, 1, "assistant", "a b c d e"), (3, 1, None, "twice"),
        (None, 5, "assistant", "a b c d e"), (5, None, "assistant", "a b c d e"), (None, 6, "user", "unlinked"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = format_turns(df).collect()
    key = lambda rows: sorted(rows, key=str)
    assert key((r.conv_id, r.turn, r.role) for r in made) == key(t[:3] for t in turns)
    got = {(r.conv_id, r.turn, r.role): (r.status, r.call_id, json.loads(r.json)) for r in made}
    assert got[1, 1, "user"] == ("message", None, {"role": "user", "content": "é?"})
    assert got[1, 3, "user"] == ("result", "1:2", {"role": "user", "content": "", "tool_call_id": "1:2"})
    assert got[3, 1, None][:2] == ("result", "3:0") and got[3, 1, "assistant"][:2] == ("unanswered", "3:1")
    assert got[None, 5, "assistant"][:2] == got[5, None, "assistant"][:2] == ("unidentified", None)
    assert got[None, 6, "user"][:2] == ("message", None)
    assert all(canonical(json.loads(r.json)) == r.json for r in made)


def test_turns_without_a_place_share_no_id(spark):
    turns = [(None, 5, "assistant", "a b c d e"), (5, None, "assistant", "a b c d e"), (None, 6, "user", "no result")]
    calls, results = conversation_calls(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {(r.call_id, r.status) for r in format_calls(calls, results).collect()} == {(None, "unidentified")}


# --- pipeline ---


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    good = [" ".join(rng.choice(CLEAN) + rng.choice("abcdefgh") for _ in range(60)) + "." for _ in range(60)]
    item = " ".join(f"quiz{i}" for i in range(20))
    docs = [(i, t) for i, t in enumerate(good)]
    docs += [(100 + i, t) for i, t in enumerate(good[:10])] + [(200 + i, t + " tail") for i, t in enumerate(good[10:20])]
    docs += [(300, f"{good[20][:150]} {item}"), (301, f"token=abcdefghijklmnop {' '.join(reversed(good[21].split()))}")]
    docs += [(400 + i, " ".join(w + "$$$" for w in t.split())) for i, t in enumerate(good[30:55])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, 1 if i < 400 else 0, 0) for i, _ in docs]
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, folder).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        if k < 4:
            assert after.columns == df.columns
            kept.append({r.doc_id for r in after.collect()})
        df, before = after, df
    quality, single, clean, masked = kept
    assert quality == {i for i, _ in docs if i < 400}
    assert single == set(range(60)) | {300, 301}
    assert clean == masked == single - {300}
    text = {r.doc_id: r.text for r in before.collect()}
    assert text[301].startswith("[secret] ") and text[5] == good[5]
    assert {r.doc_id for r in df.collect()} == masked
    assert corpus_pipeline.run(spark, folder).count() == df.count()
