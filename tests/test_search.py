import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions.vectors import cosine_distance, hashed_embedding
from waymark.operators.cells import CellIndex, ann, recall
from waymark.operators.embed import (
    BatchProvider,
    BatchTooLarge,
    Response,
    embed,
    embed_batch,
    hashed_provider,
    token_total,
)
from waymark.operators.filetypes import TABLE_RULES, assign_type
from waymark.operators.knn import Asked, knn, query_chunks, scan
from waymark.operators.results import format_results, hydrate
from waymark.operators.sampling import seeded_sample
from waymark.plans.search import search, search_index
from waymark.plans.sync import sync
from waymark.session import fresh_path
from waymark.sources.index import IndexStore


def table(spark, name, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, vector array<float>")


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 8)).astype(np.float32)
    base[100:200] = base[0]  # a third of the rows are copies
    return base


def brute(points, queries, k):
    out = set()
    p = points.astype(np.float64)
    q = queries.astype(np.float64)
    d = 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T
    d = np.round(d, 6) + 0.0
    for i, row in enumerate(d):
        for rank, j in enumerate(sorted(range(len(row)), key=lambda j: (row[j], j))[:k], 1):
            out.add((i, rank, j, row[j]))
    return out


def as_set(df):
    return {(r.query_id, r["rank"], r.id, r.distance) for r in df.collect()}


@pytest.mark.parametrize("limit", [4096, 5])
def test_knn_matches_brute_force(spark, points, limit):
    index = table(spark, "id", points).repartition(5)
    queries = table(spark, "query_id", points[:40])
    assert as_set(knn(index, queries, 7, max_queries=limit)) == brute(points, points[:40], 7)


def test_knn_ignores_what_cannot_be_ranked(spark):
    index = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0]), ("e", [1.0, 1.0])],
        "id string, vector array<float>",
    )
    queries = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [2.0])], "query_id int, vector array<float>"
    )
    got = {(r.query_id, r.id) for r in knn(index, queries, 5).collect()}
    assert got == {(1, "a"), (1, "e"), (4, "d")}
    assert knn(index, queries.where("query_id = 9"), 5).count() == 0


def test_knn_equals_expression(spark, points):
    index = table(spark, "id", points[:50])
    queries = table(spark, "query_id", points[:3]).withColumnRenamed("vector", "q")
    pairs = index.join(queries, F.lit(True)).select(
        "query_id", "id", F.round(cosine_distance("vector", "q"), 6).alias("d")
    )
    want = {(r.query_id, r.id): r.d for r in pairs.collect()}
    got = knn(index, queries.withColumnRenamed("q", "vector"), 50).collect()
    assert len(got) == 150
    assert all(abs(want[r.query_id, r.id] - r.distance) < 2e-6 for r in got)


def test_filtered_knn_carries_payload(spark, points):
    index = table(spark, "id", points).withColumn("tag", F.col("id") % 3)
    got = knn(index.where("tag = 1"), table(spark, "query_id", points[:2]), 4, payload=("tag",)).collect()
    assert len(got) == 8 and {r.tag for r in got} == {1}


@pytest.mark.parametrize("limit", [4096, 10])
def test_ann_recall_and_completeness(spark, points, limit):
    index = table(spark, "id", points).repartition(4)
    queries = table(spark, "query_id", points[:60])
    found = ann(index, queries, 5)
    rows = found.collect()
    assert len(rows) == 300 and len({(r.query_id, r.id) for r in rows}) == 300
    assert recall(found, knn(index, queries, 5)).first().recall > 0.9


def test_all_cells_are_exact_search(spark, points, tmp_path):
    index = table(spark, "id", points).withColumn("tag", F.col("id") % 3)
    stored = CellIndex.build(index, str(tmp_path / "c"), 5, ("tag",))
    queries = table(spark, "query_id", points[:60])
    for limit in (4096, 10):
        found = stored.search(queries, 7, ("tag",), probes=10_000, max_queries=limit)
        assert as_set(found) == as_set(knn(index, queries, 7))
        assert found.columns == ["query_id", "rank", "id", "distance", "tag"]
    # One cell holds fewer rows than asked for: further ones are looked into.
    assert stored.search(queries, len(points), probes=1).groupBy("query_id").count().where(f"count <> {len(points)}").isEmpty()


def test_odd_vectors_in_cells(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0, None])]
    index = spark.createDataFrame([(*r, "x") for r in rows], "id int, vector array<float>, cell string")
    queries = spark.createDataFrame([(i, v) for i, v in rows], "query_id int, vector array<float>")
    stored = CellIndex.build(index, str(tmp_path / "c"), 2)
    assert {(r.query_id, r.id) for r in stored.search(queries, 5).collect()} == {(1, 1), (1, 5), (5, 1), (5, 5), (4, 4)}
    none = CellIndex.build(index.limit(0), str(tmp_path / "none"), 2)
    assert none.search(queries, 5).count() == 0
    assert CellIndex(spark, str(tmp_path / "c")).search(queries.limit(0), 5).count() == 0


def test_a_search_opens_the_probed_cells_only(spark, tmp_path):
    rng = np.random.default_rng(3)
    shares = []
    for n in (400, 3600):
        centres = rng.standard_normal((n // 40, 24))
        rows = centres[np.arange(n) % len(centres)] + rng.standard_normal((n, 24)) * 0.05
        index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id int, vector array<float>")
        stored = CellIndex.build(index, str(tmp_path / str(n)), 5)
        query = spark.createDataFrame([(1, rows[7].tolist())], "query_id int, vector array<float>")
        asked, wanted = stored._asked(query.collect(), 5, None)
        opened = stored.rows.where(wanted)
        files = lambda df: df.select(F.input_file_name()).distinct().count()
        assert files(opened) < files(stored.rows)
        plan = opened._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "ann_cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
        shares.append(opened.count() / n)
        assert as_set(stored.search(query, 5)) == as_set(knn(index, query, 5))
    assert shares[1] < shares[0] / 2


def test_query_chunks_do_not_move_the_index(spark, points):
    index, queries = table(spark, "id", points), table(spark, "query_id", points[:30])
    chunks = list(query_chunks(queries, 8))
    assert len(chunks) > 1 and sorted(r.query_id for c in chunks for r in c) == list(range(30))
    assert max(map(len, chunks)) <= 16
    asked = Asked([r.query_id for r in chunks[0]], [r.vector for r in chunks[0]])
    plan = scan(index, queries, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert as_set(knn(index, queries, 3, max_queries=8)) == as_set(knn(index, queries, 3))


def test_embed_batch_halves_keeps_order_and_counts():
    sizes = []

    def call(texts, kind):
        sizes.append(len(texts))
        if len(texts) > 3:
            raise BatchTooLarge("max")
        return Response([[float(t)] for t in texts], len(texts))

    got = list(embed_batch(call, [str(i) for i in range(10)], "document"))
    assert [r[0][0] for r in got] == list(range(10))
    assert sum(r[1] or 0 for r in got) == 10 and max(sizes) == 10


def test_embed_statuses(spark):
    def call(texts, kind):
        if "boom" in texts:
            raise RuntimeError("service down")
        if "huge" in texts:
            raise BatchTooLarge("too large")
        vectors = [None if t == "odd" else [1.0 if kind == "query" else 2.0] for t in texts]
        return Response(vectors[:-1] if "short" in texts else vectors)

    def statuses(texts):
        df = spark.createDataFrame([(t,) for t in texts], "content string").coalesce(1)
        rows = embed(df, BatchProvider("p", call, 4)).collect()
        return [(r.content, r.status) for r in rows]

    assert statuses(["a", None, "odd"]) == [("a", "ok"), ("odd", "no_vector")]
    assert statuses(["a", "huge", "b"]) == [("a", "ok"), ("huge", "failed"), ("b", "ok")]
    assert statuses(["short", "a", "b"])[-1] == ("b", "short_response")
    five = dict(statuses(["boom", "a", "b", "c", "d"]))
    assert five == {"boom": "failed", "a": "failed", "b": "failed", "c": "failed", "d": "ok"}
    none = embed(spark.createDataFrame([("a",)], "content string"), BatchProvider("p", call))
    assert token_total(none).first().n_tokens is None
    with pytest.raises(ValueError):
        embed(none, hashed_provider(), "other")


def test_hashed_embedding(spark):
    df = spark.createDataFrame([("a B a",), ("12 !",), (None,)], "t string")
    rows = [r[0] for r in df.select(hashed_embedding(F.col("t"), 32)).collect()]
    assert rows[1] is None and rows[2] is None
    assert abs(sum(x * x for x in rows[0]) - 1) < 1e-6 and sorted(rows[0])[-2:] == pytest.approx([0.4472136, 0.8944272])


def test_format_results(spark):
    hits = spark.createDataFrame(
        [("/project/src/main.rs", 10, 0.12345, "fn main() {\n  x\n}"), ("/other/a", 1, None, None)],
        "path string, start_line int, distance double, content string",
    )
    lines = lambda scores: [r.line for r in format_results(hits, "/project", scores).collect()]
    assert lines(False) == ["src/main.rs:10:fn main() {", "/other/a:1:[no content]"]
    assert lines(True)[0].startswith("src/main.rs:10:0.123") and lines(True)[1] == "/other/a:1:n/a:[no content]"


def test_hydrate(spark, make_corpus):
    hits = spark.createDataFrame(
        [("a", 2, 3, "x"), ("a", 9, 9, "x"), ("gone", 1, 1, "x")],
        "path string, start_line int, end_line int, file_hash string",
    )
    for bound in (None, 3):
        rows = hydrate(hits, make_corpus({"a": "1\r\n2\r\n3\n"}), bound).collect()
        got = {(r.path, r.start_line): (r.content, r.stale) for r in rows}
        assert got == {("a", 2): ("2\n3", True), ("a", 9): (None, True), ("gone", 1): (None, True)}


def test_seeded_sample(spark, monkeypatch):
    from waymark.operators import sampling

    df = spark.range(2000).select(F.col("id").cast("string").alias("id"))
    ids = lambda d: sorted(r.id for r in d.collect())
    small = ids(seeded_sample(df, 500, "s"))
    assert len(small) == 500 and small == ids(seeded_sample(df.repartition(7), 500, "s"))
    assert small != ids(seeded_sample(df, 500, "t")) and len(ids(seeded_sample(df, 9999, "s"))) == 2000
    monkeypatch.setattr(sampling, "MAX_TOP", 3)
    monkeypatch.setattr(sampling, "PREFIX", 1)
    for n in (4, 500, 1999, 2000, 2001):
        large = ids(seeded_sample(df, n, "s"))
        assert len(large) == min(n, 2000)
        if n == 500:
            assert large == small


def test_search_end_to_end(spark, make_corpus):
    corpus = assign_type(
        make_corpus(
            {
                "/r/a.rs": "// parse json text\nfn parse() { json }\n\nfn other() { network }\n",
                "/r/b.prose": "open network socket\n\nparse json",
            }
        ),
        TABLE_RULES,
    )
    queries = spark.createDataFrame(
        [(1, "parse json"), (2, "   "), (3, "!!")], "query_id int, query string"
    )
    store = IndexStore(spark, fresh_path(spark, "index"))
    provider = hashed_provider()
    with pytest.raises(ValueError):
        search(store, "n", queries, corpus, provider, refresh=False)
    found = search(
        store, "n", queries, corpus, provider, types=("rust", "prose"), root="/r", k=2, scores=True
    ).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"] or 0)):
        by_query.setdefault(r.query_id, []).append(r)
    assert [r.line for r in by_query[1]][0] == "b.prose:3:0.0000:parse json"
    assert by_query[1][1].path == "/r/a.rs" and not by_query[1][1].stale
    assert [r.status for r in by_query[2] + by_query[3]] == ["empty_query", "no_vector"]
    same = search(store, "n", queries, corpus, provider, refresh=False, k=2, approximate=True)
    assert same.where("status = 'ok'").count() == 2
    only = search_index(
        store.read("n", vectors=True), queries, corpus, provider, k=5, where=F.col("path") == "/r/a.rs"
    )
    assert {r.path for r in only.where("status = 'ok'").collect()} == {"/r/a.rs"}
    assert not sync(store, "n", corpus, provider, ("rust", "prose")).changed


def test_the_nearest_of_two_near_ties_wins(spark):
    index = spark.createDataFrame([(1, [1.0, 0.001]), (2, [1.0, 0.0])], "id int, vector array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, vector array<float>")
    (hit,) = knn(index, asked, 1).collect()
    assert (hit.id, hit.distance) == (2, 0.0)
    (hit,) = ann(index, asked, 1).collect()
    assert hit.id == 2
