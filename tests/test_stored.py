"""Stored index: plans of its reads, pages, cells; single sources; streams that begin again."""

import time

import pytest
from pyspark.sql import functions as F

from waymark.operators.embed import BatchProvider, Response, embed, hashed_provider
from waymark.operators.filetypes import assign_type
from waymark.operators.knn import knn
from waymark.plans.search import PAYLOAD, search, search_cells
from waymark.plans.sync import sync
from waymark.session import fresh_path, temporary
from waymark.sources.corpus import FileSource, TableSource
from waymark.sources.index import IndexStore
from waymark.streaming.continuous import continuous_sync

PROVIDER = hashed_provider(16)


def rows(spark, names, vector=(1.0, 0.0)):
    made = spark.createDataFrame([(n, f"/{n}", 1, 2, "h", "c", [float(len(n)), *vector]) for n in names], "id string, path string, start_line int, end_line int, file_hash string, chunk_hash string, vector array<float>")
    return made.withColumns({c: F.lit(None).cast("timestamp") for c in ("file_mtime", "file_ctime")})


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.fixture
def store(spark):
    return IndexStore(spark, fresh_path(spark, "index"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_read_moves_no_row(spark, store):
    store.publish("n", rows(spark, "abcdef"), unique=True)
    store.publish("n", rows(spark, "xyz"), delete_ids=rows(spark, "ab"), unique=True, replace=False)
    store.publish("n", gone_paths=rows(spark, "cx"))
    read = store.read("n", vectors=True)
    assert ids(read) == list("defyz")
    plan = plan_of(read)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    # A path that is dropped and comes back in one version is there.
    store.publish("n", rows(spark, "d"), gone_paths=rows(spark, "d"), replace=False)
    assert ids(store.read("n")) == list("defyz") and not store.crowded("n")


def test_pages_open_few_files(spark, store):
    names = [f"{i:04d}" for i in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.publish("n", rows(spark, names))
        store.compact("n")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ranges = spark.read.parquet(f"{store.base}/n/ranges/*")
    assert ranges.count() > 2
    store.publish("n", rows(spark, ["0100x"]), delete_ids=rows(spark, ["0101", "1999"]), unique=True, replace=False)
    live = sorted({*names, "0100x"} - {"0101", "1999"})
    assert [r.id for r in store.page("n", "0099", 5).collect()] == ["0100", "0100x", "0102", "0103", "0104"]
    seen, after = [], None
    while page := [r.id for r in store.page("n", after, 700).collect()]:
        seen, after = seen + page, page[-1]
    assert seen == live
    first = store._rows(store._live(store._commits("n"), None), [ranges.orderBy("low").first().file])
    every = {r.file for r in ranges.select("file").collect()}
    assert len(every & set(first.inputFiles())) == 1 < len(every)


def test_cells_of_an_earlier_version_and_what_came_since(spark, store):
    names = [f"{i:03d}" for i in range(120)]
    vary = lambda df: df.withColumn("vector", F.array(F.col("id").cast("int") % 11, F.col("id").cast("int") % 7, F.lit(1)).cast("array<float>"))
    store.publish("n", vary(rows(spark, names)))
    asked = store.read("n", vectors=True).limit(9).select(F.col("id").alias("query_id"), "vector")
    exact = lambda: {(r.query_id, r["rank"], r.id) for r in knn(store.read("n", vectors=True), asked, 4, PAYLOAD).collect()}
    built, at = store.cells("n", 1, PAYLOAD)
    assert at == 1 and built.n_rows == 120
    store.publish("n", vary(rows(spark, ["500", "501"])), delete_ids=rows(spark, ["003", "004"]), unique=True, replace=False)
    again, at = store.cells("n", 2, PAYLOAD)
    assert at == 1 and again.path == built.path
    got = {(r.query_id, r["rank"], r.id) for r in search_cells(store, "n", 2, asked, 4).collect()}
    assert {r[:2] for r in got} == {r[:2] for r in exact()} and len(got & exact()) >= 0.9 * len(got)
    assert not {"003", "004"} & {r[2] for r in got}
    # Too much has changed, or the index was reset: built again.
    store.publish("n", vary(rows(spark, [f"6{i:02d}" for i in range(50)])))
    assert store.cells("n", 3, PAYLOAD)[1] == 3
    store.reset("n")
    assert store.cells("n", 4, PAYLOAD)[0].n_rows == 0


def test_a_search_opens_the_files_of_its_hits(spark, store, tmp_path, monkeypatch):
    for k in range(40):
        (tmp_path / f"f{k}.rs").write_text(f"fn name{k}() {{ {k} }}\n")
    source = FileSource(spark, str(tmp_path))
    queries = spark.createDataFrame([(1, "name7"), (2, "name9")], "query_id int, query string")
    found = search(store, "n", queries, source, PROVIDER, root=str(tmp_path), k=2).collect()
    assert len(found) == 4 and all(r.line.startswith("f") and r.stale is False for r in found)
    hits = spark.createDataFrame([(f"{tmp_path}/f7.rs",), (f"{tmp_path}/gone.rs",)], "path string")
    assert [r.content for r in source.open(hits, 2).collect()] == ["fn name7() { 7 }\n"]
    table = TableSource(spark, str(tmp_path / "table"), 16).write(source.files)
    opened = table.open(hits, 2)
    assert [r.content for r in opened.collect()] == ["fn name7() { 7 }\n"] and "PartitionFilters: [bucket" in plan_of(opened)
    again = search(store, "n", queries, table, PROVIDER, refresh=False, root=str(tmp_path), k=2, approximate=True).collect()
    assert {(r.query_id, r.line) for r in again} == {(r.query_id, r.line) for r in found}


def test_sync_reads_the_corpus_twice_and_leaves_nothing(spark, store, make_corpus):
    shared = spark.conf.get("spark.checkpoint.dir")
    listed = lambda: {n for s in _folder(spark, shared) if not (n := s.getPath().getName()).startswith("index-")}
    reads = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    files = make_corpus({"a.rs": "fn a() { 1 }\n", "b.py": "def b():\n    return 1\n", "e.go": "", "c.txt": "no type"})
    corpus = assign_type(files.coalesce(1).mapInPandas(look, files.schema))
    typed = corpus.unionByName(files.where("path = 'c.txt'").withColumn("type", F.lit(None).cast("string")))
    before = listed()
    report = sync(store, "n", typed, PROVIDER)
    assert reads.value <= 2 * 4 and listed() <= before
    assert report.statuses == {"ok": 2} and report.left_out == {"empty": 1, "too_large": 0, "type": 1}
    assert not any(report.broken.values())
    assert sync(store, "n", typed, PROVIDER, max_bytes=5).left_out["too_large"] == 3


def _folder(spark, path):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)


def test_temporary_paths_go(spark):
    with temporary(spark):
        path = fresh_path(spark, "gone")
        spark.range(3).write.parquet(path)
        with temporary(spark):
            inner = fresh_path(spark, "inner")
            spark.range(3).write.parquet(inner)
        assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(inner)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_a_batch_reads_no_index_row_and_a_stream_begins_again(spark, store, make_corpus, monkeypatch):
    folder, checkpoint = fresh_path(spark, "arrivals"), fresh_path(spark, "progress")

    def arrive(files, second, op=None):
        made = make_corpus(files).withColumn("mtime", F.timestamp_seconds(F.lit(second))).withColumn("op", F.lit(op).cast("string"))
        made.coalesce(1).write.mode("append").parquet(folder)

    def drain():
        stream = spark.readStream.schema("path string, content string, size long, mtime timestamp, ctime timestamp, op string").parquet(folder)
        continuous_sync(stream, store, "n", PROVIDER, checkpoint, ("rust",), True, add_types=assign_type, state_buckets=3).awaitTermination()

    sync(store, "n", assign_type(make_corpus({"old.rs": "fn old() { 1 }\n"})), PROVIDER, ("rust",))
    arrive({"a.rs": "fn a() { 1 }\n", "b.rs": "fn b() { 1 }\n"}, 10)
    drain()
    reads = []
    known = IndexStore._rows
    monkeypatch.setattr(IndexStore, "_rows", lambda self, *a, **k: reads.append(a) or known(self, *a, **k))
    # Begun again: changed, removed, unchanged, and one of the index it was begun from.
    arrive({"a.rs": "fn a() { 2 }\n", "old.rs": "fn old() { 2 }\n"}, 20)
    arrive({"b.rs": ""}, 21, "delete")
    drain()
    arrive({"b.rs": "fn b() { 0 }\n", "a.rs": "fn a() { 2 }\n"}, 15)
    drain()
    assert reads == []
    assert sorted(r.path for r in store.read("n").collect()) == ["a.rs", "old.rs"]
    # Something else publishes: batches are compared with the index from then on.
    sync(store, "n", assign_type(make_corpus({"c.rs": "fn c() { 1 }\n"})), PROVIDER, ("rust",), partial=True)
    arrive({"c.rs": "fn c() { 2 }\n", "a.rs": "fn a() { 3 }\n"}, 30)
    arrive({"old.rs": ""}, 31, "delete")
    drain()
    assert reads and sorted(r.path for r in store.read("n").collect()) == ["a.rs", "c.rs"]


def test_calls_in_flight(spark):
    def slow(texts, kind):
        time.sleep(0.1)
        return Response([[float(t)] for t in texts], len(texts))

    docs = spark.range(64).select(F.col("id").cast("string").alias("content")).coalesce(1).cache()
    docs.count()
    spent, found = {}, {}
    for n in (1, 8):
        begin = time.time()
        got = embed(docs, BatchProvider("slow", slow, 2, n)).collect()
        spent[n] = time.time() - begin
        found[n] = sorted((r.content, r.vector[0], r.status) for r in got)
        assert sum(r.n_tokens or 0 for r in got) == 64
    assert found[1] == found[8] and spent[8] < spent[1] / 2
