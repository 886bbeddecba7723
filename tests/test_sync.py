import pytest
from pyspark.sql import functions as F

from waymark.functions.hashing import unit_id
from waymark.operators import diff
from waymark.operators.embed import BatchProvider, BatchTooLarge, Response, hashed_provider
from waymark.operators.filetypes import assign_type
from waymark.plans.sync import rebuild, sync
from waymark.schema import INDEX_COLUMNS
from waymark.session import fresh_path
from waymark.sources.index import IndexStore, StaleVersion, keyset_page, upload_projection
from waymark.streaming.continuous import batch_token, continuous_sync, stream_start

# (path, file_hash, chunk_hash) rows of the two sides, and the changed paths.
CASES = {
    "empty": ([], [], [], []),
    "all new": ([("1.rs", 123, 456), ("2.py", 789, 101)], [], ["1.rs", "2.py"], []),
    "file changed": ([("1.rs", 123, 456)], [("1.rs", 999, 456)], ["1.rs"], ["1.rs"]),
    "mixed": (
        [("1.rs", 123, 456), ("2.py", 789, 101), ("3.go", 111, 222)],
        [("1.rs", 999, 456), ("3.go", 111, 222), ("4.js", 333, 444)],
        ["1.rs", "2.py"],
        ["1.rs", "4.js"],
    ),
    "identical": ([("1.rs", 1, 2), ("2.py", 3, 4)], [("1.rs", 1, 2), ("2.py", 3, 4)], [], []),
    "chunk changed": ([("1.rs", 123, 999)], [("1.rs", 123, 456)], ["1.rs"], ["1.rs"]),
    "replacement": (
        [("n1.js", 700, 800), ("n2.ts", 900, 1000)],
        [("o1.rs", 100, 200), ("o2.py", 300, 400), ("o3.go", 500, 600)],
        ["n1.js", "n2.ts"],
        ["o1.rs", "o2.py", "o3.go"],
    ),
}


@pytest.fixture(scope="module")
def rows(spark):
    def make(items):
        df = spark.createDataFrame(
            [(p, 1, 10, str(f), str(c)) for p, f, c in items],
            "path string, start_line int, end_line int, file_hash string, chunk_hash string",
        )
        return df.withColumn("id", unit_id())

    return make


def paths(df):
    return sorted(r.path for r in df.collect())


@pytest.mark.parametrize("case", CASES)
def test_diff_sets_and_round_trip(rows, case):
    local, index, upload, delete = CASES[case]
    local, index = rows(local), rows(index)
    up, gone = diff.upload_set(local, index), diff.delete_set(local, index)
    assert paths(up) == upload and paths(gone) == delete
    actions = diff.diff_actions(local, index)
    counts = diff.sync_counts(actions).first()
    assert (counts.n_upload, counts.n_delete) == (len(upload), len(delete))
    assert counts.changed == bool(upload or delete)
    for by in ("id", "path"):
        after = diff.apply_diff(index, up, gone, by)
        assert not diff.sync_counts(diff.diff_actions(local, after)).first().changed
        again = diff.apply_diff(after, up, gone, by)
        assert sorted(r.id for r in again.collect()) == sorted(r.id for r in after.collect())


def test_delete_by_path_takes_current_rows_too(rows):
    index = rows([("a", 1, 1), ("a", 1, 2), ("b", 1, 1)])
    gone = rows([("a", 1, 1)])
    assert paths(diff.drop_paths(index, diff.stale_paths(gone))) == ["b"]
    assert paths(diff.rows_on_paths(index, diff.stale_paths(gone))) == ["a", "a"]
    none = rows([])
    assert paths(diff.apply_diff(index, none, gone, "id")) == ["a", "b"]
    with pytest.raises(ValueError):
        diff.apply_diff(index, none, gone, "other")


def test_duplicate_upserts_become_one_row(rows):
    twice = rows([("a", 1, 1), ("a", 1, 1)])
    assert diff.apply_diff(rows([]), twice, rows([])).count() == 1


def test_keyset_pages_cover_everything(rows):
    df = rows([(f"f{i}", i, i) for i in range(25)])
    seen, after = [], None
    while True:
        page = [r.id for r in keyset_page(df, after, 10).collect()]
        seen += page
        if len(page) < 10:
            break
        after = page[-1]
    assert seen == sorted(r.id for r in df.collect())


def corpus_of(make_corpus, files):
    return assign_type(make_corpus(files))


def fn(name, body="1"):
    return f"fn {name}() {{ {body} }}\n"


FIRST = {"keep.rs": fn("keep"), "modify.rs": fn("modify"), "delete.rs": fn("gone") + fn("gone2")}
SECOND = {"keep.rs": fn("keep"), "modify.rs": fn("modify", "2"), "new.rs": fn("new")}


def index_paths(store, ns, version=None):
    return paths(store.read(ns, version))


@pytest.fixture
def store(spark):
    return IndexStore(spark, fresh_path(spark, "index"))


@pytest.mark.parametrize("by", ["id", "path"])
def test_sync_round_trip(store, make_corpus, by):
    provider = hashed_provider(16)
    report = sync(store, "n", corpus_of(make_corpus, FIRST), provider, ("rust",), by)
    assert (report.version, report.changed, report.n_upload, report.n_delete) == (1, True, 4, 0)
    report = sync(store, "n", corpus_of(make_corpus, SECOND), provider, ("rust",), by)
    assert (report.version, report.n_upload, report.n_delete) == (2, 2, 3)
    assert index_paths(store, "n") == ["keep.rs", "modify.rs", "new.rs"]
    # The pinned earlier version still reads as it was.
    assert index_paths(store, "n", 1) == ["delete.rs", "delete.rs", "keep.rs", "modify.rs"]
    unchanged = sync(store, "n", corpus_of(make_corpus, SECOND), provider, ("rust",), by)
    assert unchanged[:5] == (2, False, 0, 0, {})
    assert store.read("n").columns == [c for c in INDEX_COLUMNS if c != "vector"]
    assert store.read("n", vectors=True).where("size(vector) = 16").count() == 3


def test_delete_only_and_back_again(store, make_corpus):
    provider = hashed_provider(16)
    sync(store, "n", corpus_of(make_corpus, FIRST), provider, ("rust",))
    report = sync(store, "n", corpus_of(make_corpus, {"keep.rs": fn("keep")}), provider, ("rust",))
    assert report.changed and report.n_upload == 0 and report.n_delete == 3
    assert index_paths(store, "n") == ["keep.rs"]
    # The same ids come back after having been dropped.
    sync(store, "n", corpus_of(make_corpus, FIRST), provider, ("rust",))
    assert len(index_paths(store, "n")) == 4
    before = store.segments("n")
    store.compact("n")
    assert len(index_paths(store, "n")) == 4 and store.segments("n") == 1 < before


def test_missing_and_reset_namespace(store, make_corpus):
    assert store.version("n") is None and store.read("n").count() == 0
    assert store.reset("n") is None
    corpus = corpus_of(make_corpus, FIRST)
    sync(store, "n", corpus, hashed_provider(16), ("rust",))
    assert store.read("other").count() == 0
    store.reset("n")
    assert store.read("n").count() == 0
    report = rebuild(store, "n", corpus, hashed_provider(16), ("rust",))
    assert report.n_upload == 4 and len(index_paths(store, "n")) == 4


def test_publish_replaces_by_id_and_replays_once(spark, store, rows):
    times = F.lit(None).cast("timestamp")
    base = rows([("a", 1, 1)]).withColumn("file_mtime", times).withColumn("file_ctime", times)
    chunk = upload_projection(base)
    store.publish("n", chunk, token="t1")
    assert store.publish("n", chunk, token="t1") == 1
    store.publish("n", chunk.withColumn("vector", F.array(F.lit(1.0).cast("float"))), token="t2")
    got = store.read("n", vectors=True).collect()
    assert [list(r.vector) for r in got] == [[1.0]]
    # A writer that lost the race fails instead of overwriting the version.
    folder_state = store._commits("n")
    with pytest.raises(Exception):
        store._commit("n", folder_state[-1])


def test_failed_units_are_retried(store, make_corpus):
    down = {"yes": True}

    def flaky(texts, kind):
        if any("modify" in t for t in texts):
            raise BatchTooLarge("no")
        return Response([[1.0] for _ in texts], len(texts))

    def fine(texts, kind):
        return Response([[2.0] for _ in texts])

    corpus = corpus_of(make_corpus, FIRST)
    report = sync(store, "n", corpus, BatchProvider("p", flaky), ("rust",))
    assert report.statuses == {"ok": 3, "failed": 1} and down["yes"]
    assert index_paths(store, "n") == ["delete.rs", "delete.rs", "keep.rs"]
    report = sync(store, "n", corpus, BatchProvider("p", fine), ("rust",))
    assert report.statuses == {"ok": 1} and report.n_delete == 0
    assert len(index_paths(store, "n")) == 4
    assert not sync(store, "n", corpus, BatchProvider("p", fine), ("rust",)).changed


def test_continuous_sync(spark, store, make_corpus):
    folder, checkpoint = fresh_path(spark, "arrivals"), fresh_path(spark, "progress")
    provider = hashed_provider(16)

    def arrive(files, second):
        rows = make_corpus(files).withColumn("mtime", F.timestamp_seconds(F.lit(second)))
        rows.coalesce(1).write.mode("append").parquet(folder)

    def drain():
        stream = spark.readStream.schema(
            "path string, content string, size long, mtime timestamp, ctime timestamp"
        ).parquet(folder)
        continuous_sync(
            stream, store, "n", provider, checkpoint, ("rust",), True, add_types=assign_type
        ).awaitTermination()

    arrive(FIRST, 1)
    drain()
    assert len(index_paths(store, "n")) == 4
    arrive({"modify.rs": fn("stale")}, 2)
    arrive({"modify.rs": fn("modify", "2"), "new.rs": fn("new")}, 3)
    drain()
    assert index_paths(store, "n") == ["delete.rs", "delete.rs", "keep.rs", "modify.rs", "new.rs"]
    version = store.version("n")
    drain()
    assert store.version("n") == version
    # A replayed batch publishes nothing.
    replay = sync(
        store, "n", corpus_of(make_corpus, {"x.rs": fn("x")}), provider, ("rust",), partial=True,
        token=batch_token(stream_start(store, "n", checkpoint)[0], 0),
    )
    assert not replay.changed and store.version("n") == version


# --- sync state is neither lost nor repeated ---


@pytest.fixture
def arrivals(spark, store, make_corpus):
    """(arrive(files, second), drain(checkpoint)) of a stream into the store."""
    folder = fresh_path(spark, "arrivals")

    def arrive(files, second):
        rows = make_corpus(files).withColumn("mtime", F.timestamp_seconds(F.lit(second)))
        rows.coalesce(1).write.mode("append").parquet(folder)

    def drain(checkpoint, provider=hashed_provider(16)):
        stream = spark.readStream.schema(
            "path string, content string, size long, mtime timestamp, ctime timestamp"
        ).parquet(folder)
        continuous_sync(
            stream, store, "n", provider, checkpoint, ("rust",), True, add_types=assign_type
        ).awaitTermination()

    return arrive, drain


def test_a_second_stream_is_no_replay(spark, store, arrivals):
    arrive, drain = arrivals
    arrive({"a.rs": fn("a")}, 1)
    drain(fresh_path(spark, "one"))
    arrive({"b.rs": fn("b")}, 1)
    drain(fresh_path(spark, "other"))
    assert index_paths(store, "n") == ["a.rs", "b.rs"]


def test_late_arrivals_do_not_win(spark, store, arrivals):
    arrive, drain = arrivals
    checkpoint = fresh_path(spark, "late")
    arrive({"a.rs": fn("new"), "blank.rs": "\n"}, 2000)
    drain(checkpoint)
    arrive({"a.rs": fn("old"), "blank.rs": fn("was")}, 1000)
    drain(checkpoint)
    times = {r.t for r in store.read("n").select(F.unix_timestamp("file_mtime").alias("t")).collect()}
    assert times == {2000} and index_paths(store, "n") == ["a.rs"]


def test_retries_survive_other_batches(spark, store, make_corpus):
    def flaky(texts, kind):
        if any("bad" in t for t in texts):
            raise BatchTooLarge("no")
        return Response([[1.0] for _ in texts])

    fine = BatchProvider("p", lambda texts, kind: Response([[2.0] for _ in texts]))
    first = {"a.rs": fn("good") + fn("bad")}
    second = {"b.rs": fn("other")}
    sync(store, "n", corpus_of(make_corpus, first), BatchProvider("p", flaky), ("rust",), partial=True)
    sync(store, "n", corpus_of(make_corpus, second), BatchProvider("p", flaky), ("rust",), partial=True)
    assert [r.path for r in store.retry_paths("n").collect()] == ["a.rs"]
    store.compact("n")
    report = sync(store, "n", corpus_of(make_corpus, first | second), fine, ("rust",))
    assert report.statuses == {"ok": 1} and store.retry_paths("n").count() == 0
    assert index_paths(store, "n") == ["a.rs", "a.rs", "b.rs"]


def test_still_failing_units_publish_nothing_new(store, make_corpus):
    def down(texts, kind):
        raise ValueError("down")

    corpus = corpus_of(make_corpus, {"a.rs": fn("a")})
    first = sync(store, "n", corpus, BatchProvider("p", down), ("rust",))
    again = sync(store, "n", corpus, BatchProvider("p", down), ("rust",))
    assert (first.version, again.version, again.changed) == (1, 1, False)


def test_units_without_a_vector_are_done(store, make_corpus):
    corpus = corpus_of(make_corpus, {"a.rs": "fn f() { 1 }\n", "blank.rs": "// 1\n", "empty.rs": "\n"})
    provider = BatchProvider("p", lambda texts, kind: Response([None for _ in texts]))
    first = sync(store, "n", corpus, provider, ("rust",))
    assert first.version == 1 and not first.changed and set(first.statuses) == {"no_vector"}
    for _ in range(2):
        assert sync(store, "n", corpus, provider, ("rust",))[:5] == (1, False, 0, 0, {})


def test_a_removed_file_comes_back(store, make_corpus):
    provider = hashed_provider(16)
    both, one = {"a.rs": fn("a"), "b.rs": fn("b")}, {"a.rs": fn("a")}
    for files in (both, one, both):
        assert sync(store, "n", corpus_of(make_corpus, files), provider, ("rust",)).changed
        assert index_paths(store, "n") == sorted(files)


def test_publish_on_a_stale_diff_fails(store, rows):
    times = F.lit(None).cast("timestamp")
    chunk = upload_projection(rows([("a", 1, 1)]).withColumn("file_mtime", times).withColumn("file_ctime", times))
    store.publish("n", chunk, expected=None)
    with pytest.raises(StaleVersion):
        store.publish("n", chunk, expected=None)
    assert store.publish("n", chunk, expected=1) == 2 and store.read("n").count() == 1
