"""How the registered queries deal out their input."""

from pyspark.sql import Row

from waymark.operators.knn import JOB_CHUNKS, MAX_BROADCAST_BYTES, MAX_BROADCAST_QUERIES, chunk_groups, query_chunks, shared_passes
from workload import queries
from workload import tables as t
from workload.oracles import ORACLES as queries_sql


def test_queries_are_every_vector(spark, tmp_path):
    rows = [(i, [float(i), 1.0], 0) for i in range(-50, 151)] + [(None, [1.0, 1.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = [r.query_id for r in t.vector_queries(spark, str(tmp_path)).collect()]
    assert None in found and sorted(q for q in found if q is not None) == list(range(-50, 151))
    assert t.vectors(spark, str(tmp_path)).count() == 202


def test_short_responses_are_not_dealt_into_a_fixed_number_of_tasks(spark, tmp_path):
    spark.createDataFrame([(i, "x" * i) for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.short_responses(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "REPARTITION_BY_NUM" not in plan


def test_arrivals_are_as_many_batches_as_asked_for(spark, tmp_path):
    spark.range(0, 100, 1, 6).write.parquet(f"{tmp_path}/in")

    def sizes(batches):
        seen = []
        stream = queries._arriving(spark, f"{tmp_path}/in", batches)
        writer = stream.writeStream.foreachBatch(lambda df, k: seen.append(df.count())).trigger(availableNow=True)
        writer.option("checkpointLocation", f"{tmp_path}/at-{batches}").start().awaitTermination()
        return seen

    assert sizes(1) == [100]
    assert len(sizes(2)) == 2 and len(sizes(4)) == 3 and len(sizes(8)) == 6


def test_chunks_of_queries_share_jobs():
    chunk = lambda n, width: [Row(query_id=i, vector=[0.0] * width) for i in range(n)]
    few = list(chunk_groups(iter([chunk(3, 2)] * (JOB_CHUNKS + 1))))
    assert [len(g) for g in few] == [JOB_CHUNKS, 1]
    half = MAX_BROADCAST_BYTES // 16
    assert [len(g) for g in chunk_groups(iter([chunk(1, half)] * 3))] == [2, 1]
    assert not list(chunk_groups(iter([])))


def test_every_vector_asks_in_every_search(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], 3) for i in range(1, 141)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("knn_exact", "knn_filtered", "knn_blocks", "ann_search"):
        found = queries.QUERIES[name](spark, str(tmp_path)).groupBy("query_id").count().collect()
        assert {r.query_id for r in found} == set(range(1, 141)), name
        assert {r["count"] for r in found} == {20 if name == "knn_exact" else 5}
    assert queries.QUERIES["ann_recall"](spark, str(tmp_path)).first().n_exact == 140 * 5
    for sql in (queries_sql[n] for n in ("knn_exact", "knn_filtered", "knn_blocks", "ann_search", "ann_recall")):
        assert "% 50" not in sql


def test_small_chunks_of_queries_share_a_pass(spark):
    asked = spark.range(900).selectExpr("id AS query_id", "array(double(id), 1D) AS vector")
    chunks = list(query_chunks(asked, 10))
    assert len(chunks) > 80 and sorted(q.query_id for c in chunks for q in c) == list(range(900))
    assert [len(p) for p in shared_passes(iter(chunks))] == [900]
    many = [[Row(query_id=0, vector=[1.0])] * 3000] * 3
    assert [len(p) for p in shared_passes(iter(many))] == [3000] * 3 and 3000 < MAX_BROADCAST_QUERIES
