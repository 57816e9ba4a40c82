"""Retrieval: plans that do not depend on the file layout, no vector through
the driver, exact fusion on canonical ids."""

from __future__ import annotations

import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.operators import dense, hybrid, lexical
from tessera.sources.jsonl import scratch_path

DOCS = [(i, "", f"alpha beta {'gamma ' * (i % 5)} w{i % 7} word{i}", "s") for i in range(64)]
DOC_SCHEMA = "doc_id long, question string, content string, source string"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("files", [1, 64])
@pytest.mark.parametrize("loaded", [False, True])
def test_scored_pairs_are_never_exchanged(spark, files, loaded):
    path = scratch_path(spark, "docs")
    spark.createDataFrame(DOCS, DOC_SCHEMA).repartition(files).write.parquet(path)
    index = lexical.build_bm25_index(spark.read.parquet(path))
    if loaded:
        at = scratch_path(spark, "index")
        lexical.write_index(index, at)
        index = lexical.load_index(spark, at, spark.read.parquet(path))
    queries = spark.createDataFrame([(1, "alpha w3"), (2, "beta gamma")], "query_id long, query string")
    scores = lexical.bm25_scores(index, queries)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id#\d+L?", plan_of(scores))
    assert scores.count() == 128
    index.release()


def test_worked_example_of_the_fusion(spark):
    """Content 1 in both lists (8.5 and 0.92), 2 by words only (7.0), 3 by vector only (0.85)."""
    bm = spark.createDataFrame([(1, 1, 10, 8.5), (1, 2, 20, 7.0)], "query_id long, canon long, doc_id long, bm25_score double")
    vec = spark.createDataFrame([(1, 1, 11, 0.92), (1, 3, 30, 0.85)], "query_id long, canon long, doc_id long, vector_score double")
    got = [(r.doc_id, round(r.hybrid_score, 2), r.search_method, r["rank"])
           for r in hybrid.fuse(bm, vec, 10).orderBy("rank").collect()]
    assert got == [(10, 4.81, "hybrid", 1), (20, 4.2, "bm25", 2), (30, 0.51, "vector", 3)]


def test_equal_contents_fuse_to_one_result(spark):
    docs = spark.createDataFrame([(1, "", "red apple", "s"), (2, "", "red apple", "s"), (3, "", "blue sky", "s"),
                                  (4, "", "green field", "s")], DOC_SCHEMA)
    index = lexical.build_bm25_index(docs)
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1]), (4, None)],
                                    "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, "red apple")], "query_id long, query string")
    qv = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query_vec array<double>")
    got = {r.canon: r.search_method for r in hybrid.hybrid_search(queries, index, vectors, qv).collect()}
    assert got == {1: "hybrid", 3: "vector"}
    index.release()


def test_many_queries_keep_the_plan_small(spark):
    rng = np.random.default_rng(0)
    q = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(5000)], "query_id long, query_vec array<double>")
    p = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "point_id long, embedding array<double>")
    few = dense.dense_candidates(q.limit(3), p, 2, None, query_block=16)
    many = dense.dense_candidates(q, p, 2, None, query_block=16)
    assert plan_of(few).count("MapInArrow") == plan_of(many).count("MapInArrow") == 1
    assert many.count() == 10_000


def test_null_vectors_and_composite_keys(spark):
    q = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, None), (2, 0, [0.0, 1.0])],
                              "request_id long, vector_idx long, query_vec array<double>")
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "point_id long, embedding array<double>")
    got = dense.multi_vector_search(q, p, 4).collect()
    assert sorted((r.request_id, r.point_id) for r in got) == [(1, 1), (2, 3)]
    assert dense.dense_candidates(q.limit(0).withColumnRenamed("request_id", "query_id"), p, 4, 0.3).collect() == []


def test_vector_only_retrieval_without_an_index(spark):
    docs = spark.createDataFrame([(1, "", "a", "s"), (2, "", "a", "s")], DOC_SCHEMA)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1])], "doc_id long, embedding array<double>")
    variants = spark.createDataFrame([(5, 0, "q")], "request_id long, variant_idx long, query string")
    qv = spark.createDataFrame([(5, 0, [1.0, 0.0])], "request_id long, variant_idx long, query_vec array<double>")
    got = hybrid.multi_query_retrieve(variants, None, vectors, qv, docs=docs).collect()
    assert [(r.doc_id, r.content, r.retrieval_query, r.search_method) for r in got] == [(1, "a", "q", "vector_fallback")]


def test_texts_are_never_broadcast(spark):
    from tessera.session import broadcast_if_small
    with pytest.raises(ValueError):
        broadcast_if_small(spark.createDataFrame([("x",)], "content string"))


def test_no_row_of_a_vector_search_holds_many_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)).round(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:90])], "query_id long, query_vec array<double>")
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, embedding array<float>")
    found = dense.dense_candidates(q, p, 3, None, query_block=8, point_block=16)
    assert "collect_list" not in plan_of(found)
    exact = np.round(x[:90] @ x.astype(np.float32).astype(float).T, 9)
    want = {(i, j) for i in range(90) for j in sorted(range(300), key=lambda j: (-exact[i, j], j))[:3]}
    assert {(r.query_id, r.point_id) for r in found.collect()} == want
    assert dense._groups(10 ** 9, 10 ** 7, 64, 512, 4096)[1] * dense.GROUP_BYTES >= 10 ** 7 * 64 * 8


@pytest.mark.parametrize("cells", [4_000_000, 0])
def test_best_documents_are_those_of_all_scores(spark, monkeypatch, cells):
    monkeypatch.setattr(lexical, "MAX_CELLS", cells)
    docs = spark.createDataFrame(DOCS + DOCS[:9] + [(None, "", "alpha w3", "s"), (99, "", "", "s")], DOC_SCHEMA).repartition(5)
    queries = spark.createDataFrame([(1, "alpha w3 w3"), (2, "beta gamma"), (None, "alpha"), (4, "nothing"), (5, "")], "query_id long, query string")
    index = lexical.build_bm25_index(docs)
    key = lambda df: sorted((-1 if r.query_id is None else r.query_id, r["rank"], -1 if r.doc_id is None else r.doc_id,
                             round(r.bm25_score, 9)) for r in df.collect())
    order = [F.round("bm25_score", 9).desc(), F.col("doc_id")]
    want = key(lexical.top_k(lexical.bm25_scores(index, queries), "query_id", order, 4))
    got = lexical.bm25_top_k(index, queries, 4)
    assert key(got) == want and len(want) == 12
    assert ("MapInArrow" in plan_of(got)) == (cells > 0)
    index.release()


def test_a_task_of_the_term_table_gets_a_bounded_share_of_the_text(spark, monkeypatch):
    """Repeated and null ids with one length merge, in few partitions as in many."""
    docs = spark.createDataFrame(DOCS + DOCS[:9] + [(None, "", "alpha w3", "s"), (None, "", "beta w3", "s"), (99, "", "", "s")], DOC_SCHEMA)
    read = lambda index: (index.n_docs, index.avgdl, sorted(map(str, index.terms.collect())), sorted(lexical.term_stats(index).collect()))
    found = []
    for task_bytes in (10 ** 9, 64):
        monkeypatch.setattr(lexical, "TASK_BYTES", task_bytes)
        index = lexical.build_bm25_index(docs)
        found.append((read(index), index.terms.rdd.getNumPartitions()))
        index.release()
    size = sum(len(t.encode()) + 1 for _, _, t, _ in DOCS + DOCS[:9]) + len(" alpha w3 beta w3")
    assert found[0][0] == found[1][0] and found[0][0][0] == 75
    assert found[0][1] <= 8 < found[1][1] == -(-size // 64)
    assert lexical.build_bm25_index(docs.limit(0)).terms.count() == 0
