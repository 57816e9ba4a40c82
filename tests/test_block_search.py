"""Search over impact-ordered blocks: equal to scoring all postings, and far
fewer postings read."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blockmax, lexical
from tessera.sources import tables as T
from tessera.sources.jsonl import scratch_path

DOC_SCHEMA = "doc_id long, question string, content string, source string"
LARGE = "/root/testdata/sf0.1"


def full_search(index, queries, k):
    hits = lexical.top_k(lexical.bm25_scores(index, queries), "query_id", [F.round("bm25_score", 9).desc(), F.col("doc_id")], k)
    return {(r.query_id, r["rank"], r.doc_id, round(r.bm25_score, 6)) for r in hits.collect()}


def block_search(blocks, queries, k, **more):
    hits = blockmax.search_blocks(blocks, queries, k, **more)
    return {(r.query_id, r["rank"], r.doc_id, round(r.bm25_score, 6)) for r in hits.collect()}


@pytest.mark.parametrize("block_rows", [1, 8, 64])
def test_equal_to_scoring_all_postings(spark, block_rows):
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(200)])
    share = 1 / np.arange(1, 201)
    texts = [" ".join(rng.choice(words, rng.integers(1, 40), p=share / share.sum())) for _ in range(400)]
    texts[5::8] = [texts[5]] * len(texts[5::8])                      # ties
    index = lexical.build_bm25_index(spark.createDataFrame([(i, "", t, "s") for i, t in enumerate(texts)], DOC_SCHEMA))
    queries = spark.createDataFrame([(i, " ".join(rng.choice(words, 9))) for i in range(15)] +
                                    [(50, texts[5]), (51, "w0 w0 w0 w1"), (52, "unknown"), (53, ""), (54, None), (None, "w1 w7")],
                                    "query_id long, query string")
    blocks = blockmax.write_blocks(index, scratch_path(spark, "blocks"), block_rows)
    work = {}
    assert block_search(blocks, queries, 4, seeds=2, work=work) == full_search(index, queries.dropna(subset=["query_id"]), 4)
    assert 0 < work["read"] <= work["postings"]
    sizes = blocks.blocks.agg(F.max("n"), F.sum("n")).first()
    assert sizes[0] <= block_rows and sizes[1] == index.terms.count()
    index.release()


def test_blocks_of_a_term_are_ordered_by_weight(spark):
    texts = ["hot " * (1 + i % 9) + f"x{i}" for i in range(300)]
    index = lexical.build_bm25_index(spark.createDataFrame([(i, "", t, "s") for i, t in enumerate(texts)], DOC_SCHEMA))
    blocks = blockmax.write_blocks(index, scratch_path(spark, "blocks"), 16)
    rows = [(r.block, r.max_weight) for r in blocks.blocks.filter("term = 'hot'").orderBy("block").collect()]
    assert len(rows) >= 300 // 16 and [w for _, w in rows] == sorted((w for _, w in rows), reverse=True)
    with pytest.raises(ValueError):
        blockmax.write_blocks(index, scratch_path(spark, "blocks"), 48)
    index.release()


def test_weights_come_from_the_blocks_without_a_join_of_postings(spark):
    """Frequencies are summed over blocks (a term with many blocks, one without a neighbour) and kept with them."""
    texts = ["hot " * (1 + i % 9) + f"x{i % 40}" for i in range(300)] + ["alone"]
    index = lexical.build_bm25_index(spark.createDataFrame([(i, "", t, "s") for i, t in enumerate(texts)], DOC_SCHEMA))
    blocks = blockmax.write_blocks(index, scratch_path(spark, "blocks"), 16)
    idf = blocks.blocks.select("term", "idf").distinct()
    assert idf.count() == index.terms.select("term").distinct().count()
    got = {(r.term, r.doc_id): r.weight for r in blocks.postings.join(idf, "term").withColumn("weight", F.col("idf") * F.col("impact")).collect()}
    want = {(r.term, r.doc_id): r.weight for r in index.postings.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    index.release()


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no larger tables")
def test_few_postings_are_read(spark):
    index = lexical.build_bm25_index(T.search_documents(T.table(spark, LARGE, "documents")))
    blocks = blockmax.write_blocks(index, scratch_path(spark, "blocks"))
    index.release()
    work = {}
    hits = blockmax.search_blocks(blocks, T.bench_queries(T.table(spark, LARGE, "benchmark")), 5, work=work)
    assert hits.count() == 5 * hits.select("query_id").distinct().count()
    assert work["read"] < 0.3 * work["postings"], work
