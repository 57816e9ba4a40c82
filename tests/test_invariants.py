"""Invariants over whole driver tables (sf0.001)."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.operators import chunk, prep, split
from tessera.sources import tables as T

SF = "/root/testdata/sf0.001"
Q = E.queries()


def test_fusion_never_exceeds_limit(spark):
    h = Q["hybrid_search"](spark, SF)
    assert h.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 10
    m = Q["multi_query_hybrid"](spark, SF)
    # a content appears once per request
    assert m.groupBy("request_id", "doc_id").count().filter("count > 1").count() == 0


def test_split_is_a_partition(spark):
    kept = prep.quality_filter(T.qa_pairs(T.table(spark, SF, "conversations")), "B")
    s = split.split_exact(kept, ["conv_id", "turn"])
    assert s.count() == kept.count()
    assert s.select("conv_id", "turn").distinct().count() == kept.count()
    n = kept.count()
    sizes = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert sizes.get("train", 0) == int(n * 0.8) and sizes.get("valid", 0) == int(n * 0.1)


def test_upsert_keeps_ids_unique(spark):
    u = Q["upsert_points"](spark, SF)
    assert u.count() == u.select("point_id").distinct().count()


def test_streaming_twins_equal_batch(spark):
    a = {tuple(r) for r in Q["stream_sessions"](spark, SF).select("event_id", "conversation_id").collect()}
    b = {tuple(r) for r in Q["sessionize"](spark, SF).select("event_id", "conversation_id").collect()}
    assert a == b
    s = {tuple(r) for r in Q["sustained_alert"](spark, SF).collect()}
    t = {tuple(r) for r in Q["sustained_alert_batch"](spark, SF).collect()}
    assert s == t
    ing = {tuple(r) for r in Q["stream_ingest_documents"](spark, SF).select("point_id", "n_tokens").collect()}
    bat = {tuple(r) for r in chunk.point_ids(chunk.chunk_tokens(T.table(spark, SF, "documents")))
           .select("point_id", "n_tokens").collect()}
    assert ing == bat


def test_chunks_cover_every_token(spark):
    d = T.table(spark, SF, "documents")
    c = chunk.chunk_tokens(d, size=64, overlap=8)
    # windows advance by 56 tokens: the first token of every window is start + 1
    got = c.groupBy("doc_id").agg(F.sum("n_tokens").alias("s"), F.count("*").alias("k"))
    from tessera.functions.text import whitespace_tokens
    n = d.select("doc_id", F.size(whitespace_tokens("text")).alias("n"))
    bad = got.join(n, "doc_id").filter(F.col("s") - (F.col("k") - 1) * 8 != F.col("n"))
    assert bad.count() == 0


def test_prompt_lines_concatenate_to_prompt(spark):
    lines = Q["chat_prompt_lines"](spark, SF).collect()
    by_conv: dict = {}
    for r in lines:
        by_conv.setdefault(r["conv_id"], []).append((r["line_no"], r["line"]))
    prompts = {r["conv_id"]: r["prompt"] for r in Q["chat_prompt"](spark, SF).collect()}
    assert set(by_conv) == set(prompts)
    for c, ls in by_conv.items():
        assert "".join(x for _, x in sorted(ls)) == prompts[c]


def test_import_progress_totals_match_batch_read(spark):
    prog = Q["stream_import_progress"](spark, SF).first()
    batch = Q["jsonl_roundtrip"](spark, SF).first()
    assert (prog["total_processed"], prog["total_errors"]) == (batch["n_valid"], batch["n_bad"])
