"""Bucketed points and index segments: only touched buckets are rewritten, any
order of changes equals a fresh build, replays change nothing."""

from __future__ import annotations

import random

import pytest

from tessera.operators import lexical
from tessera.operators.point_store import PointStore
from tessera.operators.segments import SegmentedIndex
from tessera.sources.jsonl import scratch_path

P = "point_id long, label int"
D = "doc_id long, question string, content string, source string"


def points(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_point_store_against_a_dict(spark):
    store = PointStore(spark, scratch_path(spark, "points"), P, buckets=8)
    assert points(store.points()) == [] and store.manifest.version() == 0
    rng, want = random.Random(7), {}
    for step in range(4):
        batch = [(rng.choice([None, *range(40)]), rng.randrange(100), seq) for seq in range(12)]
        store.upsert(spark.createDataFrame(batch, P + ", seq int"), f"u{step}", "seq")
        want |= {i: v for i, v, _ in batch}
        gone = [(rng.randrange(60),) for _ in range(4)] + [(None,)] * (step % 2)
        store.delete(spark.createDataFrame(gone, "point_id long"), f"d{step}")
        for (i,) in gone:
            want.pop(i, None)
        assert points(store.points()) == sorted(want.items(), key=str)
    before = store.manifest.version()
    assert store.upsert(spark.createDataFrame([(1, 5)], P), "u0") == before and points(store.points()) == sorted(want.items(), key=str)
    assert store.vacuum() > 0 and points(store.points()) == sorted(want.items(), key=str)
    assert points(PointStore(spark, store.path, P, buckets=8).points()) == sorted(want.items(), key=str)


def test_only_touched_buckets_are_rewritten(spark):
    store = PointStore(spark, scratch_path(spark, "points"), P, buckets=16)
    store.upsert(spark.range(400).selectExpr("id as point_id", "0 as label"))
    old = {p["bucket"]: p["made"] for p in store.manifest.parts()}
    version = store.upsert(spark.createDataFrame([(5, 1)], P))
    new = {p["bucket"]: p["made"] for p in store.manifest.parts()}
    assert len(old) == 16 and sum(old[b] != new[b] for b in old) == 1
    assert store.points().count() == 400 and store.points().filter("label = 1").count() == 1
    assert store.points(version - 1).filter("label = 1").count() == 0          # the older version still reads
    store.delete(spark.range(400).selectExpr("id as point_id"))
    assert store.points().count() == 0
    store.upsert(spark.createDataFrame([], P), "empty")
    assert store.points().count() == 0


def test_owners_are_replaced_whole(spark):
    schema = "point_id long, doc_id long"
    store = PointStore(spark, scratch_path(spark, "points"), schema, "doc_id", 4)
    owners = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id long")
    store.replace(spark.createDataFrame([(10, 1), (11, 1), (20, 2)], schema), owners(1, 2, 3), "doc_id")
    store.replace(spark.createDataFrame([(12, 1)], schema), owners(1, 2), "doc_id")
    assert points(store.points()) == [(12, 1)]
    with pytest.raises(ValueError):
        store.replace(store.points(), owners(1), "point_id")


def hits(index, q):
    got = lexical.bm25_search(index, q, 5)
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.bm25_score, 6)) for r in got.collect())


def test_segments_equal_a_fresh_build(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    text = lambda: " ".join(rng.choices(words, k=rng.randrange(0, 12)))
    q = spark.createDataFrame([(i, " ".join(rng.sample(words, 4))) for i in range(8)], "query_id long, query string")
    seg, want = SegmentedIndex(spark, scratch_path(spark, "segments")), {}

    def check():
        fresh = lexical.build_bm25_index(spark.createDataFrame([(i, "", t, "s") for i, t in want.items()], D))
        n, avgdl = seg.statistics()
        assert n == fresh.n_docs and abs(avgdl - fresh.avgdl) < 1e-9
        assert hits(seg.index(), q) == hits(fresh, q)
        fresh.release()

    for step in range(3):
        new = {rng.randrange(40): text() for _ in range(15)}
        seg.add(spark.createDataFrame([(i, "", t, "s") for i, t in new.items()], D), f"a{step}")
        want |= new
        gone = [rng.randrange(60) for _ in range(5)]
        seg.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        for i in gone:
            want.pop(i, None)
    check()
    version = seg.manifest.version()
    assert seg.add(spark.createDataFrame([(1, "", "w1", "s")], D), "a1") == version
    seg.merge()
    assert len(seg.manifest.parts()) == 1
    check()
    seg.delete(spark.createDataFrame([(i,) for i in want], "doc_id long"))
    assert seg.statistics() == (0, 0.0) and hits(seg.index(), q) == []
