"""The pipeline against its stages' brute-force versions."""

from __future__ import annotations

import pytest

import corpus_pipeline as CP
from tessera.llm import piece_codec
from tessera.llm.common import scratch
from tessera.llm.queries import piece_model

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in CP.STAGES:
        path = scratch(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_columns_and_rows_shrink(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(stages[n].columns == columns for n, _ in CP.STAGES[:-1])
    counts = [stages[n].count() for n, _ in CP.STAGES]
    assert counts == sorted(counts, reverse=True) and counts[2] == counts[3] == counts[4] > 0


def test_filters_take_effect(spark, stages):
    from tests.llm.test_joins import brute_texts
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id: r.text for r in stages["quality"].collect()}
    known = [i for i in labels if labels[i] == 1]
    assert sum(i in kept for i in known) >= 0.97 * len(known)
    assert sum(i in kept for i in labels if labels[i] == 0) <= 1
    smallest = {i for i, (_, c) in brute_texts(kept).items() if i == c}
    assert {r.doc_id for r in stages["near_duplicates"].collect()} == smallest
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = lambda t: any(x in " ".join((t or "").lower().split()) for x in items)
    before = {r.doc_id: r.text for r in stages["near_duplicates"].collect()}
    assert {r.doc_id for r in stages["benchmark"].collect()} == {i for i, t in before.items() if not held(t)}


def test_secrets_are_masked_and_ids_decode(spark, stages):
    before = {r.doc_id: r.text for r in stages["benchmark"].collect()}
    after = {r.doc_id: r.text for r in stages["secrets"].collect()}
    import re
    secret = re.compile(r"AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}")
    assert after == {i: secret.sub("[SECRET]", t) for i, t in before.items()}
    back = {r.doc_id: r.text for r in piece_codec.decode_ids(stages["token_ids"], piece_model()).collect()}
    assert back == after


def test_odd_rows_pass_through(spark):
    rows = [(1, None, None, None, None, "e"), (2, "", "en", "s", 0, "e"), (None, "the and of it " * 30, "en", "s", 420, "e"),
            (3, "the and of it is so " * 9, "en", "s", 180, "e"), (3, "the and of it is so " * 9, "en", "s", 180, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")
    for name, stage in CP.STAGES[1:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert CP.keep_one_of_each(spark, docs, SF).count() == 4
    assert CP.encode(spark, docs, SF).count() == 5


def test_texts_of_one_id_are_judged_one_by_one(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (6, a + " end"), (6, c), (7, c + " end"), (5, b), (None, a), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    kept = CP.keep_one_of_each(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted(
        [("1", a), ("5", b), ("6", c), ("None", a), ("8", "None"), ("8", "")])
