"""Ranked search against scoring everything: ties, copies, skipped blocks, odd inputs."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest

from tessera.llm import ranked_search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_scoring_all(docs, items, k=10):
    held = [(i, tokens(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(tokens(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, t in held:
            m = 10 + (90 * len(t) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) *
                        ((10 ** 9 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in terms if x in t)
            if score > 0:
                scored.append((-score, doc is not None, doc))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(words, rng.integers(1, 60), p=share / share.sum())) for _ in range(n)]
    texts[3::10] = [texts[0]] * len(texts[3::10])                    # a large group of copies
    return [(i, t) for i, t in enumerate(texts)], [" ".join(rng.choice(words, 12)) for _ in range(12)]


@pytest.mark.parametrize("sizes", [{}, {"shard_docs": 64, "block_docs": 5}, {"group_terms": 30, "shard_docs": 300, "block_docs": 1}])
def test_equal_to_scoring_everything(spark, sizes):
    docs, items = corpus(1, 700)
    items = [*enumerate(items), (20, docs[0][1]), (21, "W1 w1, w299! nowhere"), (22, "nowhere"), (22, None)]
    work = {}
    got = ranked_search.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), work=work, **sizes)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == by_scoring_all(docs, items)
    assert 0 < work["blocks_scored"] <= work["blocks"]
    if sizes.get("block_docs") == 5:
        assert work["blocks_scored"] < 0.6 * work["blocks"] and work["documents_scored"] < 0.6 * work["postings"]


def test_odd_inputs(spark):
    texts = ["Alpha beta", "alpha-beta ALPHA", None, "", " ... ", "Ärger über alpha", "ärger", "x" * 200_000 + " alpha", "beta " * 50_000,
             "\x00alpha\x7fbeta gamma", "alpha beta"]
    docs = [*enumerate(texts), (0, "Alpha beta"), (None, "alpha gamma"), (None, "alpha gamma")]
    items = [(1, "alpha"), (1, "alpha"), (2, "Ärger Beta"), (None, "gamma "), (3, None), (4, ""), (5, "!!!"), (6, "beta"), (6, "alpha")]
    df = spark.createDataFrame([(*d, "z", 1) for d in docs], DOCS + ", score string, rank int")
    qf = spark.createDataFrame([(*i, "z") for i in items], ITEMS + ", doc_id string")
    got = ranked_search.search(df, qf, k=4)
    assert sorted(map(tuple, got.collect()), key=str) == by_scoring_all(docs, items, 4)


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, "b")])])
def test_nothing_found(spark, docs, items):
    assert ranked_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect() == []
