"""Counts against a plain Python version, learned lists against their rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_rules
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] >= 2 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def test_query_over_the_whole_table(spark):
    got = {r.doc_id: r for r in QUERIES["op12_quality_rules"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert set(got) == {d.doc_id for d in docs}
    for d in docs:
        r, want = got[d.doc_id], counts(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    labels = [x for x in spark.read.parquet(f"{SF}/labels.parquet").collect() if not got[x.doc_id].base_failed]
    assert np.mean([got[x.doc_id].kept == (x.quality == 1) for x in labels]) > 0.97
    assert any(not got[x.doc_id].kept for x in labels)


def test_odd_texts(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "x y  z w", "l\n\nl\n l\nl\r\n", "é# *$ %&|<>",
             "a b c d a b c", "\U0001F600 \U0001F600 b", "one " * 60_000, "\x00 \x1f q"]
    texts += [" ".join(rng.choices("abcd", k=rng.randrange(60))) for _ in range(40)]
    rows = [(i, t, "z", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[6], (None, "a b", "z", 1)], "doc_id long, text string, t string, ws int")
    got = quality_rules.with_counts(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        want = counts("a b" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r
    assert quality_rules.with_counts(df.limit(0)).collect() == []


def learned(spark, rows, **more):
    df = spark.createDataFrame(rows, "a double, b double, y int")
    return df, quality_rules.learn(df, ["a", "b"], "y", **more)


def test_a_planted_concept_is_found(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, (4000, 2))
    bad = ((x[:, 0] > 6) & (x[:, 1] <= 3)) | (x[:, 1] > 9)
    rows = [(float(a), float(b), int(not c)) for (a, b), c in zip(x, bad)] + [(None, 5.0, 1), (1.0, None, None), (1.0, 1.0, 7)]
    df, model = learned(spark, rows)
    assert model.default and 2 <= len(model.rules) <= 4 and not any(r.verdict for r in model.rules)
    assert all(f in "ab" and op in (">", "<=") for r in model.rules for f, op, _ in r.conditions)
    got = df.select("a", "b", "y", model.verdict().alias("v")).collect()
    hit = [r.v == bool(r.y) for r in got if r.y in (0, 1)]
    assert np.mean(hit) > 0.97

    def by_hand(r):
        for rule in model.rules:
            if all(r[f] is not None and (r[f] > cut if op == ">" else r[f] <= cut) for f, op, cut in rule.conditions):
                return rule.verdict
        return model.default
    assert [r.v for r in got] == [by_hand(r) for r in got]


def test_the_rarer_class_is_covered(spark):
    rows = [(float(i % 50), 0.0, int(i % 50 >= 40)) for i in range(1000)]
    df, model = learned(spark, rows)
    assert not model.default and [r.verdict for r in model.rules] == [True]
    assert df.filter(model.verdict() != (F.col("y") == 1)).count() == 0
    _, sampled = learned(spark, [(a + i / 1e4, b, y) for i, (a, b, y) in enumerate(rows)], max_rows=400)
    assert not sampled.default and sampled.rules[0].covered < 70


@pytest.mark.parametrize("rows,default", [([], True), ([(1.0, 1.0, 1)] * 9, True), ([(1.0, 1.0, 0)] * 9, False), ([(1.0, 1.0, None)], True),
                                          ([(1.0, 1.0, 0), (1.0, 1.0, 1)] * 20, True), ([(None, None, 0)] * 9 + [(None, None, 1)], False)])
def test_nothing_to_learn(spark, rows, default):
    df, model = learned(spark, rows)
    assert model.rules == [] and model.default == default and model.sql() in ("true", "false")
    df.select(model.verdict()).collect()


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = quality_rules.with_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
