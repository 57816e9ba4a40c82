"""Lexicon tables: equal to ``contains`` per term, many terms, parts, odd rows."""

from __future__ import annotations

import random

from tessera.operators import lexicon, routing

LEX, Q = "base string, ord int, synonyms array<string>", "query_id long, query string"


def plan_nodes(df):
    return df._jdf.queryExecution().executedPlan().toString().count("\n")


def test_equal_to_contains_per_term(spark):
    rng = random.Random(3)
    terms = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 5))) for _ in range(60)})
    texts = ["".join(rng.choices("abcABC d", k=rng.randrange(40))) for _ in range(80)]
    q = spark.createDataFrame([*enumerate(texts), (None, "abc"), (500, None), (501, "")], Q)
    t = spark.createDataFrame([(x, i, []) for i, x in enumerate([*terms, terms[0], "", None, "ABC"])], LEX)
    want = sorted((i, x) for i, text in [*enumerate(texts), (-1, "abc")] for x in terms if x in text.lower())
    for part_chars in (10 ** 6, 40):
        got = lexicon.find_terms(q, t, "query", part_chars=part_chars).collect()
        assert sorted((-1 if r.query_id is None else r.query_id, r.term) for r in got) == want
    assert lexicon.find_terms(q, t.limit(0), "query").collect() == []
    assert lexicon.find_terms(q.limit(0), t, "query").collect() == []


def test_a_hundred_thousand_terms(spark):
    q = spark.createDataFrame([(1, "the term00042x and term99999x"), (2, "term5 x")], Q)
    many = spark.range(100_000).selectExpr("concat('term', lpad(cast(id as string), 5, '0'), 'x') as base")
    few, all_terms = lexicon.find_terms(q, many.limit(10), "query"), lexicon.find_terms(q, many, "query")
    assert plan_nodes(few) == plan_nodes(all_terms)
    assert sorted((r.query_id, r.term) for r in all_terms.collect()) == [(1, "term00042x"), (1, "term99999x")]


def test_expansion_equals_the_compiled_form(spark):
    lex = {"loan": ["credit", "loan", "advance"], "law": ["act", "code"], "lo": ["x"]}
    rows = [(1, "Loan law"), (2, "no match"), (3, "loan loan"), (4, ""), (5, "LAW"), (6, "law")]
    q = spark.createDataFrame(rows, Q)
    t = spark.createDataFrame([(b, i, s) for i, (b, s) in enumerate(lex.items())], LEX)
    for n in (1, 3, 10):
        want = {r.query_id: r.e for r in q.select("query_id", routing.expand_query(q["query"], lex, n).alias("e")).collect()}
        got = {r.query_id: r.expanded for r in lexicon.expand_queries(q, t, max_variants=n).collect()}
        assert got == want
    odd = spark.createDataFrame([(None, "law"), (7, None)], Q)
    assert {r.query_id: r.expanded for r in lexicon.expand_queries(odd, t, max_variants=2).collect()} == {None: "law act", 7: ""}
