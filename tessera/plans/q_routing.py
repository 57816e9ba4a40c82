"""Query-text queries: cleaning, validation, response normalisation,
follow-up detection, routing, variant parsing, expansion, lexical rank and
web-result rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixed_values as FV
from tessera.functions.text import tokens
from tessera.operators import lexical, routing
from tessera.operators import lexicon as lex
from tessera.plans.catalog import register
from tessera.plans.sqlbits import BM25_CTES, bm25_query_terms, clean, lit, qa_pairs, tok
from tessera.sources import tables as T

WS = "[\\s\\p{Z}\\x{0b}\\x{1c}-\\x{1f}\\x{85}]"


def strip_sql(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


# lexicons that occur in the invented fixture prose (defaults are Vietnamese)
FIXTURE_FOLLOW_UP = ["die ", "le ", "the "]
FIXTURE_CALC = ["ung", "tion"]
FIXTURE_EXPANSIONS = {"the": ["the", "a", "this"], "and": ["and", "plus", "with"],
                      "ment": ["ment", "ness"], "er": ["er", "or"]}


def _conv(spark, sf):
    return T.table(spark, sf, "conversations")


@register("clean_queries", sql=f"""
WITH s AS (SELECT conv_id, turn, text, {clean(f"regexp_replace({strip_sql('text')}, '[?!.]+$', '')")} AS c FROM conversations)
SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL WHEN length(c) > 3 THEN c END AS cleaned FROM s
""")
def clean_queries(spark, sf):
    """PF14 over every message text."""
    return _conv(spark, sf).select("conv_id", "turn", routing.clean_query("text").alias("cleaned"))


@register("validate_queries", sql=f"""
WITH s AS (SELECT conv_id, turn, text, {strip_sql('text')} AS t FROM conversations)
SELECT conv_id, turn,
  CASE WHEN text IS NULL OR text = '' THEN {lit(FV.QUERY_ERR_EMPTY)} WHEN length(t) < 5 THEN {lit(FV.QUERY_ERR_SHORT)}
       WHEN length(t) > 1000 THEN {lit(FV.QUERY_ERR_LONG)} WHEN NOT regexp_matches(t, '\\p{{L}}') THEN {lit(FV.QUERY_ERR_ALPHA)}
       ELSE {lit(FV.QUERY_OK)} END AS reason,
  length(t) > 5 AND length(t) < 500 AND regexp_matches(t, '\\p{{L}}') AS simple_valid
FROM s
""")
def validate_queries(spark, sf):
    """PF15 (both rule sets) over every message text."""
    valid, reason = routing.validate_query("text")
    return _conv(spark, sf).select("conv_id", "turn", reason.alias("reason"),
                                   routing.simple_valid_query("text").alias("simple_valid"))


@register("normalise_responses", sql=f"""
SELECT conv_id, turn, coalesce({strip_sql('text')}, '') AS answer,
       array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> ''), '|') AS sources,
       least(greatest((turn - 2) / 3.0, 0.0), 1.0) AS confidence
FROM conversations
""")
def normalise_responses(spark, sf):
    """PF16: responses = message text, sources = its lines, confidence = (turn - 2) / 3."""
    c = _conv(spark, sf)
    a, src, conf = routing.normalise_response(F.col("text"), F.split("text", "\n"), (F.col("turn") - 2) / 3.0)
    return c.select("conv_id", "turn", a.alias("answer"), F.array_join(src, "|").alias("sources"),
                    conf.alias("confidence"))


def _follow_sql():
    cond = " OR ".join(f"contains(lower(coalesce(text, '')), {lit(w)})" for w in FIXTURE_FOLLOW_UP)
    return f"""
SELECT conv_id, turn, ({cond}) AS is_follow_up, (turn + 1) AS history_len,
       NOT ((turn + 1) = 0 OR ((turn + 1) <= 1 AND NOT ({cond}))) AS needs_rewrite
FROM conversations WHERE role = 'user'
"""


@register("follow_up_flags", sql=_follow_sql())
def follow_up_flags(spark, sf):
    """PF17 + PF18 for every user message (history = system row + earlier messages)."""
    c = _conv(spark, sf).filter(F.col("role") == "user")
    fu = routing.follow_up_flag(F.col("text"), FIXTURE_FOLLOW_UP)
    hl = (F.col("turn") + 1)
    return c.select("conv_id", "turn", fu.alias("is_follow_up"), hl.alias("history_len"),
                    routing.needs_rewrite(hl, fu).alias("needs_rewrite"))


_MODEL_OUT = ["legal_rag", "  Agent_Tools ", "route: web_search.", "general chat", ""]


def _model_output_col():
    e = None
    for i, v in enumerate(_MODEL_OUT):
        e = F.when(F.col("conv_id") % 5 == i, v) if e is None else e.when(F.col("conv_id") % 5 == i, v)
    return e


def _route_sql():
    mo = "CASE " + " ".join(f"WHEN conv_id % 5 = {i} THEN {lit(v)}" for i, v in enumerate(_MODEL_OUT)) + " END"
    labels = ", ".join(lit(x) for x in FV.ROUTE_LABELS)
    contained = "CASE " + " ".join(f"WHEN contains(o, {lit(x)}) THEN {lit(x)}" for x in FV.ROUTE_LABELS) + " END"
    kw = " OR ".join(f"contains(lower(coalesce(text, '')), {lit(k)})" for k in FIXTURE_CALC)
    return f"""
WITH l AS (SELECT conv_id, turn, text, lower({strip_sql(f"coalesce({mo}, '')")}) AS o FROM conversations WHERE role = 'user')
SELECT conv_id, turn,
  CASE WHEN o IN ({labels}) THEN o WHEN {contained} IS NOT NULL THEN {contained}
       WHEN {kw} THEN {lit(FV.ROUTE_KEYWORD)} ELSE {lit(FV.ROUTE_DEFAULT)} END AS route,
  CASE WHEN o IN ({labels}) THEN 'exact' WHEN {contained} IS NOT NULL THEN 'contained'
       WHEN {kw} THEN 'keyword' ELSE 'default' END AS how
FROM l
"""


@register("normalise_route", sql=_route_sql())
def normalise_route(spark, sf):
    """PF19 over a routing log: user messages with a model output derived from the conversation id."""
    c = _conv(spark, sf).filter(F.col("role") == "user")
    route, how = routing.normalise_route(_model_output_col(), F.col("text"), keywords=FIXTURE_CALC)
    return c.select("conv_id", "turn", route.alias("route"), how.alias("how"))


@register("query_variants", sql=f"""
WITH qa AS {qa_pairs()},
l AS (SELECT conv_id, turn, question,
             list_filter(list_transform(
               list_filter(list_transform(string_split({strip_sql("coalesce(answer, '')")}, chr(10)), lambda x: {strip_sql('x')}),
                           lambda x: x <> '' AND NOT starts_with(x, '#')),
               lambda x: {strip_sql("regexp_replace(x, '^[0-9.\\-) ]+', '')")}), lambda x: x <> '') AS ls FROM qa),
p AS (SELECT conv_id, turn, list_concat(ls, list_transform(range(greatest(3 - len(ls), 0)), lambda i: question))[1:3] AS v FROM l)
SELECT conv_id, turn, (generate_subscripts(v, 1) - 1)::INT AS variant_idx, unnest(v) AS query FROM p
""")
def query_variants(spark, sf):
    """PF20: assistant replies parsed as variant lists for the preceding question."""
    qa = T.qa_pairs(_conv(spark, sf))
    return routing.parse_query_variants(qa, "answer", "question", 3, ["conv_id", "turn"])


def _expand_sql():
    cands = ", ".join(f"CASE WHEN contains(lower(text), {lit(b)}) THEN replace(lower(text), {lit(b)}, {lit(s)}) END"
                      for b, syns in FIXTURE_EXPANSIONS.items() for s in syns if s != b)
    return f"""
WITH c AS (SELECT item_id, list_concat([text], list_filter([{cands}], lambda x: x IS NOT NULL)) AS a FROM benchmark),
d AS (SELECT item_id, list_filter(a, lambda x, i: NOT list_contains(a[1:i - 1], x)) AS u FROM c)
SELECT item_id AS query_id, array_to_string(u[1:5], ' ') AS expanded FROM d
"""


@register("expand_queries", sql=_expand_sql())
def expand_queries(spark, sf):
    """SO3 + JN4: synonym expansion of every benchmark text (fixture lexicon)."""
    b = T.table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"),
                    routing.expand_query(F.col("text"), FIXTURE_EXPANSIONS).alias("expanded"))


TOP5_SQL = f"""
WITH {BM25_CTES},
q AS ({bm25_query_terms('benchmark', 'item_id', 'text')}),
s AS (SELECT q.query_id, p.doc_id, sum(q.qtf * p.weight) AS score FROM q JOIN bm_post p USING (term) GROUP BY 1, 2),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
      WHERE rank <= 5),
res AS (SELECT r.query_id, r.rank, r.doc_id, split_part(d.text, chr(10), 1) AS title, 'doc://' || r.doc_id AS url,
               d.text AS content, r.score FROM r JOIN documents d USING (doc_id))
"""


def _results(spark, sf):
    idx = lexical.build_bm25_index(T.search_documents(T.table(spark, sf, "documents")))
    hits = lexical.bm25_search(idx, T.bench_queries(T.table(spark, sf, "benchmark")), 5)
    return hits.select("query_id", "rank", "doc_id", F.split("content", "\n")[0].alias("title"),
                       F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
                       "content", F.col("bm25_score").alias("score"))


@register("lexical_rank", sql=TOP5_SQL + """,
w AS (SELECT DISTINCT item_id AS query_id, unnest(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ')) AS word FROM benchmark),
sc AS (SELECT res.query_id, res.doc_id, res.rank,
              coalesce(sum(CASE WHEN contains(lower(res.title), w.word) THEN 2 ELSE 0 END
                         + CASE WHEN contains(lower(res.content), w.word) THEN 1 ELSE 0 END), 0)::BIGINT AS score
       FROM res LEFT JOIN w ON w.query_id = res.query_id AND w.word <> '' GROUP BY 1, 2, 3)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS lexical_rank FROM sc
""")
def lexical_rank(spark, sf):
    """TK8: word-hit rank of each query's BM25 top-5 (title = first line), stable on the BM25 rank."""
    res = _results(spark, sf)
    q = T.bench_queries(T.table(spark, sf, "benchmark"))
    r = lexical.lexical_rank(q, res.select("query_id", "doc_id", F.col("rank").alias("doc_order"), "title", "content"),
                             order_col="doc_order")
    ids = res.select("query_id", F.col("rank").alias("doc_order"), "doc_id")
    return r.join(ids, ["query_id", "doc_order"]).select("query_id", "doc_id", "score",
                                                         F.col("rank").cast("bigint").alias("lexical_rank"))


def _web_queries(spark, sf):
    b = T.table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"),
                    F.when(F.col("item_id") % 4 == 0, F.split("text", "\n")[0]).alias("answer"))


WEBQ_SQL = "(SELECT item_id AS query_id, text AS query, CASE WHEN item_id % 4 = 0 THEN split_part(text, chr(10), 1) END AS answer FROM benchmark)"


@register("format_web_results", sql=TOP5_SQL + f""",
b AS (SELECT query_id, string_agg(rank || '. ' || title || chr(10) || {lit(FV.WEB_URL_PREFIX)} || url || chr(10) || '   '
                                  || substr(content, 1, 200) || '...' || chr(10) || {lit(FV.WEB_SCORE_PREFIX)}
                                  || printf('%.2f', coalesce(score, 0.0)) || chr(10) || chr(10), '' ORDER BY rank) AS body
      FROM res GROUP BY 1)
SELECT q.query_id, {lit(FV.WEB_HEADER)} || q.query || chr(10) || chr(10)
       || CASE WHEN coalesce(q.answer, '') <> '' THEN {lit(FV.WEB_ANSWER_HEADER)} || q.answer || chr(10) || chr(10) ELSE '' END
       || {lit(FV.WEB_DETAILS)} || coalesce(b.body, {lit(FV.WEB_NONE_FOUND)}) AS formatted
FROM {WEBQ_SQL} q LEFT JOIN b USING (query_id)
""")
def format_web_results(spark, sf):
    """AG18 over result tables built from BM25 hits."""
    return routing.format_web_results(_results(spark, sf), _web_queries(spark, sf))


@register("first_snippets", sql=TOP5_SQL + f""",
t AS (SELECT query_id, {lit(FV.WEB_SNIPPET_HEADER)} || string_agg('- ' || substr(content, 1, 150) || '...' || chr(10), '' ORDER BY rank) AS s
      FROM res WHERE rank <= 2 GROUP BY 1)
SELECT q.query_id, CASE WHEN coalesce(q.answer, '') <> '' THEN q.answer ELSE coalesce(t.s, {lit(FV.WEB_NO_INFO)}) END AS snippet
FROM {WEBQ_SQL} q LEFT JOIN t USING (query_id)
""")
def first_snippets(spark, sf):
    """AG19."""
    return routing.first_snippets(_results(spark, sf), _web_queries(spark, sf))


# ---------------------------------------------------------------------------
# lexicon tables
# ---------------------------------------------------------------------------

WORDS_SQL = f"""
words AS (SELECT DISTINCT unnest({tok('text')}) AS base FROM benchmark),
lex AS (SELECT base, [reverse(base), base || 's', base] AS synonyms FROM words WHERE length(base) >= 5)
"""


def _benchmark_lexicon(spark, sf):
    """A lexicon table from the words of the benchmark texts."""
    words = T.table(spark, sf, "benchmark").select(F.explode(tokens("text")).alias("base")).distinct()
    return words.filter(F.length("base") >= 5).select(
        "base", F.col("base").alias("ord"), F.array(F.reverse("base"), F.concat("base", F.lit("s")), F.col("base")).alias("synonyms"))


@register("lexicon_matches", sql=f"""
WITH {WORDS_SQL},
m AS (SELECT doc_id, base FROM documents JOIN lex ON contains(lower(text), base))
SELECT doc_id, count(*) AS n_terms, min(base) AS first_term, max(base) AS last_term FROM m GROUP BY doc_id
""")
def lexicon_matches(spark, sf):
    """JN4: the terms of a lexicon table that each document contains."""
    docs = T.table(spark, sf, "documents")
    found = lex.find_terms(docs, _benchmark_lexicon(spark, sf), "text", keys=["doc_id"])
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.min("term").alias("first_term"),
                                       F.max("term").alias("last_term"))


@register("expand_queries_lexicon", sql=f"""
WITH {WORDS_SQL},
c AS (SELECT item_id, text, base, s.pos, replace(lower(text), base, synonyms[s.pos]) AS cand
      FROM benchmark JOIN lex ON contains(lower(text), base), (SELECT unnest([1, 2, 3]) AS pos) s
      WHERE synonyms[s.pos] <> base),
f AS (SELECT item_id, cand, min(struct_pack(base := base, pos := pos)) AS place FROM c WHERE cand <> text GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY place) AS rank FROM f),
k AS (SELECT item_id, string_agg(cand, ' ' ORDER BY rank) AS more FROM r WHERE rank <= 2 GROUP BY item_id)
SELECT b.item_id, CASE WHEN more IS NULL THEN text ELSE text || ' ' || more END AS expanded
FROM benchmark b LEFT JOIN k USING (item_id)
""")
def expand_queries_lexicon(spark, sf):
    """SO3 + JN4: expansion from a lexicon table, three variants per query."""
    b = T.table(spark, sf, "benchmark").select("item_id", "text")
    return lex.expand_queries(b, _benchmark_lexicon(spark, sf), "text", keys=["item_id"], max_variants=3)
