"""Retrieval queries: BM25, dense, hybrid, multi-query, rerank, lexical rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import blockmax, lexical, segments
from tessera.plans.catalog import ORACLE, register
from tessera.plans.sqlbits import BM25_CTES, bm25_query_terms
from tessera.sources import tables as T
from tessera.sources.jsonl import scratch_path


def _index(spark, sf):
    return lexical.build_bm25_index(T.search_documents(T.table(spark, sf, "documents")))


@register("bm25_top5", sql=f"""
WITH {BM25_CTES},
q AS ({bm25_query_terms('benchmark', 'item_id', 'text')}),
s AS (SELECT q.query_id, p.doc_id, sum(q.qtf * p.weight) AS score
      FROM q JOIN bm_post p USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS bm25_score, rank FROM r WHERE rank <= 5
""")
def bm25_top5(spark, sf):
    """TK2 + JN1 + WN1: top-5 BM25 documents for every benchmark text."""
    idx = _index(spark, sf)
    hits = lexical.bm25_top_k(idx, T.bench_queries(T.table(spark, sf, "benchmark")), 5)
    return hits.select("query_id", "doc_id", F.round("bm25_score", 6).alias("bm25_score"),
                       F.col("rank").cast("bigint").alias("rank"))


@register("bm25_block_top5", sql=ORACLE["bm25_top5"])
def bm25_block_top5(spark, sf):
    """TK2 + JN1 on impact-ordered blocks: only blocks that can reach a
    query's k-th score are read; the result is that of ``bm25_top5``."""
    idx = _index(spark, sf)
    blocks = blockmax.write_blocks(idx, scratch_path(spark, "bm25-blocks"))
    idx.release()
    hits = blockmax.search_blocks(blocks, T.bench_queries(T.table(spark, sf, "benchmark")), 5)
    return hits.select("query_id", "doc_id", F.round("bm25_score", 6).alias("bm25_score"),
                       F.col("rank").cast("bigint").alias("rank"))


@register("bm25_segments_top5", sql=ORACLE["bm25_top5"].replace(
    "FROM documents WHERE coalesce(text, '') <> ''", "FROM documents WHERE coalesce(text, '') <> '' AND doc_id % 11 <> 3"))
def bm25_segments_top5(spark, sf):
    """AG10 + TK2: an index grown by segments - half of the documents with
    other texts, then all with their own, then some deleted - searches like
    one built at once from what is left."""
    docs = T.search_documents(T.table(spark, sf, "documents"))
    idx = segments.SegmentedIndex(spark, scratch_path(spark, "segments"))
    idx.add(docs.filter("doc_id % 2 = 0").withColumn("content", F.reverse("content")), "half")
    idx.add(docs, "all")
    idx.delete(docs.filter("doc_id % 11 = 3"), "gone")
    idx.add(docs.limit(0), "nothing")
    hits = lexical.bm25_search(idx.index(), T.bench_queries(T.table(spark, sf, "benchmark")), 5)
    return hits.select("query_id", "doc_id", F.round("bm25_score", 6).alias("bm25_score"),
                       F.col("rank").cast("bigint").alias("rank"))


@register("bm25_corpus_stats", sql=f"""
WITH {BM25_CTES}
SELECT (SELECT n FROM bm_stats)::BIGINT AS n_docs, round((SELECT avgdl FROM bm_stats), 6) AS avgdl,
       count(DISTINCT term) AS n_terms, count(*) AS n_postings, sum(tf)::BIGINT AS n_tokens
FROM bm_tf
""")
def bm25_corpus_stats(spark, sf):
    """AG10: corpus statistics of the BM25 index."""
    return lexical.corpus_stats(_index(spark, sf))


@register("bm25_term_stats", sql=f"""
WITH {BM25_CTES}
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM bm_tf GROUP BY term
""")
def bm25_term_stats(spark, sf):
    """AG10: document frequency and collection frequency per term."""
    return lexical.term_stats(_index(spark, sf))


# ---------------------------------------------------------------------------
# dense, hybrid, multi-query, rerank
# ---------------------------------------------------------------------------

from tessera.operators import dense, dense_cells, embed, hybrid  # noqa: E402
from tessera.plans.sqlbits import dense_dot, hash_vectors  # noqa: E402

EMB_Q = "(SELECT vec_id AS qid, embedding AS vec FROM embeddings)"
EMB_P = "(SELECT vec_id AS pid, embedding AS vec FROM embeddings)"


def _dense_sql(limit, extra_where="", threshold="0.3"):
    return f"""
WITH s AS {dense_dot(EMB_Q, EMB_P)},
f AS (SELECT s.*, e.label FROM s JOIN embeddings e ON e.vec_id = s.point_id
      WHERE round(score, 9) >= {threshold} {extra_where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, point_id) AS search_rank FROM f)
SELECT query_id, point_id, round(score, 6) AS similarity_score, search_rank, label FROM r WHERE search_rank <= {limit}
"""


def _points(spark, sf):
    return T.dense_points(T.table(spark, sf, "embeddings"))


def _dense_q(spark, sf):
    return T.dense_queries(T.table(spark, sf, "embeddings"))


@register("dense_top4", sql=_dense_sql(4))
def dense_top4(spark, sf):
    """TK1 + JN2 + WN1: every embedding as a query against all points."""
    h = dense.dense_search(_dense_q(spark, sf), _points(spark, sf), 4, None, 0.3, payload=["label"])
    return h.select("query_id", "point_id", F.round("similarity_score", 6).alias("similarity_score"),
                    "search_rank", "label")


@register("dense_cells_top4", sql=ORACLE["dense_top4"])
def dense_cells_top4(spark, sf):
    """TK1 + JN2 over cells: a query is compared with the cells whose bound
    reaches its fourth best score; the result is that of ``dense_top4``."""
    points = _points(spark, sf)
    cells = dense_cells.write_cells(points, scratch_path(spark, "dense-cells"))
    h = dense_cells.search_cells(cells, _dense_q(spark, sf), 4, 0.3)
    return h.join(points.select("point_id", "label"), "point_id").select(
        "query_id", "point_id", F.round("score", 6).alias("similarity_score"),
        F.col("search_rank").cast("bigint").alias("search_rank"), "label")


@register("dense_top4_filtered", sql=_dense_sql(4, "AND e.label >= 2 AND e.label <= 7"))
def dense_top4_filtered(spark, sf):
    """TK1 + PF8: payload range filter applied before scoring."""
    h = dense.dense_search(_dense_q(spark, sf), _points(spark, sf), 4,
                           {"label": {"gte": 2, "lte": 7}}, 0.3, payload=["label"])
    return h.select("query_id", "point_id", F.round("similarity_score", 6).alias("similarity_score"),
                    "search_rank", "label")


@register("vector_fallback", sql=f"""
WITH r AS ({_dense_sql(5)})
SELECT query_id, point_id, similarity_score AS hybrid_score, 'vector_fallback' AS search_method, search_rank FROM r
""")
def vector_fallback(spark, sf):
    """TK4."""
    h = dense.vector_fallback(_dense_q(spark, sf), _points(spark, sf), 5)
    return h.select("query_id", "point_id", F.round("hybrid_score", 6).alias("hybrid_score"),
                    "search_method", "search_rank")


@register("multi_vector_search", sql=f"""
WITH s AS {dense_dot("(SELECT vec_id AS qid, embedding AS vec FROM embeddings)", EMB_P)},
f AS (SELECT * FROM s WHERE round(score, 9) >= 0.3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, point_id) AS rk FROM f),
h AS (SELECT query_id // 3 AS request_id, query_id % 3 AS vector_idx, point_id, rk, score FROM r WHERE rk <= 4),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, point_id ORDER BY vector_idx, rk) AS k FROM h) WHERE k = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, point_id) AS rank FROM d)
SELECT request_id, point_id, vector_idx AS query_vector_index, round(score, 6) AS similarity_score, rank FROM t WHERE rank <= 4
""")
def multi_vector_search(spark, sf):
    """TK6 + WN3: three vectors per request (vec_id // 3), first vector's score wins."""
    e = T.table(spark, sf, "embeddings")
    vecs = e.select((F.col("vec_id") / 3).cast("bigint").alias("request_id"),
                    (F.col("vec_id") % 3).cast("bigint").alias("vector_idx"), F.col("embedding").alias("query_vec"))
    h = dense.multi_vector_search(vecs, _points(spark, sf), 4)
    return h.select("request_id", "point_id", "query_vector_index",
                    F.round("similarity_score", 6).alias("similarity_score"), "rank")


def _doc_vectors(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "text")
    return embed.embed(d, "doc_id", "text").select("doc_id", "embedding")


def _bench_vectors(spark, sf):
    b = T.bench_queries(T.table(spark, sf, "benchmark"))
    return embed.embed(b, "query_id", "query", out_col="query_vec").select("query_id", "query_vec")


def _index_vectors(idx):
    """Document vectors from the index's term table (no second tokenisation)."""
    return embed.hashing_vectors_from_terms(idx.terms, "doc_id")


def _hybrid(spark, sf):
    idx = _index(spark, sf)
    q = T.bench_queries(T.table(spark, sf, "benchmark"))
    return hybrid.hybrid_search(q, idx, _index_vectors(idx), _bench_vectors(spark, sf), limit=10)


HYBRID_CTES = f"""
WITH {BM25_CTES},
q AS ({bm25_query_terms('benchmark', 'item_id', 'text')}),
bm AS (SELECT q.query_id, p.doc_id, sum(q.qtf * p.weight) AS score FROM q JOIN bm_post p USING (term) GROUP BY 1, 2),
bm5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rk FROM bm) WHERE rk <= 5),
bmc AS (SELECT b.*, d.text AS content FROM bm5 b JOIN documents d USING (doc_id)),
bml AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY rk DESC) AS r2 FROM bmc) WHERE r2 = 1),
dvec AS {hash_vectors('documents', 'doc_id', 'text')},
qvec AS {hash_vectors('benchmark', 'item_id', 'text')},
vs AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.v * d.v) AS score FROM qvec q JOIN dvec d USING (b) GROUP BY 1, 2),
vs10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rk
                        FROM vs WHERE round(score, 9) >= 0.3) WHERE rk <= 10),
vsc AS (SELECT v.*, d.text AS content FROM vs10 v JOIN documents d USING (doc_id)),
vsl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY rk DESC) AS r2 FROM vsc) WHERE r2 = 1),
f AS (SELECT coalesce(b.query_id, v.query_id) AS query_id, coalesce(b.doc_id, v.doc_id) AS doc_id,
             b.score AS bm25_score, v.score AS vector_score,
             CASE WHEN b.query_id IS NOT NULL AND v.query_id IS NOT NULL THEN 'hybrid'
                  WHEN b.query_id IS NOT NULL THEN 'bm25' ELSE 'vector' END AS search_method
      FROM bml b FULL OUTER JOIN vsl v ON b.query_id = v.query_id AND b.content = v.content),
h AS (SELECT *, CASE search_method WHEN 'hybrid' THEN bm25_score * 0.5 + vector_score * 0.5 + 0.1
                                   WHEN 'bm25' THEN bm25_score * 0.6 ELSE vector_score * 0.6 END AS hs FROM f),
hr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hs, 9) DESC, doc_id) AS rank FROM h)
       WHERE rank <= 10)
"""


@register("hybrid_search", sql=HYBRID_CTES + """
SELECT query_id, doc_id, round(bm25_score, 6) AS bm25_score, round(vector_score, 6) AS vector_score,
       search_method, round(hs, 6) AS hybrid_score, rank FROM hr
""")
def hybrid_search(spark, sf):
    """TK3 (+ JN3, WN9): BM25 top-5 fused with dense top-10 per benchmark text."""
    h = _hybrid(spark, sf)
    return h.select("query_id", "doc_id", F.round("bm25_score", 6).alias("bm25_score"),
                    F.round("vector_score", 6).alias("vector_score"), "search_method",
                    F.round("hybrid_score", 6).alias("hybrid_score"), F.col("rank").cast("bigint").alias("rank"))


@register("method_breakdown", sql=HYBRID_CTES + """
SELECT query_id, count(*) AS n_hits, count(*) FILTER (WHERE search_method = 'hybrid') AS n_hybrid,
       count(*) FILTER (WHERE search_method = 'bm25') AS n_bm25_only,
       count(*) FILTER (WHERE search_method = 'vector') AS n_vector_only
FROM hr GROUP BY query_id
""")
def method_breakdown(spark, sf):
    """AG11: hit counts by method per query."""
    return hybrid.method_breakdown(_hybrid(spark, sf))


@register("embed_cells", sql=f"""
SELECT id AS doc_id, b AS bucket, round(v, 6) AS value FROM {hash_vectors('documents', 'doc_id', 'text')} WHERE v <> 0
""")
def embed_cells(spark, sf):
    """EM1 (hashing encoder): non-zero cells of every document vector."""
    v = _doc_vectors(spark, sf)
    cells = v.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).filter(F.col("value") != 0)
    return cells.select("doc_id", F.col("bucket").cast("int").alias("bucket"), F.round("value", 6).alias("value"))


@register("normalise_vectors", sql="""
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm_before,
       round(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))
                 * (x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))))), 6) AS norm_after
FROM embeddings
""")
def normalise_vectors_q(spark, sf):
    """EM3: L2 normalisation (norm before and after)."""
    e = T.table(spark, sf, "embeddings")
    n = embed.normalise_vectors(e, "embedding", "unit")
    return n.select("vec_id", F.round(embed.vector_norm(F.col("embedding")), 6).alias("norm_before"),
                    F.round(embed.vector_norm(F.col("unit")), 6).alias("norm_after"))


def _variants(spark, sf):
    return T.query_variants(T.table(spark, sf, "benchmark"))


def _variant_vectors(spark, sf):
    v = _variants(spark, sf).withColumn("vid", F.col("request_id") * 3 + F.col("variant_idx"))
    e = embed.embed(v, "vid", "query", out_col="query_vec")
    return e.select("request_id", "variant_idx", "query_vec")


MQ_SQL = HYBRID_CTES.replace("WHERE rank <= 10)", "WHERE rank <= 4)").replace("WHERE rk <= 10)", "WHERE rk <= 4)") + """,
t AS (SELECT hr.*, d.text AS content, b.text AS retrieval_query, hr.query_id // 3 AS request_id, hr.query_id % 3 AS variant_idx
      FROM hr JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = hr.query_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, content ORDER BY variant_idx, rank) AS kk FROM t) WHERE kk = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY variant_idx, rank) AS position FROM k)
"""


@register("multi_query_hybrid", sql=MQ_SQL + """
SELECT request_id, position, doc_id, variant_idx, retrieval_query, round(hs, 6) AS hybrid_score, search_method FROM p
""")
def multi_query_hybrid(spark, sf):
    """TK5 + WN2: three variants per request (item_id // 3), hybrid top-4 each,
    first-seen dedup by content across the variants."""
    idx = _index(spark, sf)
    out = hybrid.multi_query_retrieve(_variants(spark, sf), idx, _index_vectors(idx),
                                      _variant_vectors(spark, sf), top_k_=4)
    return out.select("request_id", "position", "doc_id", F.col("variant_idx").cast("bigint").alias("variant_idx"),
                      "retrieval_query", F.round("hybrid_score", 6).alias("hybrid_score"), "search_method")


@register("multi_query_vector", sql=f"""
WITH dvec AS {hash_vectors('documents', 'doc_id', 'text')},
qvec AS {hash_vectors('benchmark', 'item_id', 'text')},
vs AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.v * d.v) AS score FROM qvec q JOIN dvec d USING (b) GROUP BY 1, 2),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
                     FROM vs WHERE round(score, 9) >= 0.3) WHERE rank <= 4),
t AS (SELECT r.*, d.text AS content, b.text AS retrieval_query, r.query_id // 3 AS request_id, r.query_id % 3 AS variant_idx
      FROM r JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = r.query_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, content ORDER BY variant_idx, rank) AS kk FROM t) WHERE kk = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY variant_idx, rank) AS position FROM k)
SELECT request_id, position, doc_id, variant_idx, retrieval_query, round(score, 6) AS similarity_score,
       'vector_fallback' AS search_method FROM p
""")
def multi_query_vector(spark, sf):
    """TK5 vector-only fallback with first-seen dedup."""
    docs = T.search_documents(T.table(spark, sf, "documents"))
    out = hybrid.multi_query_vector(_variants(spark, sf), docs, _doc_vectors(spark, sf),
                                    _variant_vectors(spark, sf), top_k_=4)
    return out.select("request_id", "position", "doc_id", F.col("variant_idx").cast("bigint").alias("variant_idx"),
                      "retrieval_query", F.round("similarity_score", 6).alias("similarity_score"), "search_method")


@register("rerank_top5", sql=MQ_SQL + """,
sc AS (SELECT p.request_id, p.doc_id, p.position, l.quality + 0.5 * (1 - l.toxic) AS relevance_score
       FROM p JOIN labels l USING (doc_id) WHERE trim(p.content) <> ''),
has AS (SELECT DISTINCT request_id FROM sc),
rk AS (SELECT request_id, doc_id, position, relevance_score,
              row_number() OVER (PARTITION BY request_id ORDER BY relevance_score DESC, position) AS rerank_rank FROM sc),
fb AS (SELECT request_id, doc_id, position, NULL::DOUBLE AS relevance_score,
              row_number() OVER (PARTITION BY request_id ORDER BY position) AS rerank_rank
       FROM p WHERE request_id NOT IN (SELECT request_id FROM has))
SELECT * FROM rk WHERE rerank_rank <= 5 UNION ALL SELECT * FROM fb WHERE rerank_rank <= 5
""")
def rerank_top5(spark, sf):
    """TK7 + JN6: rerank the multi-query hits with a score table derived from
    ``labels`` (quality + 0.5 * non-toxic); unscored requests keep retrieval order."""
    idx = _index(spark, sf)
    hits = hybrid.multi_query_retrieve(_variants(spark, sf), idx, _index_vectors(idx),
                                       _variant_vectors(spark, sf), top_k_=4)
    lab = T.table(spark, sf, "labels")
    scores = hits.select("request_id", "doc_id").join(lab, "doc_id").select(
        "request_id", "doc_id", (F.col("quality") + 0.5 * (1 - F.col("toxic"))).cast("double").alias("relevance_score"))
    r = hybrid.rerank(hits, scores, top_n=5)
    return r.select("request_id", "doc_id", "position", "relevance_score",
                    F.col("rerank_rank").cast("bigint").alias("rerank_rank"))


@register("similarity_top3", sql=f"""
WITH dvec AS {hash_vectors('documents', 'doc_id', 'text')},
qvec AS {hash_vectors('benchmark', 'item_id', 'text')},
vs AS (SELECT q.id AS item_id, d.id AS doc_id, sum(q.v * d.v) AS cosine FROM qvec q JOIN dvec d USING (b) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(cosine, 9) DESC, doc_id) AS rank FROM vs)
SELECT item_id, doc_id, round(cosine, 6) AS cosine, rank FROM r WHERE rank <= 3
""")
def similarity_top3(spark, sf):
    """EM2 (re-aimed to top-k): the 3 documents most similar to every benchmark text."""
    idx_vecs = _doc_vectors(spark, sf)
    b = _bench_vectors(spark, sf)
    s = dense.similarity_top_k(b, idx_vecs, 3, a_id="query_id", b_id="doc_id", a_vec="query_vec", b_vec="embedding")
    return s.select(F.col("query_id").alias("item_id"), "doc_id", F.round("cosine", 6).alias("cosine"), "rank")
