"""Hybrid retrieval: fusion (TK3, JN3, WN9), multi-query retrieval (TK5,
WN2), hit breakdown (AG11) and rerank (TK7, JN6).

Hit lists are small per query (<= k rows), but there is one list per query
of a whole query table, so every step is a grouped DataFrame operation keyed
by the query; "first"/"last" row picks use ``min``/``max`` over structs
(partial aggregation) instead of windows wherever the order is the only
reason for the window.

Equal contents are one result.  The hit documents get a canonical id, the
smallest hit id with the same content (compared by SHA-256, computed where the
document is read), and every later step uses that id: no text is a join or
group key, and none is broadcast.  Texts are fetched once, for the final hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as FV
from tessera.operators import dense, lexical
from tessera.operators.lexical import attach_documents, top_k
from tessera.session import broadcast_if_small


def canonical_ids(hit_ids: DataFrame, docs: DataFrame, key: str = "content") -> DataFrame:
    """(doc_id, canon): the smallest of the hit ids whose ``key`` is equal."""
    found = attach_documents(hit_ids.select("doc_id").distinct(), docs, [key]).select(
        "doc_id", F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256).alias("digest"))
    canon = found.groupBy("digest").agg(F.collect_list("doc_id").alias("ids"), F.min("doc_id").alias("canon"))
    return canon.select(F.explode("ids").alias("doc_id"), "canon")


def last_wins(hits: DataFrame, part: list[str], key: str, rank_col: str, cols: list[str]) -> DataFrame:
    """WN9: inside one hit list a repeated ``key`` keeps its last (highest
    rank number, i.e. lowest score) occurrence."""
    last = hits.groupBy(*part, key).agg(F.max(F.struct(rank_col, *cols)).alias("_l"))
    return last.select(*part, key, *[F.col(f"_l.{c}").alias(c) for c in [rank_col, *cols]])


def fuse(bm: DataFrame, vec: DataFrame, limit: int, keys: list[str] | None = None) -> DataFrame:
    """TK3 on two hit lists (keys, canon, doc_id, score): 0.5*b + 0.5*v + 0.1
    when both hold the canonical id, else 0.6*b or 0.6*v; top ``limit``."""
    keys = keys or ["query_id"]
    b = bm.select(*keys, "canon", F.col("doc_id").alias("b_doc"), "bm25_score")
    v = vec.select(*keys, "canon", F.col("doc_id").alias("v_doc"), "vector_score")
    both, one = FV.HYBRID_BOTH_WEIGHT, FV.HYBRID_SINGLE_WEIGHT
    in_b, in_v = F.col("b_doc").isNotNull(), F.col("v_doc").isNotNull()
    fused = b.join(v, [*keys, "canon"], "full_outer").select(
        *keys, "canon", F.coalesce("b_doc", "v_doc").alias("doc_id"), "bm25_score", "vector_score",
        F.when(in_b & in_v, "hybrid").when(in_b, "bm25").otherwise("vector").alias("search_method"),
        F.when(in_b & in_v, F.col("bm25_score") * both + F.col("vector_score") * both + FV.HYBRID_BOTH_BONUS)
         .when(in_b, F.col("bm25_score") * one).otherwise(F.col("vector_score") * one).alias("hybrid_score"))
    return top_k(fused, keys, [F.round("hybrid_score", 9).desc(), F.col("doc_id")], limit)


def hybrid_search(queries: DataFrame, index: lexical.Bm25Index, doc_vectors: DataFrame,
                  query_vectors: DataFrame, limit: int = FV.HYBRID_LIMIT, bm25_k: int = FV.BM25_TOP_K,
                  key: str = "content", threshold: float = FV.DENSE_THRESHOLD,
                  keys: list[str] | None = None) -> DataFrame:
    """TK3: fuse BM25 top-``bm25_k`` and dense top-``limit`` per query.

    queries: (keys, query); doc_vectors: (doc_id, embedding); query_vectors:
    (keys, query_vec); ``keys`` name a query (``query_id`` by default).
    Returns (keys, canon, doc_id, scores, search_method, rank) without texts.
    """
    from tessera.sources.jsonl import scratch_path
    keys = keys or ["query_id"]
    spark = index.terms.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)    # a hit list: at most k rows per query
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    bm = kept(lexical.bm25_top_k(index, queries, bm25_k, keys=keys, rank_col="bm_rank"), "bm25-hits")
    vec = dense.dense_candidates(query_vectors, dense.stored(doc_vectors, "doc-vectors").withColumnRenamed("doc_id", "point_id"),
                                 limit, threshold, keys=keys)
    vec = kept(vec.select(*keys, F.col("point_id").alias("doc_id"), F.col("score").alias("vector_score"),
                          F.col("search_rank").alias("vec_rank")), "vector-hits")
    canon = broadcast_if_small(canonical_ids(bm.select("doc_id").unionByName(vec.select("doc_id")), index.docs, key))
    bm = last_wins(bm.join(canon, "doc_id"), keys, "canon", "bm_rank", ["doc_id", "bm25_score"])
    vec = last_wins(vec.join(canon, "doc_id"), keys, "canon", "vec_rank", ["doc_id", "vector_score"])
    return fuse(bm, vec, limit, keys)


def first_seen_dedup(hits: DataFrame, request: str, variant: str, rank: str, key: str,
                     cols: list[str]) -> DataFrame:
    """WN2/WN3: keep the first occurrence of ``key`` in (variant, rank) order."""
    first = hits.groupBy(request, key).agg(F.min(F.struct(variant, rank, *cols)).alias("_f"))
    out = first.select(request, key, *[F.col(f"_f.{c}").alias(c) for c in [variant, rank, *cols]])
    # position in the merged list: variants in order, each in its rank order
    return top_k(out, request, [F.col(variant), F.col(rank)], 1 << 30, "position") \
        .withColumn("position", F.col("position").cast("bigint"))


def multi_query_retrieve(variants: DataFrame, index: lexical.Bm25Index | None, doc_vectors: DataFrame,
                         variant_vectors: DataFrame, top_k_: int = 5, key: str = "content",
                         docs: DataFrame | None = None) -> DataFrame:
    """TK5: every variant is searched (hybrid, or vector-only when ``index`` is
    None; ``docs`` then supplies the texts) with ``top_k_`` hits; across a
    request's variants a content is kept once (first variant, best rank) and
    tagged with ``retrieval_query``.

    variants: (request_id, variant_idx, query); variant_vectors:
    (request_id, variant_idx, query_vec).
    """
    keys = ["request_id", "variant_idx"]
    if index is None:
        return multi_query_vector(variants, docs, doc_vectors, variant_vectors, top_k_, key)
    hits = hybrid_search(variants.select(*keys, "query"), index, doc_vectors, variant_vectors.select(*keys, "query_vec"),
                         limit=top_k_, key=key, keys=keys)
    out = first_seen_dedup(hits, "request_id", "variant_idx", "rank", "canon",
                           ["doc_id", "hybrid_score", "search_method"])
    return _with_texts(out, index.docs, variants, key)


def multi_query_vector(variants: DataFrame, docs: DataFrame, doc_vectors: DataFrame,
                       variant_vectors: DataFrame, top_k_: int = 5, key: str = "content") -> DataFrame:
    """TK5 fallback: vector-only retrieval per variant with first-seen dedup."""
    keys = ["request_id", "variant_idx"]
    hits = dense.dense_candidates(variant_vectors.select(*keys, "query_vec"),
                                  dense.stored(doc_vectors, "doc-vectors").withColumnRenamed("doc_id", "point_id"), top_k_,
                                  FV.DENSE_THRESHOLD, keys=keys)
    hits = hits.select(*keys, F.col("point_id").alias("doc_id"), F.col("search_rank").alias("rank"),
                       F.col("score").alias("similarity_score"))
    canon = broadcast_if_small(canonical_ids(hits, docs, key))
    out = first_seen_dedup(hits.join(canon, "doc_id"), "request_id", "variant_idx", "rank", "canon",
                           ["doc_id", "similarity_score"])
    out = out.withColumn("search_method", F.lit("vector_fallback"))
    return _with_texts(out, docs, variants, key)


def _with_texts(hits: DataFrame, docs: DataFrame, variants: DataFrame, key: str) -> DataFrame:
    """The final hits with their document's ``key`` and the variant's query."""
    full = attach_documents(hits.withColumn("search_method", _code("search_method")), docs, [key])
    full = full.withColumn("search_method", _name("search_method"))
    return full.join(variants.select("request_id", "variant_idx", F.col("query").alias("retrieval_query")),
                     ["request_id", "variant_idx"])


_METHODS = ["hybrid", "bm25", "vector", "vector_fallback"]


def _code(col: str) -> F.Column:
    return F.array_position(F.array(*map(F.lit, _METHODS)), F.col(col)).cast("int")


def _name(col: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, _METHODS)), F.col(col))


def method_breakdown(hits: DataFrame, part: str = "query_id") -> DataFrame:
    """AG11: per query, hits by search method (hybrid = overlaps)."""
    return hits.groupBy(part).agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.count_if(F.col("search_method") == "hybrid").alias("n_hybrid"),
        F.count_if(F.col("search_method") == "bm25").alias("n_bm25_only"),
        F.count_if(F.col("search_method") == "vector").alias("n_vector_only"))


def rerank(docs: DataFrame, scores: DataFrame | None, top_n: int = FV.RERANK_TOP_N,
           request: str = "request_id", position: str = "position", key: str = "doc_id",
           content: str = "content") -> DataFrame:
    """TK7: attach relevance_score from a score table and keep the top ``top_n``.

    Rows with blank content are not eligible; a request without any score row
    (or with no eligible row) keeps its first ``top_n`` rows in retrieval order.
    """
    if scores is None:
        return top_k(docs, request, [F.col(position)], top_n, "rerank_rank") \
            .withColumn("relevance_score", F.lit(None).cast("double"))
    eligible = docs.filter(F.trim(F.coalesce(F.col(content), F.lit(""))) != "")
    scored = eligible.join(scores.select(request, key, "relevance_score"), [request, key], "inner")
    ranked = top_k(scored, request, [F.col("relevance_score").desc(), F.col(position)], top_n, "rerank_rank")
    has = scored.select(request).distinct()
    fallback = top_k(docs.join(has, request, "left_anti"), request, [F.col(position)], top_n, "rerank_rank") \
        .withColumn("relevance_score", F.lit(None).cast("double"))
    return ranked.unionByName(fallback)
