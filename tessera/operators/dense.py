"""Dense (vector) search: TK1, TK4, TK6 and the similarity kernel of EM2.

Plan for ``dense_search(queries, points)``:

1. payload filters are applied to ``points`` first (pushed into the scan);
   vectors that are NULL, empty or hold a NULL or non-finite component are left
   out on either side, and only vectors of equal length are compared;
2. points and queries are dealt into groups by a hash of their keys; a group
   of points meets every group of queries once, on one partition, the points
   first.  A row is one vector: each is copied once per group of the other
   side, and there are few groups, because a group of points has a bounded size
   in bytes.  Query vectors never visit the driver, and the plan is the same
   for one query and for millions;
3. one ``mapInArrow`` holds the points of a group, lets the queries pass in
   batches, scores ``query_block`` x ``point_block`` of them at a time with a
   matrix product and keeps ``k`` points per query (score >= threshold);
4. a per-query ``row_number() <= k`` (planned as WindowGroupLimit, partial
   before the shuffle) picks the global top-k.

Ties are broken on the point id everywhere, with scores compared after
rounding to 9 decimals so both local and global selections use the same
total order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import fixed_values as FV
from tessera.operators.lexical import top_k
from tessera.operators.prep import payload_filter

_SCORE_DECIMALS = 9
# the score matrix of a step is query_block x point_block doubles
QUERY_BLOCK, POINT_BLOCK = 512, 4096
# bytes of points, as doubles, that a task holds; groups that a smaller table is
# dealt into, and meetings of groups that keep a cluster busy
GROUP_BYTES, SPREAD, MEETINGS = 32 << 20, 8, 64


def usable_vector(vec_col: str) -> Column:
    """Neither null nor empty, every component a finite number."""
    return F.coalesce(F.size(vec_col) > 0, F.lit(False)) & F.forall(
        vec_col, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Equal-length vectors of one block as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int, threshold: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``k`` of every row by score, then id."""
    keep = np.ones(scores.shape, dtype=bool) if threshold is None else scores >= threshold
    if scores.shape[1] > k:
        # nothing below a row's k-th largest score can be chosen; ties at it can
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        keep &= scores >= kth[:, None]
    rows, cols = np.nonzero(keep)
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(scores.shape[0]))
    chosen = np.arange(len(rows)) - first[rows] < k
    return rows[chosen], cols[chosen]


def _merged(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the first ``k`` of every row over several parts."""
    rows, ids, scores = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    chosen = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[chosen], ids[chosen], scores[chosen]


def _groups(n_queries: int, n_points: int, dim: int, query_block: int, point_block: int) -> tuple[int, int]:
    """Numbers of query groups and of point groups."""
    points = max(1, -(-n_points * 8 * max(1, dim) // GROUP_BYTES), min(SPREAD, -(-n_points // point_block)))
    return max(1, min(-(-MEETINGS // points), -(-n_queries // query_block))), points


def _meeting(queries: DataFrame, points: DataFrame, keys: list[str], point_key: str, groups: tuple[int, int],
             order: list[str]) -> DataFrame:
    """Rows of both sides, with equal columns, dealt so that a group of points
    (``_side`` below 2) stands before the queries (``_side`` 2) of a group."""
    g, h = groups
    q = queries.withColumn("_i", F.pmod(F.xxhash64(*keys), F.lit(g)).cast("int")).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
    p = points.withColumn("_j", F.pmod(F.xxhash64(point_key), F.lit(h)).cast("int")).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    both = q.withColumn("_side", F.lit(2)).unionByName(p, allowMissingColumns=True)
    spot = ["dim", "_i", "_j"]
    return both.repartition(*spot).sortWithinPartitions(*spot, "_side", *order)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """(meeting, side, rows) of every run of rows of one side."""
    for b in batches:
        spots = np.stack([b.column(c).to_numpy() for c in ("dim", "_i", "_j", "_side")])
        edges = np.flatnonzero((spots[:, 1:] != spots[:, :-1]).any(axis=0)) + 1
        for at, end in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
            if at < end:
                yield tuple(spots[:3, at].tolist()), int(spots[3, at]), b.slice(at, end - at)


def _element(*columns: tuple[DataFrame, str]) -> str:
    """The array type that all these vector columns keep their values in."""
    return "array<float>" if all(dict(df.dtypes)[c] == "array<float>" for df, c in columns) else "array<double>"


def stored(vectors: DataFrame, name: str) -> DataFrame:
    """``vectors`` written to the shared folder and read back: derived vectors
    are computed once, not once per job of a search."""
    from tessera.sources.jsonl import scratch_path
    path = scratch_path(vectors.sparkSession, name)
    vectors.write.parquet(path)
    return vectors.sparkSession.read.schema(vectors.schema).parquet(path)


def dense_candidates(queries: DataFrame, points: DataFrame, k: int, threshold: float | None,
                     id_col: str = "point_id", vec_col: str = "embedding", qvec_col: str = "query_vec",
                     keys: list[str] | None = None, query_block: int = QUERY_BLOCK,
                     point_block: int = POINT_BLOCK) -> DataFrame:
    """(keys, point_id, score, search_rank) for the top-k points of every
    query; ``keys`` name the query and are carried as they are."""
    keys = keys or ["query_id"]
    kind = _element((queries, qvec_col), (points, vec_col))
    q = queries.filter(usable_vector(qvec_col)).select(*keys, F.col(qvec_col).cast(kind).alias("_vec"), F.size(qvec_col).alias("dim"))
    p = points.filter(usable_vector(vec_col)).select(
        F.col(id_col).cast("long").alias("_point"), F.col(vec_col).cast(kind).alias("_vec"), F.size(vec_col).alias("dim"))
    size = p.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    groups = _groups(q.count(), size["n"], size["dim"] or 1, query_block, point_block)
    schema = T.StructType([*q.select(*keys).schema.fields, T.StructField("point_id", T.LongType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for spot, side, rows in _runs(batches):
            if spot != at:
                at, held = spot, []
            if side < 2:
                held.append((rows.column("_point").to_numpy(), _matrix(rows.column("_vec"))))
            elif held:
                if len(held) > 1:
                    held = [(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
                ids, points = held[0]
                for i in range(0, rows.num_rows, query_block):
                    some = rows.slice(i, query_block)
                    x, parts = _matrix(some.column("_vec")), []
                    for j in range(0, len(ids), point_block):
                        scores = np.round(x @ points[j:j + point_block].T, _SCORE_DECIMALS)
                        r, c = _best(scores, ids[j:j + point_block], k, threshold)
                        parts.append((r, ids[j + c], scores[r, c]))
                    r, found, score = _merged(parts, k)
                    yield pa.RecordBatch.from_arrays(
                        [*(some.column(c).take(pa.array(r)) for c in keys), pa.array(found), pa.array(score)],
                        names=[*keys, "point_id", "score"])

    met = _meeting(q, p.withColumn("_side", F.lit(1)), keys, "_point", groups, [])
    found = met.select("dim", "_i", "_j", "_side", *keys, "_point", "_vec").mapInArrow(run, schema)
    return top_k(found, keys, [F.col("score").desc(), F.col("point_id")], k, "search_rank")


def dense_search(queries: DataFrame, points: DataFrame, limit: int = FV.DENSE_LIMIT,
                 filters: dict | None = None, threshold: float | None = FV.DENSE_THRESHOLD,
                 payload: list[str] | None = None, id_col: str = "point_id",
                 vec_col: str = "embedding", keys: list[str] | None = None) -> DataFrame:
    """TK1: top ``limit`` points per query with score >= threshold, payload
    attached (vectors not returned), ``similarity_score`` and ``search_rank``."""
    pts = payload_filter(points, filters)
    hits = dense_candidates(queries, pts, limit, threshold, id_col, vec_col, keys=keys)
    hits = hits.withColumnRenamed("score", "similarity_score").withColumnRenamed("point_id", id_col)
    if payload:
        # hits are at most limit x |queries| rows; the point side is column-pruned
        hits = hits.join(pts.select(id_col, *payload), id_col)
    return hits.withColumn("search_rank", F.col("search_rank").cast("bigint"))


def vector_fallback(queries: DataFrame, points: DataFrame, limit: int = FV.FALLBACK_LIMIT,
                    payload: list[str] | None = None, id_col: str = "point_id") -> DataFrame:
    """TK4: vector hits only; hybrid_score = similarity, method 'vector_fallback'."""
    hits = dense_search(queries, points, limit, None, FV.DENSE_THRESHOLD, payload, id_col)
    return hits.withColumn("search_method", F.lit("vector_fallback")) \
               .withColumn("hybrid_score", F.col("similarity_score"))


def multi_vector_search(vectors: DataFrame, points: DataFrame, limit: int = FV.DENSE_LIMIT,
                        filters: dict | None = None, dedup_key: str = "point_id") -> DataFrame:
    """TK6 + WN3: several vectors per request (request_id, vector_idx, query_vec).

    Each vector is searched with ``limit``; a point seen again keeps the score
    of the *first* vector that found it; then the request's hits are sorted by
    that score and cut to ``limit``.
    """
    hits = dense_search(vectors, points, limit, filters, keys=["request_id", "vector_idx"])
    # first vector wins: min over (vector_idx, rank) per (request, point); partial aggregation, no window
    first = hits.groupBy("request_id", dedup_key).agg(
        F.min(F.struct("vector_idx", "search_rank", "similarity_score")).alias("f"))
    first = first.select("request_id", dedup_key, F.col("f.vector_idx").alias("query_vector_index"),
                         F.col("f.similarity_score").alias("similarity_score"))
    ranked = top_k(first, "request_id", [F.col("similarity_score").desc(), F.col(dedup_key)], limit)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def similarity_top_k(a: DataFrame, b: DataFrame, k: int, a_id: str = "a_id", b_id: str = "b_id",
                     a_vec: str = "a_vec", b_vec: str = "b_vec") -> DataFrame:
    """EM2 (re-aimed): cosine similarity between two tables, keeping the ``k``
    most similar b-rows of every a-row (exact).  The full a x b matrix of the
    original API is never materialised: scores are reduced to a
    top-k inside each task."""
    from tessera.operators.embed import normalise_vectors
    an = normalise_vectors(a.select(F.col(a_id).alias("query_id"), F.col(a_vec).alias("query_vec")), "query_vec")
    bn = normalise_vectors(b.select(F.col(b_id).alias("point_id"), F.col(b_vec).alias("embedding")), "embedding")
    # blocks are counted before they are built: keep what was derived
    out = dense_candidates(stored(an, "a-vectors"), stored(bn, "b-vectors"), k, None)
    return out.select(F.col("query_id").alias(a_id), F.col("point_id").alias(b_id), F.col("score").alias("cosine"),
                      F.col("search_rank").cast("bigint").alias("rank"))
