"""Chunking (CH1-CH4) and point-table maintenance (SNK8-SNK11, WN7, AG9).

Chunking is per document (one row in, its chunks out), so it parallelises
over documents with no shuffle; only the semantic splitter groups sentences
of one document, which is bounded by that document's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import fixed_values as FV
from tessera.functions.text import once, tokens, whitespace_tokens
from tessera.operators import embed as E


def chunk_tokens(df: DataFrame, text_col: str = "text", size: int = FV.CHUNK_TOKENS,
                 overlap: int = FV.CHUNK_OVERLAP, keys: list[str] | None = None) -> DataFrame:
    """CH1: windows of ``size`` whitespace tokens advancing by ``size - overlap``;
    the last window is the first one that reaches the end of the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in [0, size)")
    keys = keys or ["doc_id"]
    step = size - overlap
    toks = whitespace_tokens(text_col)
    t = df.select(*keys, once(toks).alias("_t")).withColumn("_n", F.size("_t"))
    n_win = F.when(F.col("_n") <= size, 1).otherwise(F.ceil((F.col("_n") - size) / step) + 1)
    starts = F.sequence(F.lit(0), (n_win - 1) * step, F.lit(step))
    # the chunks are built inside the row, so the token array is not copied
    # into every exploded chunk row
    chunks = F.transform(starts, lambda s: F.struct(
        F.least(F.lit(size), F.col("_n") - s).alias("n_tokens"),
        F.array_join(F.slice(F.col("_t"), s + 1, size), " ").alias("content")))
    out = t.filter(F.col("_n") > 0).select(*keys, F.posexplode(chunks).alias("chunk_idx", "_c"))
    return out.select(*keys, F.col("chunk_idx").cast("int").alias("chunk_idx"),
                      F.col("_c.n_tokens").alias("n_tokens"), F.col("_c.content").alias("content"))


SENTENCE_SPLIT = r"(?<=[.!?])[\s\p{Z}]+"


def sentences(df: DataFrame, text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """(keys, sent_idx, sentence, n_tokens); sentences end at . ! ? followed by whitespace."""
    keys = keys or ["doc_id"]
    s = df.select(*keys, F.posexplode(F.split(F.trim(F.coalesce(F.col(text_col), F.lit(""))), SENTENCE_SPLIT))
                  .alias("sent_idx", "sentence"))
    s = s.filter(F.col("sentence") != "")
    return s.withColumn("n_tokens", F.size(whitespace_tokens("sentence")))


def _sentence_array(text_col: str) -> F.Column:
    parts = F.split(F.trim(F.coalesce(F.col(text_col), F.lit(""))), SENTENCE_SPLIT)
    return F.filter(parts, lambda x: x != "")


def _assemble(df: DataFrame, keys: list[str], sizes: bool) -> DataFrame:
    """Chunks from the columns ``_s`` (sentences) and ``_starts`` (index of the
    first sentence of every chunk): each sentence is copied once."""
    n = F.size("_s")
    end = lambda i: F.coalesce(F.get("_starts", i + 1), n)
    part = lambda a, i, s: F.slice(a, s + 1, end(i) - s)
    chunk = lambda s, i: F.struct(
        *([F.aggregate(part(F.col("_n"), i, s), F.lit(0), lambda a, x: a + x).alias("n_tokens")] if sizes else []),
        F.array_join(part(F.col("_s"), i, s), " ").alias("content"))
    out = df.filter(n > 0).select(*keys, F.posexplode(F.transform("_starts", chunk)).alias("chunk_idx", "_c"))
    return out.select(*keys, F.col("chunk_idx").cast("int").alias("chunk_idx"),
                      *([F.col("_c.n_tokens").alias("n_tokens")] if sizes else []), F.col("_c.content").alias("content"))


def chunk_sentences(df: DataFrame, text_col: str = "text", size: int = FV.SENTENCE_CHUNK_TOKENS,
                    keys: list[str] | None = None) -> DataFrame:
    """CH2: pack whole sentences greedily up to ``size`` tokens (a longer
    sentence is a chunk of its own).  Packing is sequential: a small Arrow
    function walks the sentence lengths of a document once and returns where
    chunks start; the texts stay in the JVM."""
    keys = keys or ["doc_id"]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def starts(lengths: pd.Series) -> pd.Series:
        out = []
        for row in lengths:
            at, held = [], 0
            for i, n in enumerate(row):
                if i == 0 or (held and held + n > size):
                    at.append(i)
                    held = 0
                held += n
            out.append(at)
        return pd.Series(out)

    s = df.select(*keys, once(_sentence_array(text_col)).alias("_s"))
    s = s.withColumn("_n", F.transform("_s", lambda x: F.size(whitespace_tokens(x))))
    return _assemble(s.withColumn("_starts", starts("_n")), keys, True)


def chunk_semantic(df: DataFrame, text_col: str = "text", buffer: int = 1, pct: float = 95.0,
                   encoder=None, keys: list[str] | None = None) -> DataFrame:
    """CH3: embed each sentence with its +-``buffer`` neighbours, measure the
    cosine distance between consecutive groups and cut where it exceeds the
    document's ``pct`` percentile (exact, interpolated; distances are compared
    at 9 decimals).  Everything about a document happens in its own row and
    nothing is shuffled.  With the hashing encoder each sentence is tokenised
    once, in the JVM, and a group's vector is the sum of its sentences'.
    ``encoder`` is a ``HashingEncoder`` or an encoder factory."""
    keys = keys or ["doc_id"]

    def cuts(v: np.ndarray) -> list[int]:
        """First sentences of the chunks, from the vectors of the groups."""
        n = len(v)
        if n < 2:
            return [0] * n
        norm = np.sqrt((v * v).sum(axis=1))
        both = norm[1:] * norm[:-1]
        cos = np.divide((v[1:] * v[:-1]).sum(axis=1), both, out=np.zeros(n - 1), where=both > 0)
        dist = np.round(1.0 - cos, 9)
        return [0, *(np.flatnonzero(dist > np.round(np.percentile(dist, pct), 9)) + 1).tolist()]

    s = df.select(*keys, once(_sentence_array(text_col)).alias("_s"))
    if encoder is None or isinstance(encoder, E.HashingEncoder):
        dim = (encoder or E.HashingEncoder()).dim

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def starts(docs: pa.Array) -> pa.Array:
            # one vector per sentence; a group is the sum of its sentences
            single = E.token_vectors(docs.flatten(), dim)
            ends = np.concatenate([[0], np.cumsum(docs.value_lengths().to_numpy())]).astype(np.int64)
            out = []
            for a, b in zip(ends[:-1], ends[1:]):
                run = np.concatenate([np.zeros((1, dim)), np.cumsum(single[a:b], axis=0)])
                i = np.arange(b - a)
                out.append(cuts(E.unit_rows(run[np.minimum(i + buffer + 1, b - a)] - run[np.maximum(i - buffer, 0)])))
            return pa.array(out, pa.list_(pa.int32()))

        words = F.transform("_s", lambda x: tokens(E.prepare_text(x)))
        return _assemble(s.withColumn("_starts", starts(words)), keys, False)

    factory = E.encoder_factory(encoder)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def starts_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = factory()
        for docs in batches:
            out = []
            for sentences in docs:
                n = len(sentences)
                groups = [" ".join(sentences[max(0, i - buffer):i + buffer + 1]) for i in range(n)]
                out.append(cuts(np.asarray(enc.encode([g.replace("\n", " ").strip(" ") for g in groups]), dtype=np.float64))
                           if n > 1 else [0] * n)
            yield pd.Series(out)

    return _assemble(s.withColumn("_starts", starts_of("_s")), keys, False)


def point_ids(df: DataFrame, doc_col: str = "doc_id", idx_col: str = "chunk_idx",
              stride: int = FV.POINT_ID_STRIDE) -> DataFrame:
    """CH4: ``chunk_key`` (document, chunk) is the identity of a point;
    ``point_id`` = doc_id * 1000 + chunk_idx is the number derived from it, for
    stores that want one.  Beyond ``stride`` chunks the number would collide
    with the next document's, so it is NULL there; the key still holds."""
    pid = F.when(F.col(idx_col) < stride, F.col(doc_col) * stride + F.col(idx_col))
    return df.withColumn("point_id", pid.cast("bigint")).withColumn(
        "chunk_key", F.concat_ws(":", F.col(doc_col).cast("string"), F.col(idx_col).cast("string")))


def latest_per_id(batch: DataFrame, id_col: str = "point_id", seq_col: str = "seq") -> DataFrame:
    """WN7: last write wins per id (aggregate over a struct, partial-aggregated)."""
    cols = [c for c in batch.columns if c not in (id_col, seq_col)]
    last = batch.groupBy(id_col).agg(F.max(F.struct(seq_col, *cols)).alias("_l"))
    return last.select(id_col, *[F.col(f"_l.{c}").alias(c) for c in [seq_col, *cols]])


def upsert_points(base: DataFrame, batch: DataFrame, id_col: str = "point_id", seq_col: str = "seq") -> DataFrame:
    """SNK8: insert-or-replace by id (anti join + latest rows of the batch)."""
    latest = latest_per_id(batch, id_col, seq_col)
    keep = base.join(latest.select(id_col), id_col, "left_anti")
    return keep.unionByName(latest.select(*base.columns), allowMissingColumns=False)


def delete_points(base: DataFrame, ids: DataFrame, id_col: str = "point_id") -> DataFrame:
    """SNK9 + JN5: delete by id."""
    return base.join(ids.select(id_col).distinct(), id_col, "left_anti")


def scroll_payloads(points: DataFrame, limit: int = FV.SCROLL_LIMIT, id_col: str = "point_id",
                    vec_col: str = "embedding") -> DataFrame:
    """SNK10: payloads without vectors, first ``limit`` by id, with defaults."""
    cols = [c for c in points.columns if c != vec_col]
    p = points.select(*cols).orderBy(id_col).limit(limit)
    if "source" in cols:
        p = p.withColumn("source", F.coalesce(F.col("source"), F.lit("vector_store")))
    else:
        p = p.withColumn("source", F.lit("vector_store"))
    if "doc_id" in cols:
        p = p.withColumn("doc_id", F.coalesce(F.col("doc_id"), F.col(id_col)))
    else:
        p = p.withColumn("doc_id", F.col(id_col))
    return p


def migrate_title_to_question(df: DataFrame, max_len: int = 2000) -> DataFrame:
    """SNK11: rename title -> question, NOT NULL DEFAULT '', length check, 50-char preview."""
    out = df.withColumnRenamed("title", "question").withColumn(
        "question", F.coalesce(F.col("question"), F.lit("")))
    return out.withColumn("question_fits", F.length("question") <= max_len) \
              .withColumn("preview", F.substring(F.coalesce(F.col("content"), F.lit("")), 1, 50))


def collection_stats(points: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """AG9: points, vectors, dimension, status."""
    return points.agg(F.count(F.lit(1)).alias("points_count"), F.count(vec_col).alias("vectors_count"),
                      F.max(F.size(vec_col)).alias("dim")).withColumn(
        "status", F.when(F.col("points_count") > 0, "green").otherwise("empty"))
