"""Embedding jobs (EM1) and vector arithmetic (EM2, EM3).

Two encoder paths:

* ``HashingEncoder`` - signed feature hashing of word tokens.  Tokens are made
  by built-in expressions; an Arrow function hashes the distinct tokens of a
  batch and sums them into the L2-normalised dense vectors (numpy per batch).
  No shuffle and no join: rows keep their partitioning.  For a corpus that
  already has a (doc, term, tf) table, ``hashing_vectors_from_terms`` builds
  the same vectors from it without tokenising again.
* any other encoder is given as a factory: a function without arguments that
  returns an object with ``encode(list[str]) -> np.ndarray``.  It is called
  inside the task, once, so a model is loaded where it runs and never
  pickled with the plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import tokens


@lru_cache(1 << 17)
def _token_cell(token: str, dim: int) -> tuple[int, float]:
    h = hashlib.md5(token.encode("utf-8")).hexdigest()
    return int(h[:8], 16) % dim, 1.0 if int(h[8:10], 16) % 2 == 0 else -1.0


@dataclass(frozen=True)
class HashingEncoder:
    dim: int = 64

    def encode(self, texts: list[str]) -> np.ndarray:
        """The same vectors in numpy, for texts that are already in Python."""
        import regex
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        pat = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
        for i, t in enumerate(texts):
            for tok in pat.split((t or "").lower()):
                if tok:
                    bucket, sign = _token_cell(tok, self.dim)
                    out[i, bucket] += sign
            n = np.linalg.norm(out[i])
            if n > 0:
                out[i] /= n
        return out


def prepare_text(c: Column | str) -> Column:
    """Newline -> space, trim (what is sent to the encoder)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), "\n", " "))


def _bucket_sign(term: Column, dim: int) -> tuple[Column, Column]:
    h = F.md5(term)
    bucket = (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return bucket, sign


def hashing_vectors_from_terms(terms: DataFrame, id_col: str = "doc_id", dim: int = 64,
                               out_col: str = "embedding", term_col: str = "term", tf_col: str = "tf") -> DataFrame:
    """Hashing vectors from an existing (id, term, tf) table (e.g. the BM25
    corpus terms): the same vectors as ``embed`` without tokenising again.
    Ids without any term get no row."""
    bucket, sign = _bucket_sign(F.col(term_col), dim)
    cells = terms.groupBy(id_col, bucket.alias("b")).agg(F.sum(sign * F.col(tf_col)).alias("v"))
    return _dense_from_cells(cells, id_col, dim, out_col)


def _densify(dim: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def densify(buckets: pd.Series, values: pd.Series) -> pd.Series:
        out = np.zeros((len(buckets), dim), dtype=np.float64)
        for i, (b, v) in enumerate(zip(buckets, values)):
            out[i, np.asarray(b, dtype=np.int64)] = np.asarray(v, dtype=np.float64)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        np.divide(out, norms, out=out, where=norms > 0)
        return pd.Series(list(out))
    return densify


def _dense_from_cells(cells: DataFrame, id_col: str, dim: int, out_col: str) -> DataFrame:
    """(id, b, v) cells -> L2-normalised dense vectors.  One group per
    document holding at most ``dim`` cells; the dense array is filled by a
    small Arrow UDF (numpy per batch) instead of per-element map lookups."""
    per_doc = cells.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("b", "v"))).alias("c"))
    return per_doc.select(id_col, _densify(dim)(F.col("c.b"), F.col("c.v")).alias(out_col))


def token_vectors(tokens_of_rows: pa.Array, dim: int) -> np.ndarray:
    """Signed token counts (rows x dim) of lists of tokens: every distinct
    token of the batch is hashed once, the cells are summed in one pass."""
    flat = tokens_of_rows.flatten().dictionary_encode()
    cells = [_token_cell(t, dim) for t in flat.dictionary.to_pylist()]
    buckets = np.array([c[0] for c in cells], dtype=np.int64)
    signs = np.array([c[1] for c in cells], dtype=np.float64)
    at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = tokens_of_rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(tokens_of_rows)), sizes)
    if not len(at):
        return np.zeros((len(tokens_of_rows), dim))
    return np.bincount(rows * dim + buckets[at], weights=signs[at], minlength=len(tokens_of_rows) * dim).reshape(-1, dim)


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows divided by their length; zero rows stay."""
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norms, out=v.copy(), where=norms > 0)


# rows of token lists that are summed at a time
VECTOR_ROWS = 1024


def _hashing_embed(df: DataFrame, id_col: str, text_col: str, dim: int, out_col: str) -> DataFrame:
    """Per row, no shuffle: the JVM makes the tokens, an Arrow function sums
    their cells into the L2-normalised vector; rows keep their partitioning
    and no join back is needed."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def vectors(toks: pa.Array) -> pa.Array:
        # some rows at a time: the work space is many times the tokens
        v = np.concatenate([unit_rows(token_vectors(toks.slice(i, VECTOR_ROWS), dim)) for i in range(0, max(1, len(toks)), VECTOR_ROWS)])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dim, pa.int32()), pa.array(v.ravel()))

    return df.withColumn(out_col, vectors(tokens(prepare_text(text_col))))


def embed(df: DataFrame, id_col: str, text_col: str, encoder: HashingEncoder | Callable | None = None,
          out_col: str = "embedding", batch_size: int = 32) -> DataFrame:
    """EM1: add ``out_col`` ARRAY<DOUBLE> for ``text_col``; ``encoder`` is a
    ``HashingEncoder`` (the default) or an encoder factory."""
    encoder = encoder or HashingEncoder()
    if isinstance(encoder, HashingEncoder):
        return _hashing_embed(df, id_col, text_col, encoder.dim, out_col)
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    factory = encoder_factory(encoder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = factory()
        for pdf in batches:
            texts = pdf[text_col].fillna("").str.replace("\n", " ").str.strip().tolist()
            vecs = []
            for i in range(0, len(texts), batch_size):
                vecs.extend(np.asarray(enc.encode(texts[i:i + batch_size]), dtype=np.float64))
            yield pdf.assign(**{out_col: [v.tolist() for v in vecs]})

    return df.mapInPandas(run, schema)


def encoder_factory(encoder: HashingEncoder | Callable | None) -> Callable:
    """``encoder`` as a factory; an encoder object itself is refused, because
    it would travel with the plan."""
    if encoder is None or isinstance(encoder, HashingEncoder):
        spec = encoder or HashingEncoder()
        return lambda: spec
    if not callable(encoder) or hasattr(encoder, "encode") and not isinstance(encoder, type):
        raise TypeError("give a function that makes the encoder, not the encoder")
    return encoder


def normalise_vectors(df: DataFrame, col: str = "embedding", out_col: str | None = None) -> DataFrame:
    """EM3: divide by the L2 norm.  Zero vectors, and vectors with a null or
    NaN component, stay as they are; a null vector is null."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def unit(vectors: pa.Array) -> pa.Array:
        flat = vectors.flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(vectors)), sizes)
        norm = np.sqrt(np.bincount(rows, weights=x * x, minlength=len(vectors)))[rows]
        x = np.divide(x, norm, out=x, where=norm > 0)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        values = pa.array(x, mask=flat.is_null().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(ends, values, mask=vectors.is_null())

    return df.withColumn(out_col or col, unit(F.col(col).cast("array<double>")))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two equal-length numeric arrays (JVM side)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def vector_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
