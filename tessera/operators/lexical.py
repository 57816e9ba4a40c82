"""BM25 index build (AG10) and lexical search (JN1, TK2), lexical rank (TK8).

Index: the term table ``(doc_id, dl, term, tf)``, hashed by ``doc_id``, plus
the corpus statistics N and avgdl.  The partitioning is stated, so the plan is
the same for one input file and for thousands.  A search touches only the
postings of its query terms: semi-join with the distinct query terms, document
frequencies for those terms, weights, a join with the per-query term counts
and a sum per (query, doc).  That sum needs no exchange, because all postings
of a document are in one partition; only each task's best ``k`` documents per
query are shuffled.  ``write_index`` stores the raw term table, ``load_index``
reads it for repeated searches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera import fixed_values as FV
from tessera.functions.text import once, search_text, tokens
from tessera.session import broadcast_if_small


@dataclass
class Bm25Index:
    terms: DataFrame         # doc_id, dl, term, tf (also feeds hashing vectors)
    n_docs: int
    avgdl: float
    docs: DataFrame          # doc_id + payload columns (question, content, source ...)
    k1: float = FV.BM25_K1
    b: float = FV.BM25_B
    hashed: bool = False     # the term table is known to be hashed by doc_id

    def release(self) -> None:
        """Free the memory that a freshly built term table holds."""
        self.terms.unpersist()

    def idf(self) -> Column:
        """Inverse document frequency from column df."""
        return F.log(F.lit(1.0) + (F.lit(float(self.n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))

    def _norm(self) -> Column:
        avgdl = self.avgdl if self.avgdl > 0 else 1.0
        return F.lit(self.k1) * (F.lit(1.0 - self.b) + F.lit(self.b) * F.col("dl") / F.lit(avgdl))

    def impact(self) -> Column:
        """What a weight has besides ``idf``, from columns tf, dl: orders the
        postings of a term as their weights do, without its df."""
        return F.col("tf") * F.lit(self.k1 + 1.0) / (F.col("tf") + self._norm())

    def weight(self) -> Column:
        """Per-(term, doc) BM25 weight from columns tf, dl, df."""
        return self.idf() * F.col("tf") * F.lit(self.k1 + 1.0) / (F.col("tf") + self._norm())

    @property
    def postings(self) -> DataFrame:
        """Full postings (every term of the vocabulary) with weights: what
        ``write_index`` persists and the term statistics read."""
        df_t = self.terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return self.terms.join(df_t, "term").select("term", "doc_id", "tf", "dl", "df",
                                                    self.weight().alias("weight"))


def require_any(docs: DataFrame) -> DataFrame:
    """Drop rows where both question and content are empty; fill defaults."""
    q = F.coalesce(F.col("question"), F.lit(""))
    c = F.coalesce(F.col("content"), F.lit(""))
    return (docs.filter((q != "") | (c != ""))
                .withColumn("question", q).withColumn("content", c)
                .withColumn("source", F.coalesce(F.col("source"), F.lit("unknown"))))


# Bytes of text that a task of the term table counts, on average.  Its two hash
# maps (partial and final counts) take some 20 bytes for each of them.
TASK_BYTES = 16_000_000


def corpus_terms(docs: DataFrame, text_col: str = "search_text", n_bytes: int | None = None) -> DataFrame:
    """(doc_id, dl, term, tf): one row per distinct term of a document, hashed
    by ``doc_id``.  The exchange stands before the tokenising: a text is about
    as large as its term rows, and the counts then need no further one.  A text
    is small beside the maps it is counted in, so the session's number of
    partitions is raised where a task would get more than ``TASK_BYTES`` of
    the ``n_bytes`` of all texts (summed here if not given)."""
    if n_bytes is None:
        n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0]
    parts = -(-(n_bytes or 0) // TASK_BYTES)
    few = parts <= int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartition("doc_id") if few else docs.repartition(parts, "doc_id")
    toks = dealt.select("doc_id", once(tokens(text_col)).alias("toks"))
    exploded = toks.select("doc_id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
    return exploded.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def build_bm25_index(docs: DataFrame, k1: float = FV.BM25_K1, b: float = FV.BM25_B) -> Bm25Index:
    """docs: doc_id, question, content (+ payload).  Text = question + ' ' + content.

    The corpus is tokenised once: the (doc, term, tf) table is persisted
    (memory and disk; lineage kept, so a lost executor recomputes only its
    blocks) and serves the statistics, the searches and - for the hashing
    encoder - the document vectors.
    """
    docs = require_any(docs).withColumn("search_text", search_text("question", "content"))
    # corpus statistics are two aggregates read as scalars: N and total length
    n_docs, n_bytes = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("search_text"))).first()
    tf = corpus_terms(docs, n_bytes=n_bytes).persist(StorageLevel.MEMORY_AND_DISK)
    total = tf.agg(F.sum("tf")).first()[0] or 0
    avgdl = float(total) / n_docs if n_docs else 0.0
    return Bm25Index(terms=tf, n_docs=n_docs, avgdl=avgdl, docs=docs.drop("search_text"), k1=k1, b=b, hashed=True)


def write_index(index: Bm25Index, path: str, max_records_per_file: int = 20_000_000) -> None:
    """Write the index to ``path`` (a shared folder): the raw term table,
    clustered and sorted by term (parquet min/max statistics per row group
    then cover narrow term ranges) in files of bounded size, and a one-row
    statistics table.  The number of files follows the table: as many
    partitions as the shuffle has, each cut at ``max_records_per_file``."""
    (index.terms.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
         .write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file).parquet(f"{path}/terms"))
    spark = index.terms.sparkSession
    spark.createDataFrame([(index.n_docs, index.avgdl, index.k1, index.b)],
                          "n_docs long, avgdl double, k1 double, b double") \
         .write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark, path: str, docs: DataFrame) -> Bm25Index:
    """Read an index written by ``write_index``; ``docs`` supplies the payload."""
    st = spark.read.parquet(f"{path}/stats").first()
    return Bm25Index(terms=spark.read.parquet(f"{path}/terms"), n_docs=int(st["n_docs"]),
                     avgdl=float(st["avgdl"]), docs=require_any(docs), k1=float(st["k1"]), b=float(st["b"]))


def query_terms(queries: DataFrame, text_col: str = "query", keys: list[str] | None = None) -> DataFrame:
    """(keys, term, qtf): query term multiplicity counts."""
    keys = keys or ["query_id"]
    return (queries.select(*keys, F.explode(tokens(text_col)).alias("term"))
                   .groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("qtf")))


# Bounds of the broadcast query side: (query, term) rows, each a short key, a
# term of at most MAX_TERM_CHARS and a count.
MAX_QUERY_TERMS = 200_000
MAX_TERM_CHARS = 100


def bm25_scores(index: Bm25Index, queries: DataFrame, text_col: str = "query",
                max_rows: int = MAX_QUERY_TERMS, keys: list[str] | None = None) -> DataFrame:
    """Exact BM25 score of every (query, doc) sharing at least one term.

    Only the postings of query terms are touched: the term table is
    semi-joined with the distinct query terms, document frequencies are
    counted for those terms only (a very frequent term is collapsed map-side),
    the weighted postings are hashed by ``doc_id`` unless the table is already,
    joined with the per-query term counts and summed per (query, doc) in place.
    The query side is broadcast while its rows and its term length are proven
    bounded; beyond that the joins are shuffle joins.
    """
    keys = keys or ["query_id"]
    qt = query_terms(queries, text_col, keys)
    probe = qt.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("term")).alias("chars")).first()
    small = probe["n"] <= max_rows and (probe["chars"] or 0) <= MAX_TERM_CHARS
    bc = F.broadcast if small else (lambda d: d)
    tf_q = index.terms.join(bc(qt.select("term").distinct()), "term", "left_semi")
    df_q = bc(tf_q.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    post = tf_q.join(df_q, "term").select("term", "doc_id", index.weight().alias("weight"))
    if small and not index.hashed:
        post = post.repartition("doc_id")
    return post.join(bc(qt), "term").groupBy(*keys, "doc_id").agg(
        F.sum(F.col("qtf") * F.col("weight")).alias("bm25_score"))


def top_k(df: DataFrame, part: str | list[str], order: list, k: int, rank_col: str = "rank") -> DataFrame:
    """Per-group top-k; planned as a partial WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(*([part] if isinstance(part, str) else part)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


# cells of a dense matrix that ``bm25_top_k`` makes in a task
MAX_CELLS = 4_000_000
_NO_DOC = -(1 << 63)


def bm25_top_k(index: Bm25Index, queries: DataFrame, k: int, text_col: str = "query", keys: list[str] | None = None,
               rank_col: str = "rank") -> DataFrame:
    """(keys, doc_id, bm25_score, rank): the ``k`` best of ``bm25_scores`` per
    query, scores compared at 9 decimals, ties by rising ``doc_id``.

    While terms x queries are proven few, the postings of the query terms come
    to a task in the order of their documents; some documents at a time are
    multiplied with the table of query terms, and only the best ``k`` of every
    query are kept: no row per (query, posting) or (query, document) is made.
    Beyond that, or for ids that are no integers, ``bm25_scores`` is ranked.
    """
    from tessera.operators.dense import _best
    keys = keys or ["query_id"]
    order = [F.round("bm25_score", 9).desc(), F.col("doc_id")]
    qt = query_terms(queries, text_col, keys)
    probe = qt.limit(MAX_QUERY_TERMS + 1).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length("term")).alias("chars"), F.count_distinct("term").alias("terms"),
        F.count_distinct(F.struct(*keys)).alias("queries")).first()
    if (probe["n"] > MAX_QUERY_TERMS or (probe["chars"] or 0) > MAX_TERM_CHARS or probe["terms"] * probe["queries"] > MAX_CELLS
            or dict(index.terms.dtypes)["doc_id"] not in ("bigint", "int")):
        return top_k(bm25_scores(index, queries, text_col, keys=keys), keys, order, k, rank_col)
    asked = qt.select(*keys, "term", "qtf").collect()         # at most MAX_QUERY_TERMS short rows
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in asked}))}
    names = list(dict.fromkeys(tuple(r[c] for c in keys) for r in asked))
    number = {n: i for i, n in enumerate(names)}
    counts = np.zeros((max(1, len(terms)), max(1, len(names))))
    for r in asked:
        counts[terms[r["term"]], number[tuple(r[c] for c in keys)]] = r["qtf"]
    rows = max(1, MAX_CELLS // sum(counts.shape))
    spark = index.terms.sparkSession
    numbered = F.broadcast(spark.createDataFrame(list(terms.items()), "term string, _term int"))
    tf_q = index.terms.join(numbered, "term")
    df_q = F.broadcast(tf_q.groupBy("_term").agg(F.count(F.lit(1)).alias("df")))
    post = tf_q.join(df_q, "_term").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_DOC)).alias("doc_id"), "_term",
                                           index.weight().alias("weight"))
    if not index.hashed:
        post = post.repartition("doc_id")
    fields = [f for f in qt.schema.fields if f.name in keys]
    fields = [next(f for f in fields if f.name == c) for c in keys]
    schema = T.StructType([*fields, T.StructField("doc_id", T.LongType()), T.StructField("bm25_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = [], [np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"), np.zeros(0)]

        def scored(doc: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
            nonlocal best
            starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            at, ids = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(doc)))), doc[starts]
            for i in range(0, len(ids), rows):
                a, z = np.searchsorted(at, [i, i + rows])
                n = min(rows, len(ids) - i)
                held_terms = np.bincount((at[a:z] - i) * len(counts) + term[a:z], weights=weight[a:z], minlength=n * len(counts))
                exact = (held_terms.reshape(n, -1) @ counts).T
                score = np.where(exact > 0, np.round(exact, 9), -np.inf)
                r, c = _best(score, ids[i:i + n], k, -np.finfo(np.float64).max)
                r, found, _, exact = _ranked([*best, (r, ids[i:i + n][c], score[r, c], exact[r, c])])
                best = [(r, found, _, exact)]

        def _ranked(parts: list[tuple]) -> tuple:
            r, found, score, exact = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((found, -score, r))
            r, found, score, exact = r[order], found[order], score[order], exact[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            return r[first], found[first], score[first], exact[first]

        for b in batches:
            held = [np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, ("doc_id", "_term", "weight"))]
            if len(held[0]):
                whole = int(np.searchsorted(held[0], held[0][-1]))     # the last document may go on in the next batch
                if whole:
                    scored(*(h[:whole] for h in held))
                    held = [h[whole:] for h in held]
        if len(held[0]):
            scored(*held)
        for r, found, _, exact in best:
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([names[i][j] for i in r.tolist()], to_arrow_type(f.dataType)) for j, f in enumerate(fields)),
                 pa.array(found, mask=found == _NO_DOC), pa.array(exact)], names=schema.names)

    return top_k(post.sortWithinPartitions("doc_id").mapInArrow(run, schema), keys, order, k, rank_col)


def bm25_search(index: Bm25Index, queries: DataFrame, k: int = FV.BM25_TOP_K,
                text_col: str = "query") -> DataFrame:
    """TK2: top-k BM25 hits per query, tie-break on doc_id."""
    # scores are compared at 9 decimals so duplicate documents tie exactly
    hits = bm25_top_k(index, queries, k, text_col)
    return attach_documents(hits, index.docs)


def attach_documents(hits: DataFrame, docs: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Columns of the hit documents: the narrow hit list is broadcast when its
    size is proven, and the document table streams past it, so texts move only
    when the hits are too many for that."""
    side = docs.select("doc_id", *cols) if cols else docs
    return side.join(broadcast_if_small(hits), "doc_id")


def corpus_stats(index: Bm25Index) -> DataFrame:
    """AG10 summary: N, avgdl, vocabulary size, postings count, total tokens."""
    agg = index.terms.agg(
        F.countDistinct("term").alias("n_terms"),
        F.count(F.lit(1)).alias("n_postings"),
        F.sum("tf").alias("n_tokens"))
    return agg.select(
        F.lit(index.n_docs).cast("bigint").alias("n_docs"),
        F.round(F.lit(index.avgdl), 6).alias("avgdl"),
        "n_terms", "n_postings", F.col("n_tokens").cast("bigint").alias("n_tokens"))


def term_stats(index: Bm25Index) -> DataFrame:
    """AG10 per-term table: df and collection frequency."""
    return index.terms.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("cf"))


def lexical_rank(queries: DataFrame, docs: DataFrame, title_col: str = "title",
                 content_col: str = "content", order_col: str = "doc_order") -> DataFrame:
    """TK8: score = 2 * (query words found in title) + (query words found in content).

    Query words are the distinct lower-cased whitespace tokens; a "hit" is a
    substring test like the original.  Rank is a stable sort: ties keep the
    input order.  ``docs`` carry (query_id, doc_order, title, content).
    """
    words = queries.select("query_id", F.explode(F.array_distinct(
        F.split(F.trim(F.regexp_replace(F.lower("query"), r"\s+", " ")), " "))).alias("word")) \
        .filter(F.col("word") != "")
    d = docs.select("query_id", order_col, F.lower(F.coalesce(title_col, F.lit(""))).alias("t"),
                    F.lower(F.coalesce(content_col, F.lit(""))).alias("c"))
    scored = d.join(words, "query_id", "left").groupBy("query_id", order_col).agg(
        F.sum(F.when(F.col("t").contains(F.col("word")), 2).otherwise(0)
              + F.when(F.col("c").contains(F.col("word")), 1).otherwise(0)).alias("score"))
    scored = scored.withColumn("score", F.coalesce("score", F.lit(0)).cast("bigint"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(order_col))
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint"))
