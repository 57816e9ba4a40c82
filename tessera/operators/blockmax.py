"""BM25 top-k over impact-ordered term blocks (TK2, JN1 at scale).

The postings of a term are ordered by falling weight and cut into blocks; a
small table holds per block its largest weight, its size and its document
range.  A query orders its terms by the most they can add (``qtf`` times the
term's largest weight).  A document is found at the first of these terms it
holds, so a block of term t gives no score above its own largest weight plus
what the terms after t can add.  The search has two rounds:

1. the most promising blocks of every query are scored; the k-th score found
   is a floor for the query;
2. a block is read only if its bound reaches the floor, and a posting of it
   becomes a candidate only if its own bound does.

Candidates are scored exactly on the term table, so the result, ties included,
is that of ``lexical.bm25_scores`` over all postings.  What grows with queries
times documents is only the join of query terms with block rows, which is
``block_rows`` times smaller than the join with postings.

The postings are range-partitioned by (term, weight, document): a term that a
third of all documents hold is spread over as many tasks as it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.lexical import Bm25Index, query_terms, top_k
from tessera.sources.jsonl import scratch_path

# postings of a block; a power of two, so blocks never span two partitions
BLOCK_ROWS = 64
# blocks of a query that are scored to find its floor
SEED_BLOCKS = 8
# scores are compared at 9 decimals; bounds allow for the rounding of sums
SLACK = 1e-6


@dataclass
class BlockIndex:
    postings: DataFrame      # term, block, doc_id, impact: ordered by term and falling impact; weight = idf * impact
    blocks: DataFrame        # term, block, n, idf, max_weight, first_doc, last_doc

    def work(self, chosen: DataFrame, qt: DataFrame) -> dict[str, int]:
        """Postings of all query terms, and those of the chosen blocks."""
        every = qt.join(self.blocks, "term").agg(F.sum("n")).first()[0]
        return {"postings": int(every or 0), "read": int(chosen.agg(F.sum("n")).first()[0] or 0)}


def write_blocks(index: Bm25Index, path: str, block_rows: int = BLOCK_ROWS) -> BlockIndex:
    """Write the block tables of ``index`` to ``path`` (a shared folder).

    Inside a term weights rise and fall with ``impact``, which needs no document
    frequency: postings are not joined with frequencies, those are summed over
    the blocks and stored with them."""
    if block_rows & (block_rows - 1):
        raise ValueError("block_rows must be a power of two")
    order = ["term", F.desc("impact"), "doc_id"]
    ordered = index.terms.select("term", "doc_id", index.impact().alias("impact")).repartitionByRange(*order).sortWithinPartitions(*order)
    # ids count up inside a partition from a multiple of 2^33
    block = F.floor(F.monotonically_increasing_id() / block_rows).alias("block")
    ordered.select("term", block, "doc_id", "impact").write.mode("overwrite").parquet(f"{path}/postings")
    spark = index.terms.sparkSession
    blocks = spark.read.parquet(f"{path}/postings").groupBy("term", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("impact").alias("impact"),
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    (blocks.withColumn("df", F.sum("n").over(Window.partitionBy("term"))).withColumn("idf", index.idf())
     .select("term", "block", "n", "idf", (F.col("idf") * F.col("impact")).alias("max_weight"), "first_doc", "last_doc")
     .write.mode("overwrite").parquet(f"{path}/blocks"))
    return load_blocks(spark, path)


def load_blocks(spark: SparkSession, path: str) -> BlockIndex:
    return BlockIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/blocks"))


def _exact(held: DataFrame, candidates: DataFrame, qt: DataFrame, keys: list[str]) -> DataFrame:
    """Exact score of every candidate (keys, doc_id) from the postings of all query terms."""
    return (held.select("term", "doc_id", "weight").join(candidates, "doc_id").join(qt.select(*keys, "term", "qtf"), [*keys, "term"])
            .groupBy(*keys, "doc_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("bm25_score")))


def search_blocks(index: BlockIndex, queries: DataFrame, k: int, text_col: str = "query", keys: list[str] | None = None,
                  seeds: int = SEED_BLOCKS, work: dict | None = None) -> DataFrame:
    """(keys, doc_id, bm25_score, rank): the ``k`` best documents per query,
    scores compared at 9 decimals, ties by rising ``doc_id``.

    A query without a known term has no rows; a null key is not a query.
    ``work`` is filled with the postings of all query terms and those read."""
    keys = keys or ["query_id"]
    spark = index.blocks.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    best = index.blocks.groupBy("term").agg(F.max("max_weight").alias("top"), F.first("idf").alias("idf"))
    w = Window.partitionBy(*keys).orderBy(F.desc("most"), "term")
    terms = query_terms(queries.dropna(subset=keys), text_col, keys).join(best, "term").withColumn("most", F.col("qtf") * F.col("top"))
    qt = kept(terms.withColumn("after", F.coalesce(F.sum("most").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))
              .drop("top", "most"), "block-query-terms")
    # the only read of all postings; the rounds read what it leaves
    held = kept(index.postings.join(qt.select("term", "idf").distinct(), "term").select(
        "term", "block", "doc_id", (F.col("idf") * F.col("impact")).alias("weight")), "block-held")
    bounds = qt.join(index.blocks.select("term", "block", "n", "max_weight"), "term").withColumn(
        "bound", F.col("qtf") * F.col("max_weight") + F.col("after"))
    order = [F.round("bm25_score", 9).desc(), F.col("doc_id")]

    first = kept(top_k(bounds, keys, [F.desc("bound"), "term", "block"], seeds, "_seed").select(*keys, "term", "block"), "block-seeds")
    found = held.join(first, ["term", "block"]).select(*keys, "doc_id").distinct()
    ranked = top_k(_exact(held, found, qt, keys), keys, order, k)
    floors = kept(ranked.filter(F.col("rank") == k).select(*keys, F.col("bm25_score").alias("floor")), "block-floors")

    floor = F.coalesce(F.col("floor"), F.lit(0.0)) - SLACK
    chosen = kept(bounds.join(floors, keys, "left").filter(F.col("bound") >= floor), "block-chosen")
    if work is not None:
        work |= index.work(chosen, qt)
    candidates = (held.join(chosen.select(*keys, "term", "block", "qtf", "after", "floor"), ["term", "block"])
                  .filter(F.col("qtf") * F.col("weight") + F.col("after") >= floor).select(*keys, "doc_id").distinct())
    return top_k(_exact(held, candidates, qt, keys), keys, order, k)
