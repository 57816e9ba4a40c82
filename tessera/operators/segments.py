"""A BM25 index that documents are added to and deleted from (AG10, ST3).

A change writes one segment: the term rows, the documents and their lengths,
and a tombstone for every id it adds or deletes.  A tombstone of segment s
kills the rows of its id in all segments before s, so adding a document again
replaces it.  The corpus statistics are the sums over the segments less what
the dead documents had; no text is tokenised twice.  ``merge`` writes all live
rows as one segment and so bounds the number of segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixed_values as FV
from tessera.operators.lexical import Bm25Index, corpus_terms, require_any
from tessera.functions.text import search_text
from tessera.sources.manifest import Manifest

PARTS = "seq long, n_docs long, n_tokens long"
TERMS = "doc_id long, dl int, term string, tf long"
DOCS = "doc_id long, question string, content string, source string"


class SegmentedIndex:
    """The segments under the shared folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, k1: float = FV.BM25_K1, b: float = FV.BM25_B):
        self.spark, self.path, self.k1, self.b = spark, path.rstrip("/"), k1, b
        self.manifest = Manifest(spark, self.path, PARTS)

    def _rows(self, name: str, schema: str, parts: list) -> DataFrame:
        empty = self.spark.createDataFrame([], f"{schema}, seq long")
        paths = [f"{self.path}/{name}/seq={p['seq']}" for p in parts]
        if not paths:
            return empty
        return self.spark.read.schema(empty.schema).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _write(self, df: DataFrame, name: str, seq: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/seq={seq}")

    def _dead(self, parts: list) -> DataFrame:
        """(doc_id, dead): rows of the id in segments before ``dead`` are gone."""
        return self._rows("tombstones", "doc_id long", parts).groupBy("doc_id").agg(F.max("seq").alias("dead"))

    def _live(self, rows: DataFrame, dead: DataFrame) -> DataFrame:
        return rows.join(dead, "doc_id", "left").filter("dead is null or seq >= dead").drop("dead", "seq")

    def _change(self, docs: DataFrame, gone: DataFrame, batch: str | None) -> int:
        if self.manifest.has(batch):
            return self.manifest.version()
        parts = self.manifest.parts()
        seq = self.manifest.version() + 1
        d = require_any(docs).select(*(f.split()[0] for f in DOCS.split(", ")))
        self._write(d, "docs", seq)
        stored = self.spark.read.schema(DOCS).parquet(f"{self.path}/docs/seq={seq}")
        self._write(corpus_terms(stored.withColumn("search_text", search_text("question", "content"))), "terms", seq)
        terms = self.spark.read.schema(TERMS).parquet(f"{self.path}/terms/seq={seq}")
        lengths = stored.select("doc_id").join(terms.groupBy("doc_id").agg(F.max("dl").alias("dl")), "doc_id", "left").select(
            "doc_id", F.coalesce("dl", F.lit(0)).cast("long").alias("dl"))
        self._write(lengths, "lengths", seq)
        self._write(gone.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "tombstones", seq)
        total = self.spark.read.schema("doc_id long, dl long").parquet(f"{self.path}/lengths/seq={seq}").agg(
            F.count(F.lit(1)).alias("n"), F.sum("dl").alias("t")).first()
        rows = [(p["seq"], p["n_docs"], p["n_tokens"]) for p in parts] + [(seq, total["n"], int(total["t"] or 0))]
        return self.manifest.commit(rows, PARTS, batch)

    def add(self, docs: DataFrame, batch: str | None = None) -> int:
        """Add documents (doc_id, question, content, source); one that is there
        already is replaced, also by one without text.  An id occurs once per
        batch and is not null.  A ``batch`` that is in changes nothing."""
        docs = docs.filter("doc_id is not null")
        return self._change(docs, docs, batch)

    def delete(self, ids: DataFrame, batch: str | None = None) -> int:
        """Delete documents by id; unknown ids are ignored."""
        return self._change(self.spark.createDataFrame([], DOCS), ids.filter("doc_id is not null"), batch)

    def statistics(self) -> tuple[int, float]:
        """(documents, mean length): sums over segments minus the dead."""
        parts = self.manifest.parts()
        dead = self._dead(parts)
        lost = (self._rows("lengths", "doc_id long, dl long", parts).join(dead, "doc_id").filter("seq < dead")
                .agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("t")).first())
        n = sum(p["n_docs"] for p in parts) - lost["n"]
        tokens = sum(p["n_tokens"] for p in parts) - int(lost["t"] or 0)
        return n, (tokens / n if n else 0.0)

    def index(self) -> Bm25Index:
        """The live rows as an index for ``lexical`` and ``blockmax``."""
        parts = self.manifest.parts()
        dead = self._dead(parts)
        n, avgdl = self.statistics()
        return Bm25Index(terms=self._live(self._rows("terms", TERMS, parts), dead), n_docs=n, avgdl=avgdl,
                         docs=self._live(self._rows("docs", DOCS, parts), dead), k1=self.k1, b=self.b)

    def merge(self) -> int:
        """Write the live rows as one segment without tombstones."""
        parts = self.manifest.parts()
        dead = self._dead(parts)
        seq = self.manifest.version() + 1
        for name, schema in (("docs", DOCS), ("terms", TERMS), ("lengths", "doc_id long, dl long")):
            self._write(self._live(self._rows(name, schema, parts), dead), name, seq)
        self._write(self.spark.createDataFrame([], "doc_id long"), "tombstones", seq)
        n, avgdl = self.statistics()
        return self.manifest.commit([(seq, n, round(avgdl * n))], PARTS)
