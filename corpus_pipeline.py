"""The corpus pipeline: ``documents`` through five operators.

quality -> near duplicates -> benchmark passages -> secrets -> token ids.
Each stage works on all rows that its predecessor kept and is written as
Parquet, which the next stage reads.  A stage that filters reads its own input
only: statistics, classes and matches are computed over the rows it is given.

Empty and null texts: the quality stage scores them like any text, the join,
the benchmark match and the secret scan find nothing in them, and their ids
are the end id alone.  Columns beyond those of ``documents`` pass through
every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, ngram_join, piece_codec, quality, secrets
from tessera.llm.common import fresh, materialise, read_table, scratch
from tessera.llm.queries import QUALITY_THRESHOLD, piece_model, quality_model
from tessera.llm.warc import small_or_shuffled


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in ``ids``; null ids stay."""
    return docs.join(small_or_shuffled(materialise(ids.distinct(), "dropped-ids")), "doc_id", "left_anti").select(
        *docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    stats = materialise(quality.with_statistics(docs), "quality-statistics")
    model = quality_model(stats, read_table(spark, sf_dir, "labels"))
    return docs.filter(quality.score_text(model, "text") >= QUALITY_THRESHOLD)


def _text_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame, str] | None:
    """If some id has different texts: ``docs`` with an id of its own for each
    (a new column; for other ids the id itself), (that column, id) of these
    texts, and the column's name."""
    name, key = fresh(docs, "_node"), fresh(docs, "_text_digest")
    known = docs.filter("doc_id is not null")
    repeated = known.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return None
    digest = F.coalesce(F.sha2(F.col("text"), 256), F.lit("null"))
    texts = materialise(known.select("doc_id", digest.alias(key)).join(
        small_or_shuffled(repeated), "doc_id", "left_semi").distinct(), "repeated-ids")
    several = texts.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if several.isEmpty():
        return None
    low, high = known.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    number = F.monotonically_increasing_id()
    node = F.lit(high + 1) + number if high < 2 ** 62 else F.lit(low - 1) - number
    texts = materialise(texts.join(several, "doc_id", "left_semi").withColumn(name, node), "text-nodes")
    nodes = (docs.withColumn(key, digest).join(small_or_shuffled(texts), ["doc_id", key], "left")
             .withColumn(name, F.coalesce(name, F.col("doc_id").cast("long"))))
    return nodes.select(*docs.columns, name), texts.select(name, F.col("doc_id").alias("id")), name


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near duplicates the document with the smallest id;
    of repeated rows with one id and text, one.  Different texts under one id
    are judged as documents of their own."""
    several = _text_nodes(docs)
    if several is None:
        linked = ngram_join.link_texts(docs)
        kept = _without(docs, linked.filter("doc_id <> class_id").select("doc_id"))
    else:
        nodes, texts, name = several
        linked = materialise(ngram_join.link_texts(nodes, id_col=name).filter(F.col(name).isNotNull())
                             .join(small_or_shuffled(texts), name, "left")
                             .select(name, "class_id", F.coalesce("id", name).alias("id")), "text-classes")
        first = linked.groupBy("class_id").agg(F.min(F.struct("id", name))[name].alias("first"))
        dropped = materialise(linked.join(first, "class_id").filter(F.col(name) != F.col("first")).select(name), "dropped-ids")
        kept = nodes.join(small_or_shuffled(dropped), name, "left_anti").select(*docs.columns)
    repeated = kept.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(
        kept.filter("doc_id is null"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    found = decontaminate.match(docs, read_table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked, ``n_chars`` brought up to date."""
    out = secrets.redact(docs, secrets.scan(docs, path_col="source"))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of every document."""
    return piece_codec.encode_texts(docs, piece_model()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("benchmark", drop_benchmark),
    ("secrets", mask_secrets),
    ("token_ids", encode),
]
# A fitted discriminant, a random forest and a piece model are not SQL; the
# stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
