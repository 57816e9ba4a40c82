"""Chunking, point-table and JSON-lines source/sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixed_values as FV
from tessera.operators import chunk, prep, split
from tessera.operators.point_store import PointStore
from tessera.plans.catalog import register
from tessera.plans.sqlbits import clean, hash_vectors, lit
from tessera.plans.q_prep import KEPT_B, SPLIT_ORDER
from tessera.sources import jsonl
from tessera.sources import tables as T
from tessera.sources.jsonl import scratch_path

CH_SQL = f"""
WITH t AS (SELECT doc_id, CASE WHEN {clean('text')} = '' THEN []::VARCHAR[] ELSE string_split({clean('text')}, ' ') END AS toks
           FROM documents),
w AS (SELECT doc_id, toks, len(toks) AS n,
             CASE WHEN len(toks) <= 512 THEN 1 ELSE ceil((len(toks) - 512) / 462.0)::BIGINT + 1 END AS k
      FROM t WHERE len(toks) > 0),
c AS (SELECT doc_id, toks, n, unnest(range(0, k)) AS chunk_idx FROM w)
"""


@register("chunk_tokens", sql=CH_SQL + """
SELECT doc_id, chunk_idx::INT AS chunk_idx, least(512, n - chunk_idx * 462) AS n_tokens,
       array_to_string(toks[chunk_idx * 462 + 1 : chunk_idx * 462 + 512], ' ') AS content
FROM c
""")
def chunk_tokens(spark, sf):
    """CH1: 512-token windows with 50 overlap over every document."""
    d = T.table(spark, sf, "documents")
    return chunk.chunk_tokens(d, "text", 512, 50)


@register("chunk_point_ids", sql=CH_SQL + """
SELECT doc_id * 1000 + chunk_idx AS point_id, doc_id, chunk_idx::INT AS chunk_idx FROM c
""")
def chunk_point_ids(spark, sf):
    """CH4: point ids of the token chunks."""
    c = chunk.chunk_tokens(T.table(spark, sf, "documents"), "text", 512, 50)
    return chunk.point_ids(c).select("point_id", "doc_id", "chunk_idx")


SENTENCES_SQL = f"""
st AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])[\\s\\p{{Z}}\\x{{0b}}]+',
             '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS sent FROM st)
"""


@register("chunk_sentences", sql=f"""
WITH RECURSIVE {SENTENCES_SQL},
n AS (SELECT *, CASE WHEN {clean('sent')} = '' THEN 0 ELSE len(string_split({clean('sent')}, ' ')) END AS n FROM s),
p AS (SELECT doc_id, i, 0 AS chunk_idx, n AS held FROM n WHERE i = 1
      UNION ALL
      SELECT n.doc_id, n.i, CASE WHEN p.held > 0 AND p.held + n.n > 2048 THEN p.chunk_idx + 1 ELSE p.chunk_idx END,
             CASE WHEN p.held > 0 AND p.held + n.n > 2048 THEN n.n ELSE p.held + n.n END
      FROM p JOIN n ON n.doc_id = p.doc_id AND n.i = p.i + 1)
SELECT doc_id, chunk_idx, sum(n)::INT AS n_tokens, string_agg(sent, ' ' ORDER BY i) AS content
FROM p JOIN n USING (doc_id, i) GROUP BY doc_id, chunk_idx
""")
def chunk_sentences(spark, sf):
    """CH2: whole sentences packed up to 2048 tokens."""
    return chunk.chunk_sentences(T.table(spark, sf, "documents"), "text", 2048)


@register("chunk_semantic", sql=f"""
WITH {SENTENCES_SQL},
g AS (SELECT a.doc_id, a.i, string_agg(b.sent, ' ' ORDER BY b.i) AS ctx
      FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i - 1 AND a.i + 1 GROUP BY 1, 2),
k AS (SELECT doc_id * 100000 + i AS gid, ctx FROM g),
v AS {hash_vectors('k', 'gid', 'ctx')},
dots AS (SELECT x.id, sum(x.v * y.v) AS cos FROM v x JOIN v y ON y.id = x.id - 1 AND y.b = x.b GROUP BY 1),
d AS (SELECT s.doc_id, s.i, round(1.0 - coalesce(cos, 0.0), 9) AS dist FROM s LEFT JOIN dots ON dots.id = s.doc_id * 100000 + s.i
      WHERE s.i > 1),
t AS (SELECT doc_id, round(quantile_cont(dist, 0.95), 9) AS thr FROM d GROUP BY 1),
c AS (SELECT s.doc_id, s.i, s.sent, sum(CASE WHEN dist > thr THEN 1 ELSE 0 END)
             OVER (PARTITION BY s.doc_id ORDER BY s.i) AS chunk_idx
      FROM s LEFT JOIN d ON d.doc_id = s.doc_id AND d.i = s.i LEFT JOIN t ON t.doc_id = s.doc_id)
SELECT doc_id, chunk_idx::INT AS chunk_idx, string_agg(sent, ' ' ORDER BY i) AS content FROM c GROUP BY doc_id, chunk_idx
""")
def chunk_semantic(spark, sf):
    """CH3: semantic cuts (hashing encoder, buffer 1, 95th percentile)."""
    return chunk.chunk_semantic(T.table(spark, sf, "documents"), "text", 1, 95.0)


UPS_SQL = """
WITH base AS (SELECT vec_id AS point_id, label, 0 AS seq, 'base' AS origin FROM embeddings),
batch AS (SELECT vec_id + 250 AS point_id, label + 100 AS label, 1 AS seq, 'batch' AS origin FROM embeddings
          UNION ALL SELECT vec_id + 250, label + 200, 2, 'batch' FROM embeddings WHERE label % 2 = 0),
latest AS (SELECT point_id, arg_max(label, seq) AS label, max(seq) AS seq, 'batch' AS origin FROM batch GROUP BY 1)
"""


def _ups(spark, sf):
    e = T.table(spark, sf, "embeddings")
    base = e.select(F.col("vec_id").alias("point_id"), "label", F.lit(0).alias("seq"), F.lit("base").alias("origin"))
    b1 = e.select((F.col("vec_id") + 250).alias("point_id"), (F.col("label") + 100).alias("label"),
                  F.lit(1).alias("seq"), F.lit("batch").alias("origin"))
    b2 = e.filter(F.col("label") % 2 == 0).select((F.col("vec_id") + 250).alias("point_id"),
                                                  (F.col("label") + 200).alias("label"),
                                                  F.lit(2).alias("seq"), F.lit("batch").alias("origin"))
    return base, b1.unionByName(b2)


@register("upsert_points", sql=UPS_SQL + """
SELECT point_id, label, origin FROM base WHERE point_id NOT IN (SELECT point_id FROM latest)
UNION ALL SELECT point_id, label, origin FROM latest
""")
def upsert_points(spark, sf):
    """SNK8 + WN7: a batch re-keyed onto half of the points, with two versions of some rows."""
    base, batch = _ups(spark, sf)
    return chunk.upsert_points(base, batch).select("point_id", "label", "origin")


@register("point_store", sql=UPS_SQL + """
SELECT point_id, label, origin FROM base WHERE point_id NOT IN (SELECT point_id FROM latest) AND point_id % 7 <> 2
UNION ALL SELECT point_id, label, origin FROM latest WHERE point_id % 7 <> 2
""")
def point_store(spark, sf):
    """SNK8 + SNK9 in a bucketed store: the base, the batch of ``upsert_points``
    (twice, under one batch id) and a deletion."""
    base, batch = _ups(spark, sf)
    store = PointStore(spark, scratch_path(spark, "points"), "point_id long, label int, origin string", buckets=16)
    store.upsert(base, "base")
    store.upsert(batch, "batch", "seq")
    store.upsert(batch, "batch", "seq")
    store.delete(base.unionByName(batch).filter("point_id % 7 = 2"), "gone")
    return store.points()


@register("delete_points", sql="""
SELECT vec_id AS point_id, label FROM embeddings WHERE vec_id NOT IN (SELECT l.doc_id FROM labels l WHERE l.toxic = 1)
""")
def delete_points(spark, sf):
    """SNK9 + JN5: delete the points whose id is a toxic-labelled document id."""
    e = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "label")
    ids = T.table(spark, sf, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("point_id"))
    return chunk.delete_points(e, ids)


@register("scroll_payloads", sql="""
SELECT doc_id AS point_id, '' AS question, text AS content, coalesce(source, 'vector_store') AS source, doc_id
FROM documents ORDER BY doc_id LIMIT 1000
""")
def scroll_payloads(spark, sf):
    """SNK10: first 1000 payloads by id, no vectors."""
    d = T.table(spark, sf, "documents").select(F.col("doc_id").alias("point_id"), F.lit("").alias("question"),
                                               F.col("text").alias("content"), "source", "doc_id")
    return chunk.scroll_payloads(d, 1000).select("point_id", "question", "content", "source", "doc_id")


@register("migrate_title_to_question", sql="""
SELECT doc_id, coalesce(split_part(text, '.', 1), '') AS question, length(coalesce(split_part(text, '.', 1), '')) <= 2000 AS question_fits,
       substr(coalesce(text, ''), 1, 50) AS preview
FROM documents
""")
def migrate_title_to_question(spark, sf):
    """SNK11: documents with title = first sentence, migrated to question."""
    d = T.table(spark, sf, "documents").select("doc_id", F.substring_index("text", ".", 1).alias("title"),
                                               F.col("text").alias("content"))
    return chunk.migrate_title_to_question(d).select("doc_id", "question", "question_fits", "preview")


@register("collection_stats", sql="""
SELECT count(*) AS points_count, count(embedding) AS vectors_count, max(len(embedding)) AS dim,
       CASE WHEN count(*) > 0 THEN 'green' ELSE 'empty' END AS status FROM embeddings
""")
def collection_stats(spark, sf):
    """AG9."""
    s = chunk.collection_stats(T.table(spark, sf, "embeddings"))
    return s.select("points_count", "vectors_count", F.col("dim").cast("bigint").alias("dim"), "status")


QA_SCHEMA = "question string, answer string"


def _defective_lines(df, cols):
    """JSON lines of ``cols``; every 7th row (by its own key) is cut in half."""
    js = F.to_json(F.struct(*cols))
    cut = (F.col("conv_id") + F.col("turn")) % 7 == 0
    return df.select(F.when(cut, F.expr("substring(to_json(struct(" + ", ".join(cols) + ")), 1, "
                                        "length(to_json(struct(" + ", ".join(cols) + "))) div 2)"))
                     .otherwise(js).alias("value"))


@register("jsonl_roundtrip", sql=f"""
WITH p AS (SELECT * FROM {KEPT_B})
SELECT count(*) AS n_lines, count(*) FILTER (WHERE (conv_id + turn) % 7 = 0) AS n_bad,
       count(*) FILTER (WHERE (conv_id + turn) % 7 <> 0) AS n_valid FROM p
""")
def jsonl_roundtrip(spark, sf):
    """SRC1 + SNK1: QA pairs written as JSON lines (some cut short) and read
    back with a schema; malformed lines are counted, not lost."""
    kept = prep.quality_filter(T.qa_pairs(T.table(spark, sf, "conversations")), "B")
    path = jsonl.scratch_path(spark, "qa")
    _defective_lines(kept, ["question", "answer"]).write.mode("overwrite").text(path)
    back = jsonl.read_jsonl(spark, path, QA_SCHEMA)
    c = jsonl.parse_counts(back)
    return c.select(F.col("rows").alias("n_lines"), F.col("bad_rows").alias("n_bad"),
                    (F.col("rows") - F.col("bad_rows")).alias("n_valid"))


@register("instruction_merge", sql=f"""
WITH b AS (SELECT 'B' AS src, * FROM {KEPT_B}),
c AS (SELECT 'C' AS src, * FROM {KEPT_B} WHERE length(question) <= 2000),
u AS (SELECT * FROM b UNION ALL SELECT * FROM c),
v AS (SELECT src, count(*) AS n_lines FROM u WHERE (conv_id + turn) % 7 <> 0 GROUP BY src)
SELECT 'finetune_data_' || lower(src) AS folder, n_lines, round(n_lines * 100.0 / sum(n_lines) OVER (), 1) AS pct FROM v
""")
def instruction_merge(spark, sf):
    """SRC3 + SRC4 + AG5 + SO1: instruction files of two presets (with
    defects) merged by a glob read; valid lines per source folder."""
    qa = T.qa_pairs(T.table(spark, sf, "conversations"))
    root = jsonl.scratch_path(spark, "instr")
    for preset in ("B", "C"):
        inst = prep.to_instruction(prep.quality_filter(qa, preset))
        _defective_lines(inst, ["instruction", "input", "output"]).write.mode("overwrite").text(
            f"{root}/finetune_data_{preset.lower()}/")
    lines = jsonl.read_jsonl_glob(spark, f"{root}/finetune_data*/*.txt")
    valid = jsonl.keep_valid_instruction_rows(lines)
    valid = valid.withColumn("folder", F.element_at(F.split("file", "/"), -2))
    return jsonl.per_file_stats(valid, "folder")


@register("written_splits_check", sql=f"""
WITH s AS (SELECT CASE WHEN pos < floor(n * 0.8) THEN 'train' WHEN pos < floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split
           FROM {SPLIT_ORDER})
SELECT split, count(*) AS rows, 0::BIGINT AS bad_rows, count(*) AS expected, true AS ok FROM s GROUP BY split
""")
def written_splits_check(spark, sf):
    """SNK4 + SNK6: write the exact split as JSON lines per split, re-read and validate counts."""
    kept = prep.quality_filter(T.qa_pairs(T.table(spark, sf, "conversations")), "B")
    s = split.split_exact(kept, ["conv_id", "turn"]).select("question", "answer", "split")
    path = jsonl.scratch_path(spark, "splits")
    jsonl.write_json(s, path, ["split"])
    return jsonl.validate_written(spark, path, "question string, answer string, split string", s, "split") \
        .select("split", "rows", "bad_rows", "expected", "ok")


@register("corpus_gz_roundtrip", sql="SELECT count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents")
def corpus_gz_roundtrip(spark, sf):
    """SRC2: documents written as gzip JSON lines and read back, spread after the scan."""
    d = T.table(spark, sf, "documents")
    path = jsonl.scratch_path(spark, "corpus")
    d.write.mode("overwrite").option("compression", "gzip").json(path)
    back = jsonl.read_corpus_gz(spark, path, d.schema, spark.sparkContext.defaultParallelism)
    return back.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").cast("bigint").alias("n_chars"))


@register("concat_splits", sql=f"SELECT question, answer FROM {KEPT_B}")
def concat_splits(spark, sf):
    """SRC5: the three splits stacked again (two columns)."""
    kept = prep.quality_filter(T.qa_pairs(T.table(spark, sf, "conversations")), "B")
    s = split.split_exact(kept, ["conv_id", "turn"])
    return jsonl.concat_splits(*[s.filter(F.col("split") == x) for x in ("train", "valid", "test")])


@register("limit_lines", sql="""
SELECT u.conv_id, u.turn FROM conversations u ORDER BY u.conv_id, u.turn LIMIT 100
""")
def limit_lines(spark, sf):
    """SRC6: the first 100 message lines in (conversation, turn) order."""
    c = T.table(spark, sf, "conversations").select("conv_id", "turn")
    return jsonl.limit_lines(c, ["conv_id", "turn"], 100)


@register("first_lines", sql="""
WITH l AS (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line_no FROM documents)
SELECT source, line_no, doc_id, lang, doc_id % 7 = 3 AS bad FROM l WHERE line_no <= 20
""")
def first_lines(spark, sf):
    """SRC6: the first 20 lines of every file, malformed ones included; one
    file per source, in doc_id order, every seventh line cut short."""
    d = T.table(spark, sf, "documents").select("doc_id", "lang", "text", "source")
    line = F.to_json(F.struct("doc_id", "lang", "text"), {"ignoreNullFields": "false"})
    cut = F.when(F.col("doc_id") % 7 == 3, F.substring(line, 1, 20)).otherwise(line)
    path = scratch_path(spark, "lines")
    (d.select("source", "doc_id", cut.alias("value")).repartition("source").sortWithinPartitions("source", "doc_id")
     .select("source", "value").write.partitionBy("source").text(path))
    got = jsonl.first_lines(spark, f"{path}/*/*.txt", 20, "doc_id long, lang string")
    ids = T.table(spark, sf, "documents").select("source", "doc_id", "lang")
    got = got.select(F.regexp_extract("file", "source=([^/]+)", 1).alias("source"), "line_no", F.col("_bad").alias("bad_line"),
                     F.coalesce("doc_id", F.regexp_extract("_bad", r"^.{10}([0-9]+)", 1).try_cast("long")).alias("doc_id"))
    return got.join(ids, ["source", "doc_id"]).select("source", "line_no", "doc_id", "lang", F.col("bad_line").isNotNull().alias("bad"))


@register("eval_sample", sql="""
SELECT u.conv_id * 1000 + u.turn AS id FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant' ORDER BY id LIMIT 500
""")
def eval_sample(spark, sf):
    """TK9: the first 500 evaluation rows by id."""
    p = T.predictions(T.table(spark, sf, "conversations")).select("id")
    return jsonl.limit_lines(p, ["id"], 500)
