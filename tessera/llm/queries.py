"""Registered queries of this package: each applies one operator, with its
production parameters, to its whole table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontaminate, html_text, language_id, ngram_join, piece_codec, quality, quality_rules, ranked_search, secrets, vector_dedup, warc, whitening
from tessera.llm.common import crc_mod, materialise, read_table, scratch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


OP1_CONTROL = "|".join(sorted((re.escape(c[1:]) for c in chat_format.CONTROL), key=len, reverse=True))
OP1_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT *, row_number() OVER w AS k,
             length('{chat_format.TURN}') + length(role) + 1 + length(text) + length('{chat_format.END}') + 1
             + len(regexp_extract_all(text, '[<\\[]\\\\*({OP1_CONTROL})')) AS size FROM c
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS prefix, max(k) OVER (PARTITION BY conv_id) AS last FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(prefix) FILTER (WHERE role = 'assistant' OR k = last), 0)::BIGINT AS formatted_chars,
       count(*) FILTER (WHERE role = 'assistant' OR k = last) AS n_examples
FROM p GROUP BY conv_id
"""


@register("op1_prefix_targets", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_format.read_back(chat_format.expand_targets(conv.unionByName(probe)))


def piece_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@register("op5_piece_round_trip")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip_digests(read_table(spark, sf_dir, "documents"), piece_model())


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
top AS (SELECT payload, max(page_id) AS top_id FROM p GROUP BY payload),
hexed AS (SELECT p.page_id, strlen(p.payload) AS payload_bytes, sha1(p.payload) AS h, top_id
          FROM p JOIN top ON p.payload = top.payload),
parts AS (SELECT page_id, g, ('0x' || substr(h, 5 * g + 1, 5))::BIGINT AS v FROM hexed, range(8) t(g)),
digests AS (SELECT page_id, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31)::INT + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31)::INT + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31)::INT + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31)::INT + 1, 1), '' ORDER BY g) AS payload_digest
  FROM parts GROUP BY page_id)
SELECT hexed.page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN hexed.page_id = top_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN hexed.page_id = top_id THEN NULL ELSE top_id END AS refers_to
FROM hexed JOIN digests ON hexed.page_id = digests.page_id
"""


@register("op4_warc_chain", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc-archive")
    warc.write_archive(read_table(spark, sf_dir, "pages"), path, min_dedup_bytes=0)
    return warc.resolve(warc.read_records(spark, path)).drop("verified")


QUALITY_THRESHOLD = 0.7


def quality_model(statistics: DataFrame, labels: DataFrame) -> quality.Model:
    """Fit on the labelled rows outside the held-out fold."""
    train = labels.filter(crc_mod("doc_id", 4) != 2).select("doc_id", "quality").dropDuplicates()
    return quality.fit(statistics.join(train, "doc_id"), "quality")


@register("op8_quality_qda")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(quality.with_statistics(read_table(spark, sf_dir, "documents")), "quality-statistics")
    model = quality_model(stats, read_table(spark, sf_dir, "labels"))
    return stats.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
                        quality.score_statistics(model).alias("score")).withColumn(
        "predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int"))


@register("op9_language_filters")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(F.coalesce(crc_mod("doc_id", 5) != 0, F.lit(True))))
    out = language_id.predict(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                      "lang_pred", "score")


REACH_SQL = """
two AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT id, id AS r FROM nodes UNION SELECT reach.id, two.y FROM reach JOIN two ON two.x = reach.r),
least_id AS (SELECT id, min(r) AS least_id FROM reach GROUP BY id),
degree AS (SELECT x AS id, count(*) AS n FROM two GROUP BY x)
"""
OP10_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
nodes AS (SELECT id FROM v),
links AS (SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.label = b.label AND a.id < b.id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
{REACH_SQL}
SELECT v.id AS vec_id, coalesce(n, 0) AS n_links, least_id AS component_id, v.id = least_id AS kept
FROM v JOIN least_id ON least_id.id = v.id LEFT JOIN degree ON degree.id = v.id
"""


@register("op10_vector_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.link_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents),
nodes AS (SELECT id FROM w),
g AS (SELECT DISTINCT id, array_to_string(list_slice(ws, i, i + least(5, len(ws)) - 1), ' ') AS gram
      FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
size AS (SELECT id, count(*) AS n FROM g GROUP BY id),
shared AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN size sx ON sx.id = x JOIN size sy ON sy.id = y WHERE c >= 0.8 * (sx.n + sy.n - c)),
{REACH_SQL},
copies AS (SELECT ws, count(*) AS copies FROM w WHERE len(ws) > 0 GROUP BY ws)
SELECT w.id AS doc_id, least_id AS class_id, coalesce(n, 0) AS n_links, coalesce(copies, 1) AS copies
FROM w JOIN least_id ON least_id.id = w.id LEFT JOIN degree ON degree.id = w.id LEFT JOIN copies ON copies.ws = w.ws
"""


@register("op7_ngram_join", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_texts(read_table(spark, sf_dir, "documents"), threshold=0.8, n=5)


@register("op2_main_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def _marked_sql(text: str) -> str:
    units = "|".join(decontaminate.UNITS.split())
    blanks = "[\\t\\n\\v\\f\\r ]+"
    t = f"translate(coalesce({text}, ''), chr(1) || chr(2), '  ')"
    t = f"regexp_replace({t}, '([{decontaminate.UNSPACED}])', ' \\1 ', 'g')"
    t = f"lower(regexp_replace({t}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(\\p{{Lu}})', '\\1' || chr(1) || 'p\\2', 'g'))"
    t = f"regexp_replace({t}, '([\\p{{L}}\\p{{M}}_]){blanks}\\x01p', '\\1' || chr(2), 'g')"
    t = (f"regexp_replace({t}, '(^|[^\\p{{L}}\\p{{M}}_\\x01\\x02])([\\p{{L}}\\p{{M}}_]*)\\x02', "
         f"'\\1\\2 ' || chr(1) || 'p', 'g')")
    for _ in range(2):
        t = f"regexp_replace({t}, '([0-9])[.,:/]([0-9])', '\\1_\\2', 'g')"
    t = f"regexp_replace({t}, '([0-9][0-9_]*)', ' ' || chr(1) || 'n\\1 ', 'g')"
    t = (f"regexp_replace({t}, '(\\x01n[0-9_]+){blanks}({units})([^\\p{{L}}]|$)', "
         f"'\\1 ' || chr(1) || 'u\\2\\3', 'g')")
    return f"trim(regexp_replace({t}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\x01\\x02]+', ' ', 'g'))"


OP6_SQL = f"""
WITH i0 AS (SELECT DISTINCT item_id, string_split({_marked_sql('text')}, ' ') AS ws,
                   list_transform(regexp_extract_all(coalesce(text, ''),
                       '[\\p{{Ll}}\\p{{N}},;:][\\t\\n\\v\\f\\r ]+(\\p{{Lu}}[\\p{{L}}\\p{{M}}_]*)', 1), lambda x: lower(x)) AS inside
            FROM benchmark),
iu AS (SELECT item_id, ws, inside, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM i0),
iq AS (SELECT item_id, ws, pos, CASE WHEN starts_with(word, chr(1) || 'p')
              AND NOT list_contains(inside, split_part(substr(word, 3), chr(2), 1)) AND ws[1] <> word
              AND (len(list_filter(ws, lambda y: y = word)) < 2 OR list_contains(ws, substr(word, 3)))
              THEN chr(1) || 'q' || substr(word, 3) ELSE word END AS word FROM iu),
i AS (SELECT item_id, list(word ORDER BY pos) AS words FROM iq GROUP BY item_id, ws),
iw AS (SELECT item_id, len(words) AS n, least({decontaminate.WINDOW}, len(words)) AS k, words,
              unnest(range(1, len(words) - least({decontaminate.WINDOW}, len(words)) + 2)) AS ipos
       FROM i WHERE len(words) >= {decontaminate.MIN_ITEM_WORDS}),
w AS (SELECT item_id, ipos, k, list_slice(words, ipos, ipos + k - 1) AS win FROM iw),
lit AS (SELECT item_id, ipos, k, win, array_to_string(list_transform(win, lambda x: regexp_replace(
                   regexp_replace(x, '^\x01q', chr(1) || 'p'), '\x01([npu]).*', chr(1) || '\1')), ' ') AS tpl
        FROM w WHERE len(list_filter(win, lambda x: NOT starts_with(x, chr(1)))) * 2 >= k),
cnt AS (SELECT item_id, count(DISTINCT ipos) AS item_windows FROM lit GROUP BY item_id),
d AS (SELECT doc_id, string_split({_marked_sql('text')}, ' ') AS words FROM documents WHERE doc_id IS NOT NULL),
dp AS (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS dpos
       FROM d, (SELECT DISTINCT k FROM lit) ks WHERE len(words) >= k),
dw AS (SELECT doc_id, dpos, k, list_slice(words, dpos, dpos + k - 1) AS win FROM dp),
dt AS (SELECT *, array_to_string(list_transform(win, lambda x: regexp_replace(x, '\x01([npu]).*', chr(1) || '\1')), ' ') AS tpl
       FROM dw),
m AS (SELECT dt.doc_id, lit.item_id, ipos, dpos - ipos AS shift, lit.win AS iwin, dt.win AS dwin
      FROM dt JOIN lit ON dt.tpl = lit.tpl AND dt.k = lit.k
      WHERE len(list_filter(list_zip(lit.win, dt.win),
                            lambda z: starts_with(z[1], chr(1) || 'q') AND substr(z[1], 3) <> substr(z[2], 3))) = 0),
s AS (SELECT doc_id, item_id, shift, ipos, iwin[j] AS a, dwin[j] AS b
      FROM m, range(1, {decontaminate.WINDOW} + 1) t(j)
      WHERE starts_with(iwin[j], chr(1)) AND NOT starts_with(iwin[j], chr(1) || 'q')),
bad AS (SELECT DISTINCT doc_id, item_id, shift FROM
        (SELECT doc_id, item_id, shift, a FROM s GROUP BY ALL HAVING count(DISTINCT b) > 1)),
chg AS (SELECT doc_id, item_id, shift, ipos, bool_or(a <> b) AS changed FROM s GROUP BY ALL),
ok AS (SELECT m.doc_id, m.item_id, m.ipos, chg.changed
       FROM m ANTI JOIN bad USING (doc_id, item_id, shift) LEFT JOIN chg USING (doc_id, item_id, shift, ipos))
SELECT doc_id, item_id, count(DISTINCT ipos) AS n_windows, max(item_windows) AS item_windows,
       count(DISTINCT ipos) / max(item_windows) AS share,
       CASE WHEN count(DISTINCT ipos) FILTER (WHERE NOT changed) < count(DISTINCT ipos) FILTER (WHERE changed IS NOT NULL)
            THEN 'reparameterised' ELSE 'verbatim' END AS kind
FROM ok JOIN cnt USING (item_id) GROUP BY doc_id, item_id
HAVING count(DISTINCT ipos) >= least({decontaminate.MIN_WINDOWS}, max(item_windows))
"""


@register("op6_template_windows", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.match(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("op3_secret_forest")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"), path_col="source")
    return found.select("doc_id", "no", "start", "n_chars", F.sha2("candidate", 256).alias("secret_sha256"),
                        F.round("score", 6).alias("score"))


@register("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(read_table(spark, sf_dir, "embeddings"), components=8)


def _terms_sql(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_terms_sql('text')} AS ts FROM documents),
held AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM held GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest({_terms_sql('text')}) AS term FROM benchmark),
x AS (SELECT item_id, doc_id, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w, tf,
             100 - 90 + ((90 * n * n_docs) // n_terms) AS m
      FROM asked JOIN tf USING (term) JOIN df USING (term), s),
score AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


@register("op13_ranked_search", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


@register("op12_quality_rules")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))[0]
