"""Corpus preparation queries over QA pairs built from ``conversations`` and
search rows built from ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixed_values as FV
from tessera.functions.text import search_text
from tessera.operators import prep, split
from tessera.plans.catalog import register
from tessera.plans.sqlbits import clean, qa_pairs
from tessera.sources import tables as T

QA = qa_pairs()
CLEANED = f"(SELECT conv_id, turn, {clean('question')} AS question, {clean('answer')} AS answer FROM {QA})"
KEPT_B = (f"(SELECT * FROM {CLEANED} WHERE length(question) >= 10 AND length(answer) >= 50 "
          f"AND length(answer) <= 8000)")
KEPT_C = f"(SELECT * FROM {KEPT_B} WHERE length(question) <= 2000)"

# Content-type lexicon that occurs in the driver's invented prose (the
# default lexicon is Vietnamese and would label every fixture row 'general').
FIXTURE_CONTENT_RULES = [("law", ["gesetz", "loi "]), ("decree", ["tion"]), ("circular", ["ung"]),
                         ("contract", ["ment"]), ("case_law", ["the"])]


def _qa(spark, sf):
    return T.qa_pairs(T.table(spark, sf, "conversations"))


def _kept(spark, sf, preset="B"):
    return prep.quality_filter(_qa(spark, sf), preset)


@register("qa_quality_b", sql=f"SELECT conv_id, turn, question, answer FROM {KEPT_B}")
def qa_quality_b(spark, sf):
    """PF1 + PF2 preset B."""
    return _kept(spark, sf, "B").select("conv_id", "turn", "question", "answer")


@register("qa_quality_c", sql=f"SELECT conv_id, turn, question, answer FROM {KEPT_C}")
def qa_quality_c(spark, sf):
    """PF1 + PF2 preset C."""
    return _kept(spark, sf, "C").select("conv_id", "turn", "question", "answer")


@register("qa_quality_a_count", sql=f"""
SELECT count(*) AS kept_rows FROM {CLEANED}
WHERE length(question) >= 10 AND length(answer) >= 50 AND length(answer) <= 5000 AND question LIKE '%?'
""")
def qa_quality_a_count(spark, sf):
    """PF2 preset A (requires '?')."""
    return _kept(spark, sf, "A").agg(F.count(F.lit(1)).alias("kept_rows"))


@register("text_profile", sql=f"""
SELECT count(*) AS n_rows,
  round(avg(coalesce(length(question),0)), 6) AS q_len_mean, min(coalesce(length(question),0))::BIGINT AS q_len_min,
  max(coalesce(length(question),0))::BIGINT AS q_len_max, round(median(coalesce(length(question),0)), 6) AS q_len_median,
  round(avg(coalesce(length(answer),0)), 6) AS a_len_mean, min(coalesce(length(answer),0))::BIGINT AS a_len_min,
  max(coalesce(length(answer),0))::BIGINT AS a_len_max, round(median(coalesce(length(answer),0)), 6) AS a_len_median,
  count(*) FILTER (WHERE {clean('question')} = '') AS empty_questions,
  count(*) FILTER (WHERE {clean('answer')} = '') AS empty_answers
FROM {QA}
""")
def text_profile(spark, sf):
    """AG1."""
    return prep.text_profile(_qa(spark, sf))


@register("qmark_share", sql=f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE {clean('question')} LIKE '%?') AS n_qmark,
       round(count(*) FILTER (WHERE {clean('question')} LIKE '%?') * 100.0 / count(*), 1) AS pct_qmark
FROM {QA}
""")
def qmark_share(spark, sf):
    """AG2."""
    return prep.qmark_share(_qa(spark, sf))


@register("retention_b", sql=f"""
SELECT 'B' AS preset, (SELECT count(*) FROM {QA}) AS raw_rows, count(*) AS kept_rows,
       printf('%.1f', round(count(*) * 100.0 / (SELECT count(*) FROM {QA}), 1)) || '%' AS retention_rate
FROM {KEPT_B}
""")
def retention_b(spark, sf):
    """AG3."""
    return prep.retention(_qa(spark, sf), "B")


@register("post_stats_b", sql=f"""
SELECT count(*) AS n_rows, round(avg(length(question)), 6) AS q_len_mean,
  min(length(question))::BIGINT AS q_len_min, max(length(question))::BIGINT AS q_len_max,
  round(avg(length(answer)), 6) AS a_len_mean, min(length(answer))::BIGINT AS a_len_min,
  max(length(answer))::BIGINT AS a_len_max
FROM {KEPT_B}
""")
def post_stats_b(spark, sf):
    """AG4."""
    return prep.post_stats(_kept(spark, sf, "B"))


@register("instruction_format", sql=f"""
SELECT conv_id, turn, '{FV.INSTRUCTION_TEXT}' AS instruction, question AS input, answer AS output FROM {KEPT_B}
""")
def instruction_format(spark, sf):
    """SNK2 frame."""
    return prep.to_instruction(_kept(spark, sf, "B"))


@register("conversation_format", sql=f"""
SELECT conv_id, turn, to_json([{{'role': 'user', 'content': question}}, {{'role': 'assistant', 'content': answer}}])::VARCHAR AS conversations
FROM {KEPT_B}
""")
def conversation_format(spark, sf):
    """SNK3 frame."""
    c = prep.to_conversation(_kept(spark, sf, "B"))
    return c.select("conv_id", "turn", F.to_json("conversations").alias("conversations"))


_TRAIN_HEAD = (f"{FV.LLAMA_BEGIN}{FV.LLAMA_SYSTEM_HEADER}\n\n{FV.TRAIN_SYSTEM_PROMPT}{FV.LLAMA_EOT}"
               f"{FV.LLAMA_USER_HEADER}\n\n")
_TRAIN_MID = f"{FV.LLAMA_EOT}{FV.LLAMA_ASSISTANT_HEADER}\n\n"


@register("train_chat_text", sql=f"""
SELECT conv_id, turn, '{_TRAIN_HEAD}' || '{FV.INSTRUCTION_TEXT}' || ' ' || question || '{_TRAIN_MID}' || answer || '{FV.LLAMA_EOT}' AS text
FROM {KEPT_B}
""")
def train_chat_text(spark, sf):
    """PF9 over the instruction frame."""
    return prep.render_train_chat(prep.to_instruction(_kept(spark, sf, "B")))


@register("eval_prompt", sql=f"""
SELECT conv_id, turn, '{_TRAIN_HEAD}' || '{FV.INSTRUCTION_TEXT}' || ' ' || question || '{_TRAIN_MID}' AS prompt
FROM {KEPT_B}
""")
def eval_prompt(spark, sf):
    """PF10."""
    return prep.render_eval_prompt(prep.to_instruction(_kept(spark, sf, "B")))


@register("strip_response", sql=f"""
WITH g AS (SELECT conv_id, turn, '{_TRAIN_HEAD}' || question || '{_TRAIN_MID}' AS prompt,
                  '{_TRAIN_HEAD}' || question || '{_TRAIN_MID}' || answer || '<|eot_id|><|end_of_text|>' AS generated
           FROM {QA})
SELECT conv_id, turn,
  trim(replace(replace(replace(CASE WHEN strpos(generated, prompt) > 0 THEN trim(replace(generated, prompt, '')) ELSE generated END,
       '<|eot_id|>', ''), '<|end_of_text|>', ''), '<|im_end|>', '')) AS response
FROM g
""")
def strip_response(spark, sf):
    """PF13 over generated texts built as prompt + answer + end tokens."""
    qa = _qa(spark, sf)
    g = qa.select("conv_id", "turn",
                  F.concat(F.lit(_TRAIN_HEAD), "question", F.lit(_TRAIN_MID)).alias("prompt"),
                  F.concat(F.lit(_TRAIN_HEAD), "question", F.lit(_TRAIN_MID), "answer",
                           F.lit("<|eot_id|><|end_of_text|>")).alias("generated"))
    return prep.strip_response(g).select("conv_id", "turn", "response")


SPLIT_ORDER = f"""
(SELECT conv_id, turn, row_number() OVER (ORDER BY md5('42:' || conv_id || ':' || turn), conv_id || ':' || turn) - 1 AS pos,
        count(*) OVER () AS n FROM {KEPT_B})
"""


@register("split_exact", sql=f"""
SELECT conv_id, turn,
  CASE WHEN pos < floor(n * 0.8) THEN 'train' WHEN pos < floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split
FROM {SPLIT_ORDER}
""")
def split_exact(spark, sf):
    """SP1 + WN8 over preset-B pairs."""
    return split.split_exact(_kept(spark, sf, "B"), ["conv_id", "turn"]).select("conv_id", "turn", "split")


@register("split_sizes", sql=f"""
WITH s AS (SELECT CASE WHEN pos < floor(n * 0.8) THEN 'train' WHEN pos < floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split
           FROM {SPLIT_ORDER})
SELECT split, count(*) AS n_rows, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM s GROUP BY split
""")
def split_sizes(spark, sf):
    """AG6."""
    return split.split_sizes(split.split_exact(_kept(spark, sf, "B"), ["conv_id", "turn"]))


@register("split_stratified", sql=f"""
WITH k AS (SELECT conv_id, turn, least(floor(log2(length(answer) + 1)), 15)::INT AS stratum,
                  md5('42:' || conv_id || ':' || turn) AS key, conv_id || ':' || turn AS id FROM {KEPT_B}),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key, id) - 1 AS pos,
             count(*) OVER (PARTITION BY stratum) AS n FROM k)
SELECT conv_id, turn, stratum,
  CASE WHEN pos < floor(n * 0.8) THEN 'train' WHEN pos < floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split
FROM r
""")
def split_stratified(spark, sf):
    """SP2: exact split inside answer-length strata."""
    kept = _kept(spark, sf, "B").withColumn("stratum", split.length_stratum(F.col("answer")))
    return split.split_exact(kept, ["conv_id", "turn"], strata="stratum").select(
        "conv_id", "turn", "stratum", "split")


@register("split_length_deciles", sql=f"""
WITH k AS (SELECT conv_id, turn, length(answer) AS n_chars, md5('42:' || conv_id || ':' || turn) AS key, conv_id || ':' || turn AS id
           FROM {KEPT_B}),
s AS (SELECT *, ntile(10) OVER (ORDER BY n_chars, key, id)::INT AS stratum FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key, id) - 1 AS pos, count(*) OVER (PARTITION BY stratum) AS n FROM s)
SELECT conv_id, turn, stratum,
  CASE WHEN pos < floor(n * 0.8) THEN 'train' WHEN pos < floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split
FROM r
""")
def split_length_deciles(spark, sf):
    """SP2: exact split inside ten equal strata by answer length."""
    ids = ["conv_id", "turn"]
    kept = split.equal_strata(_kept(spark, sf, "B"), F.length("answer"), ids, 10)
    return split.split_exact(kept, ids, strata="stratum").select("conv_id", "turn", "stratum", "split")


@register("dataset_metadata", sql=f"""
WITH raw AS (SELECT count(*) AS n FROM {QA}),
kept AS (SELECT count(*) AS n, avg(length(question)) AS q, avg(length(answer)) AS a FROM {KEPT_B})
SELECT kept.n AS total_samples, raw.n AS raw_samples,
       printf('%.1f', round(kept.n * 100.0 / raw.n, 1)) || '%' AS retention_rate,
       round(kept.q, 6) AS avg_question_length, round(kept.a, 6) AS avg_answer_length,
       'Minimum question length: 10 characters|Minimum answer length: 50 characters|Maximum answer length: 8000 characters' AS filters_applied
FROM raw, kept
""")
def dataset_metadata(spark, sf):
    """SNK5: one-row metadata (counts, retention, averages, filters)."""
    return prep.dataset_metadata(_qa(spark, sf), "B")


DOCS_SQL = "(SELECT doc_id, '' AS question, text AS content, coalesce(source, 'unknown') AS source, lang, n_chars FROM documents)"


@register("search_text", sql=f"""
SELECT doc_id, question || ' ' || content AS search_text FROM {DOCS_SQL}
WHERE coalesce(question, '') <> '' OR coalesce(content, '') <> ''
""")
def search_text_q(spark, sf):
    """PF4 + PF5."""
    from tessera.operators.lexical import require_any
    d = require_any(T.search_documents(T.table(spark, sf, "documents")))
    return d.select("doc_id", search_text("question", "content").alias("search_text"))


def _ct_sql(col):
    parts = []
    for label, words in FIXTURE_CONTENT_RULES:
        cond = " OR ".join(f"contains(lower({col}), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + " ELSE 'general' END"


@register("enrich_payload", sql=f"""
SELECT doc_id, length(content)::BIGINT AS doc_length, coalesce(question, '') <> '' AS has_question,
       {_ct_sql('content')} AS content_type
FROM {DOCS_SQL}
""")
def enrich_payload(spark, sf):
    """PF6 + PF7 with a lexicon that occurs in the fixture prose."""
    from tessera.functions.text import detect_content_type
    d = prep.enrich_payload(T.search_documents(T.table(spark, sf, "documents")))
    return d.select("doc_id", "doc_length", "has_question",
                    detect_content_type("content", FIXTURE_CONTENT_RULES).alias("content_type"))


@register("content_type_counts", sql=f"""
SELECT {_ct_sql('content')} AS content_type, count(*) AS n_docs FROM {DOCS_SQL} GROUP BY 1
""")
def content_type_counts(spark, sf):
    """PF6 aggregated."""
    from tessera.functions.text import detect_content_type
    d = T.search_documents(T.table(spark, sf, "documents"))
    return d.groupBy(detect_content_type("content", FIXTURE_CONTENT_RULES).alias("content_type")).agg(
        F.count(F.lit(1)).alias("n_docs"))


@register("payload_filter", sql="""
SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 100 AND n_chars <= 5000
""")
def payload_filter_q(spark, sf):
    """PF8: equality plus range filter (pushed to the parquet scan)."""
    d = T.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return prep.payload_filter(d, {"lang": "en", "n_chars": {"gte": 100, "lte": 5000}, "source": {}})


@register("require_fields", sql=f"""
SELECT count(*) AS n_rows,
       count(*) FILTER (WHERE coalesce(question,'') <> '' AND coalesce(answer,'') <> '') AS n_valid,
       count(*) FILTER (WHERE NOT (coalesce(question,'') <> '' AND coalesce(answer,'') <> '')) AS n_errors
FROM {QA}
""")
def require_fields_q(spark, sf):
    """PF3: valid rows and error count."""
    qa = _qa(spark, sf)
    valid = prep.require_fields(qa, "question", "answer").agg(F.count(F.lit(1)).alias("n_valid"))
    return qa.agg(F.count(F.lit(1)).alias("n_rows")).join(valid, F.lit(True)).select(
        "n_rows", "n_valid", (F.col("n_rows") - F.col("n_valid")).alias("n_errors"))


@register("padding_efficiency", sql=f"""
WITH t AS (SELECT len(string_split_regex({clean(f"'{_TRAIN_HEAD}' || '{FV.INSTRUCTION_TEXT}' || ' ' || question || '{_TRAIN_MID}' || answer || '{FV.LLAMA_EOT}'")}, ' ')) AS n FROM {KEPT_B})
SELECT sum(least(n, 8192))::BIGINT AS real_tokens, count(*) AS n_rows, (count(*) * 8192)::BIGINT AS padded_tokens,
       round(sum(least(n, 8192)) / (count(*) * 8192), 6) AS efficiency FROM t
""")
def padding_efficiency(spark, sf):
    """AG25 on whitespace token counts of the training texts, max length 8192."""
    from tessera.functions.text import whitespace_tokens
    t = train_chat_text(spark, sf).select(F.size(whitespace_tokens("text")).alias("n"))
    return prep.padding_efficiency(t, "n", 8192)


@register("corpus_overview", sql="""
SELECT count(*) AS n_rows, 5::BIGINT AS n_columns,
       'doc_id:bigint,text:string,lang:string,source:string,n_chars:bigint' AS dtypes,
       substr(arg_min(text, doc_id), 1, 100) AS sample
FROM documents
""")
def corpus_overview(spark, sf):
    """AG21: rows, columns, dtypes, first sample cut to 100 chars."""
    return prep.corpus_overview(T.table(spark, sf, "documents"), "doc_id", "text")
