"""Chat-log queries over ``conversations`` (messages) and ``events`` (timed accesses)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixed_values as FV
from tessera.operators import chat, lexical
from tessera.plans.catalog import register
from tessera.plans.sqlbits import BM25_CTES, bm25_query_terms
from tessera.sources import tables as T

SESS_SQL = """
WITH a AS (SELECT event_id, event_type AS bot_id, user_id::VARCHAR AS user_id, ts FROM events),
l AS (SELECT *, lag(ts) OVER (PARTITION BY bot_id, user_id ORDER BY ts, event_id) AS prev FROM a),
s AS (SELECT *, prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= 360000000 AS st FROM l),
m AS (SELECT *, max(CASE WHEN st THEN ts END) OVER (PARTITION BY bot_id, user_id ORDER BY ts, event_id
                                                    ROWS UNBOUNDED PRECEDING) AS ss FROM s),
o AS (SELECT event_id, bot_id, user_id, strftime(ss, '%Y-%m-%d %H:%M:%S.%f') AS session_start FROM m)
"""


def _sessions(spark, sf):
    return chat.sessionize(T.timed_accesses(T.table(spark, sf, "events")), ["bot_id", "user_id"])


@register("sessionize", sql=SESS_SQL + """
SELECT event_id, bot_id, user_id, session_start,
       substr(sha256(bot_id || '.' || user_id || '.' || session_start), 1, 33) AS conversation_id FROM o
""")
def sessionize(spark, sf):
    """WN6: 360 s sliding-TTL session ids per (bot, user)."""
    return _sessions(spark, sf).select("event_id", "bot_id", "user_id", "session_start", "conversation_id")


@register("session_summary", sql=SESS_SQL + """
SELECT bot_id, user_id, count(DISTINCT session_start) AS n_sessions, count(*) AS n_accesses FROM o GROUP BY 1, 2
""")
def session_summary(spark, sf):
    """WN6 aggregated: sessions and accesses per (bot, user)."""
    s = _sessions(spark, sf)
    return s.groupBy("bot_id", "user_id").agg(F.countDistinct("session_start").alias("n_sessions"),
                                              F.count(F.lit(1)).alias("n_accesses"))


HIST_SQL = f"""
WITH rows AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS msg_idx, 'system' AS role, '{FV.CHAT_HISTORY_SYSTEM}' AS content FROM conversations
  UNION ALL
  SELECT conv_id, turn + 1 AS msg_idx, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role,
         coalesce(text, 'None') AS content FROM conversations
),
sz AS (SELECT conv_id, count(*) AS hist, max(msg_idx) AS last FROM rows GROUP BY 1)
"""


def _rows(spark, sf):
    return chat.history_rows(T.chat_log(T.table(spark, sf, "conversations")))


@register("history_rows", sql=HIST_SQL + "SELECT conv_id, msg_idx, role, content FROM rows")
def history_rows(spark, sf):
    """AG7 as rows (system message first, role from is_request)."""
    return _rows(spark, sf).select("conv_id", "msg_idx", "role", "content")


@register("history_last6", sql=HIST_SQL + """
SELECT r.conv_id, r.msg_idx, r.role, r.content FROM rows r JOIN sz USING (conv_id)
WHERE r.role <> 'system' AND sz.hist >= 2 AND r.msg_idx > sz.last - 6
""")
def history_last6(spark, sf):
    """WN4: last six turns (rewrite context)."""
    return chat.last_n_turns(_rows(spark, sf), 6).select("conv_id", "msg_idx", "role", "content")


@register("routing_history_text", sql=HIST_SQL + f"""
SELECT r.conv_id, string_agg(CASE WHEN r.role = 'user' THEN '{FV.HISTORY_ROLE_LABELS["user"]}' || r.content || chr(10)
                               WHEN r.role = 'assistant' THEN '{FV.HISTORY_ROLE_LABELS["assistant"]}' || r.content || chr(10)
                               ELSE '' END, '' ORDER BY r.msg_idx) AS history_text
FROM rows r JOIN sz USING (conv_id)
WHERE r.role <> 'system' AND sz.hist >= 2 AND r.msg_idx > sz.last - 4
GROUP BY r.conv_id
""")
def routing_history_text(spark, sf):
    """WN4: last four turns with Vietnamese role labels (routing context)."""
    return chat.labelled_history_text(chat.last_n_turns(_rows(spark, sf), 4))


@register("history_text", sql=HIST_SQL + """
SELECT conv_id, string_agg(role || ': ' || content || chr(10), '' ORDER BY msg_idx) AS history_text FROM rows GROUP BY 1
""")
def history_text(spark, sf):
    """AG8."""
    return chat.history_text(_rows(spark, sf))


@register("prior_window", sql=HIST_SQL + """
SELECT c.conv_id, c.msg_idx, p.msg_idx AS prior_idx, p.role, p.content
FROM rows c JOIN rows p ON p.conv_id = c.conv_id AND p.msg_idx < c.msg_idx AND p.msg_idx >= c.msg_idx - 4
""")
def prior_window(spark, sf):
    """WN5 (bounded to 4): the messages before each message."""
    r = _rows(spark, sf)
    return chat.prior_window(r, 4).select("conv_id", "msg_idx", "prior_idx", "role", "content")


@register("conversation_stats", sql="""
SELECT conv_id, count(*) AS n_messages, count(*) FILTER (WHERE role = 'user') AS n_questions FROM conversations GROUP BY 1
""")
def conversation_stats(spark, sf):
    """AG15."""
    return chat.conversation_stats(T.table(spark, sf, "conversations"))


_SYS_H = f"{FV.LLAMA_SYSTEM_HEADER}\n\n"
_USR_H = f"{FV.LLAMA_USER_HEADER}\n\n"
_AST_H = f"{FV.LLAMA_ASSISTANT_HEADER}\n\n"
_EOT = f"{FV.LLAMA_EOT}\n"


@register("chat_prompt", sql=f"""
WITH s AS (SELECT conv_id, arg_min(text, turn) AS sys FROM conversations WHERE role = 'system' GROUP BY 1),
b AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '{_USR_H}' || text || '{_EOT}'
                                      WHEN role = 'assistant' THEN '{_AST_H}' || text || '{_EOT}' ELSE '' END, '' ORDER BY turn) AS body
      FROM conversations GROUP BY 1)
SELECT b.conv_id, '{_SYS_H}' || coalesce(nullif(s.sys, ''), '{FV.SERVING_DEFAULT_SYSTEM}') || '{_EOT}' || b.body || '{_AST_H}' AS prompt
FROM b LEFT JOIN s USING (conv_id)
""")
def chat_prompt(spark, sf):
    """PF11."""
    return chat.render_chat_history(T.table(spark, sf, "conversations"))


@register("chat_prompt_lines", sql=f"""
WITH s AS (SELECT conv_id, arg_min(text, turn) AS sys FROM conversations WHERE role = 'system' GROUP BY 1),
c AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1)
SELECT c.conv_id, 0::BIGINT AS line_no, '{_SYS_H}' || coalesce(nullif(s.sys, ''), '{FV.SERVING_DEFAULT_SYSTEM}') || '{_EOT}' AS line
FROM c LEFT JOIN s USING (conv_id)
UNION ALL
SELECT conv_id, turn + 1, CASE WHEN role = 'user' THEN '{_USR_H}' ELSE '{_AST_H}' END || text || '{_EOT}'
FROM conversations WHERE role IN ('user', 'assistant')
UNION ALL
SELECT conv_id, last + 2, '{_AST_H}' FROM c
""")
def chat_prompt_lines(spark, sf):
    """PF11 as ordered lines (the distributed form of ``chat_prompt``)."""
    return chat.render_chat_lines(T.table(spark, sf, "conversations"))


@register("plain_prompt", sql="""
SELECT conv_id, string_agg(CASE WHEN role = 'system' THEN 'System: ' || text || chr(10)
                                WHEN role = 'user' THEN 'Human: ' || text || chr(10)
                                WHEN role = 'assistant' THEN 'Assistant: ' || text || chr(10) ELSE '' END, '' ORDER BY turn)
       || 'Assistant:' AS prompt
FROM conversations GROUP BY 1
""")
def plain_prompt(spark, sf):
    """PF12."""
    return chat.render_plain_history(T.table(spark, sf, "conversations"))


@register("plain_prompt_lines", sql="""
SELECT conv_id, turn AS line_no, CASE role WHEN 'system' THEN 'System: ' WHEN 'user' THEN 'Human: ' ELSE 'Assistant: ' END
       || text || chr(10) AS line FROM conversations WHERE role IN ('system', 'user', 'assistant')
UNION ALL SELECT conv_id, max(turn) + 1, 'Assistant:' FROM conversations GROUP BY conv_id
""")
def plain_prompt_lines(spark, sf):
    """PF12 as ordered lines."""
    return chat.render_plain_lines(T.table(spark, sf, "conversations"))


@register("history_text_lines", sql=HIST_SQL + "SELECT conv_id, msg_idx AS line_no, role || ': ' || content || chr(10) AS line FROM rows")
def history_text_lines(spark, sf):
    """AG8 as ordered lines."""
    return chat.history_lines(_rows(spark, sf))


@register("export_messages", sql="""
SELECT conv_id::VARCHAR AS conversation_id, turn + 1 AS index,
       to_json({'index': turn + 1, 'role': role, 'content': text, 'timestamp': 'Unknown'})::VARCHAR AS message_json
FROM conversations
""")
def export_messages(spark, sf):
    """SNK12 as one row per message."""
    return chat.export_messages(T.table(spark, sf, "conversations"))


_WS = "'[\\s\\p{Z}\\x{0b}\\x{1c}-\\x{1f}\\x{85}]+'"


def _ws_sql(x):
    c = f"trim(regexp_replace(coalesce({x}, ''), {_WS}, ' ', 'g'))"
    return f"(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END)"


@register("token_usage", sql=f"""
WITH m AS (SELECT conv_id, turn, role, text,
                  {_ws_sql("CASE role WHEN 'system' THEN 'System: ' WHEN 'user' THEN 'Human: ' WHEN 'assistant' THEN 'Assistant: ' END || text")} AS tok
           FROM conversations),
r AS (SELECT *, coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
SELECT conv_id, count(*) AS n_completions, sum(before + 1)::BIGINT AS prompt_tokens,
       sum({_ws_sql('text')})::BIGINT AS completion_tokens,
       (sum(before + 1) + sum({_ws_sql('text')}))::BIGINT AS total_tokens
FROM r WHERE role = 'assistant' GROUP BY 1
""")
def token_usage(spark, sf):
    """AG20."""
    return chat.token_usage(T.table(spark, sf, "conversations"))


@register("export_conversations", sql="""
SELECT conv_id::VARCHAR AS conversation_id, count(*) AS total_messages,
       to_json(list({'index': turn + 1, 'role': role, 'content': text, 'timestamp': 'Unknown'} ORDER BY turn))::VARCHAR AS messages_json
FROM conversations GROUP BY conv_id
""")
def export_conversations(spark, sf):
    """SNK12 (turns are dense 0-based, so the 1-based index is turn + 1)."""
    return chat.export_conversations(T.table(spark, sf, "conversations"))


DOCP_SQL = f"""
WITH {BM25_CTES},
q AS ({bm25_query_terms('benchmark', 'item_id', 'text')}),
s AS (SELECT q.query_id, p.doc_id, sum(q.qtf * p.weight) AS score FROM q JOIN bm_post p USING (term) GROUP BY 1, 2),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
      WHERE rank <= 5),
dp AS (SELECT r.query_id, '{FV.DOC_PROMPT_HEADER}' || string_agg('{FV.DOC_PROMPT_QUESTION}' || '' || '{FV.DOC_PROMPT_ANSWER}' || d.text || '{FV.DOC_PROMPT_SEPARATOR}', '' ORDER BY r.rank) AS doc_prompt
       FROM r JOIN documents d USING (doc_id) GROUP BY 1)
"""


def _doc_prompts(spark, sf):
    idx = lexical.build_bm25_index(T.search_documents(T.table(spark, sf, "documents")))
    hits = lexical.bm25_search(idx, T.bench_queries(T.table(spark, sf, "benchmark")), 5)
    return chat.doc_prompt(hits, "query_id", "rank")


@register("doc_prompt", sql=DOCP_SQL + "SELECT query_id, doc_prompt FROM dp")
def doc_prompt(spark, sf):
    """AG16 over the BM25 top-5 of every benchmark text."""
    return _doc_prompts(spark, sf)


@register("rag_messages", sql=DOCP_SQL + f"""
SELECT dp.query_id, to_json([{{'role': 'system', 'content': '{FV.RAG_SYSTEM_PROMPT}'}},
                             {{'role': 'user', 'content': dp.doc_prompt || '{FV.RAG_USER_QUESTION}' || b.text || '{FV.RAG_USER_TAIL}'}}])::VARCHAR AS messages
FROM dp JOIN benchmark b ON b.item_id = dp.query_id
""")
def rag_messages(spark, sf):
    """AG17: system + user(context, question) message arrays."""
    q = T.bench_queries(T.table(spark, sf, "benchmark")).select("query_id", F.col("query").alias("question"))
    m = chat.rag_messages(_doc_prompts(spark, sf), q, "query_id")
    return m.select("query_id", F.to_json("messages").alias("messages"))


@register("chat_rows_with_defaults", sql="""
SELECT conv_id::VARCHAR AS conversation_id, turn, text AS message, role = 'user' AS is_request, NOT (role = 'user') AS completed
FROM conversations
""")
def chat_rows_with_defaults(spark, sf):
    """SNK7 frame: completed = not is_request."""
    c = T.chat_log(T.table(spark, sf, "conversations"))
    return chat.with_chat_defaults(c).select("conversation_id", "turn", "message", "is_request", "completed")


@register("append_chat_log", sql="""
SELECT conv_id::VARCHAR AS conversation_id, turn, role = 'user' AS is_request, NOT (role = 'user') AS completed
FROM conversations
""")
def append_chat_log(spark, sf):
    """SNK7: requests and replies appended to one parquet chat table in two
    separate appends, then read back."""
    from tessera.sources.jsonl import scratch_path
    rows = chat.with_chat_defaults(T.chat_log(T.table(spark, sf, "conversations")))
    rows = rows.select("conversation_id", "turn", "message", "is_request", "completed")
    path = scratch_path(spark, "chat-log")
    chat.append_rows(rows.filter(F.col("is_request")), path)
    chat.append_rows(rows.filter(~F.col("is_request")), path)
    return spark.read.parquet(path).select("conversation_id", "turn", "is_request", "completed")
