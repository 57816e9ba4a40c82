"""Chat tables: sessions (WN6), history (AG7, AG8, WN4, WN5), renderings
(PF11, PF12), statistics (AG15, AG20), prompts (AG16, AG17), export (SNK12)
and appends with defaults (SNK7).

Order inside a conversation is by position, whatever numbers the ordinals
have.  "Last n" is a per-task top-n before the exchange; positions and running
sums are computed per block of ordinals with one row per block carried over,
so a very long conversation is spread over tasks.  A key with NULL in it is a
key like any other: tables are joined back on a struct of the keys, in which
NULL equals NULL.  Renderings that are one value per conversation by
definition have a line form (one row per line) for unbounded conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed_values as FV
from tessera.functions.time import epoch_micros, from_epoch_micros


# --------------------------------------------------------------------------- sessions
def sessionize(df: DataFrame, keys: list[str], ts: str = "ts", ttl: int = FV.SESSION_TTL_SECONDS,
               tie: str = "event_id", bucket_seconds: int = 3600) -> DataFrame:
    """WN6: a session per key is refreshed at every access; a gap >= ttl
    starts a new one.  Adds ``session_start`` and ``conversation_id``
    (first 33 hex chars of sha256('<key1>.<key2>.<start>')).

    Skew: windows run per (key, time bucket), so one very active key is
    split into many partitions.  The state crossing bucket borders (last
    access, last session start) comes from one row per (key, bucket),
    ordered per key over a table whose size is the number of buckets.
    """
    ts_type = dict(df.dtypes)[ts]
    e = df.withColumn("_t", epoch_micros(F.col(ts), ts_type)).withColumn("_key", F.struct(*keys)).withColumn(
        "_bk", F.coalesce(F.floor(F.col("_t") / F.lit(bucket_seconds * 1_000_000)), F.lit(-1)))
    # the one exchange of the accesses: summaries, windows and joins below reuse it
    e = e.repartition("_key", "_bk")
    w_in = Window.partitionBy("_key", "_bk").orderBy("_t", tie)
    w_b = Window.partitionBy("_key").orderBy("_bk")
    per_bucket = e.groupBy("_key", "_bk").agg(F.max("_t").alias("_bmax")).select(
        "_key", "_bk", F.lag("_bmax").over(w_b).alias("_prev_max"))
    e = e.join(per_bucket, ["_key", "_bk"])
    prev = F.coalesce(F.lag("_t").over(w_in), F.col("_prev_max"))
    e = e.withColumn("_start", prev.isNull() | (F.col("_t") - prev >= F.lit(ttl * 1_000_000)))
    e = e.withColumn("_start_in", F.max(F.when(F.col("_start"), F.col("_t"))).over(
        w_in.rowsBetween(Window.unboundedPreceding, 0)))
    last_start = e.groupBy("_key", "_bk").agg(F.max(F.when(F.col("_start"), F.col("_t"))).alias("_ls")).select(
        "_key", "_bk", F.last("_ls", ignorenulls=True).over(
            w_b.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    e = e.join(last_start, ["_key", "_bk"])
    start_us = F.coalesce(F.col("_start_in"), F.col("_carry"))
    start_ts = from_epoch_micros(start_us, ts_type)
    start_txt = F.date_format(start_ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    sid = F.substring(F.sha2(F.concat_ws(".", *[F.col(k).cast("string") for k in keys], start_txt), 256), 1, 33)
    return e.withColumn("session_start", start_txt).withColumn("conversation_id", sid) \
            .drop("_t", "_key", "_bk", "_prev_max", "_start", "_start_in", "_carry")


def session_summary(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions per key: number of accesses and span of each session."""
    return sessions.groupBy(*keys, "conversation_id", "session_start").agg(
        F.count(F.lit(1)).alias("n_accesses"))


# --------------------------------------------------------------------------- history
def history_rows(chat: DataFrame, conv: str = "conv_id", order: str = "turn",
                 system_text: str = FV.CHAT_HISTORY_SYSTEM) -> DataFrame:
    """AG7 as rows: (conv, msg_idx, role, content) with the system row at 0;
    role from ``is_request``; ``order`` is the dense 0-based message ordinal."""
    msgs = chat.select(conv, (F.col(order) + 1).alias("msg_idx"),
                       F.when(F.col("is_request"), "user").otherwise("assistant").alias("role"),
                       F.coalesce(F.col("message").cast("string"), F.lit("None")).alias("content"))
    system = chat.select(conv).distinct().select(conv, F.lit(0).cast(msgs.schema["msg_idx"].dataType).alias("msg_idx"),
                                                 F.lit("system").alias("role"), F.lit(system_text).alias("content"))
    return system.unionByName(msgs)


def last_n_turns(rows: DataFrame, n: int, conv: str = "conv_id", idx: str = "msg_idx",
                 drop_system: bool = True, min_history: int = 2) -> DataFrame:
    """WN4: the last ``n`` messages of every conversation whose history has
    more than one message; the system row is not a turn.  "Last" is by
    position: the ordinals may have gaps.  The rank filter is planned as a
    partial top-n, so ``n`` rows of a conversation leave a task."""
    r = rows.filter(F.col("role") != "system") if drop_system else rows
    w = Window.partitionBy(conv).orderBy(F.col(idx).desc(), F.col("role").desc(), F.col("content").desc())
    last = r.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).withColumn("_key", F.struct(conv))
    size = rows.groupBy(F.struct(conv).alias("_key")).agg(F.count(F.lit(1)).alias("_hist"))
    return last.join(size, "_key").filter(F.col("_hist") >= min_history).drop("_hist", "_rn", "_key")


def prior_window(rows: DataFrame, n: int, conv: str = "conv_id", idx: str = "msg_idx") -> DataFrame:
    """WN5 (bounded): for every message, the up-to-``n`` messages before it,
    as rows (conv, msg_idx, prior_idx, role, content).  Each message is paired
    with the next ``n`` positions by an equi-join, never a whole-group frame."""
    placed = exclusive_running_sum(rows.withColumn("_one", F.lit(1)), conv, idx, "_one", "_pos", ties=["role", "content"])
    placed = placed.withColumn("_key", F.struct(conv))
    slots = placed.select("_key", F.col(idx).alias("prior_idx"), "role", "content", "_pos",
                          F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_j"))
    slots = slots.withColumn("_pos", F.col("_pos") + F.col("_j")).drop("_j")
    return placed.select("_key", conv, idx, "_pos").join(slots, ["_key", "_pos"]).drop("_key", "_pos")


def labelled_history_text(rows: DataFrame, conv: str = "conv_id", idx: str = "msg_idx") -> DataFrame:
    """Rewrite/routing history text: 'Người dùng: ' / 'Trợ lý: ' lines, order kept."""
    lab = F.when(F.col("role") == "user", F.concat(F.lit(FV.HISTORY_ROLE_LABELS["user"]), "content", F.lit("\n"))) \
           .when(F.col("role") == "assistant",
                 F.concat(F.lit(FV.HISTORY_ROLE_LABELS["assistant"]), "content", F.lit("\n"))).otherwise(F.lit(""))
    return _ordered_concat(rows.select(conv, idx, lab.alias("_line")), conv, idx, "_line", "history_text")


def _ordered_concat(df: DataFrame, part: str, idx: str, col: str, out: str) -> DataFrame:
    g = df.groupBy(part).agg(F.sort_array(F.collect_list(F.struct(idx, col))).alias("_a"))
    return g.select(part, F.array_join(F.transform("_a", lambda s: s[col]), "").alias(out))


def history_text(rows: DataFrame, conv: str = "conv_id", idx: str = "msg_idx") -> DataFrame:
    """AG8: 'role: content\\n' for every message in order (one text per conversation)."""
    line = F.concat(F.col("role"), F.lit(": "), F.col("content"), F.lit("\n"))
    return _ordered_concat(rows.select(conv, idx, line.alias("_line")), conv, idx, "_line", "history_text")


def render_chat_history(msgs: DataFrame, conv: str = "conv_id", idx: str = "turn", role: str = "role",
                        content: str = "text", default_system: str = FV.SERVING_DEFAULT_SYSTEM) -> DataFrame:
    """PF11: first system message (else the default), then user/assistant turns,
    then an open assistant header."""
    first_sys = msgs.filter(F.col(role) == "system").groupBy(conv).agg(
        F.min_by(F.col(content), F.col(idx)).alias("_sys"))
    head = F.concat(F.lit(f"{FV.LLAMA_SYSTEM_HEADER}\n\n"), F.coalesce(F.nullif(F.col("_sys"), F.lit("")),
                                                                     F.lit(default_system)),
                    F.lit(f"{FV.LLAMA_EOT}\n"))
    line = F.when(F.col(role) == "user", F.concat(F.lit(f"{FV.LLAMA_USER_HEADER}\n\n"), F.col(content),
                                                  F.lit(f"{FV.LLAMA_EOT}\n"))) \
            .when(F.col(role) == "assistant", F.concat(F.lit(f"{FV.LLAMA_ASSISTANT_HEADER}\n\n"), F.col(content),
                                                       F.lit(f"{FV.LLAMA_EOT}\n"))).otherwise(F.lit(""))
    body = _ordered_concat(msgs.select(conv, idx, line.alias("_line")), conv, idx, "_line", "_body")
    out = body.join(first_sys, conv, "left")
    return out.select(conv, F.concat(head, F.col("_body"), F.lit(f"{FV.LLAMA_ASSISTANT_HEADER}\n\n")).alias("prompt"))


def render_chat_lines(msgs: DataFrame, conv: str = "conv_id", idx: str = "turn", role: str = "role",
                      content: str = "text", default_system: str = FV.SERVING_DEFAULT_SYSTEM) -> DataFrame:
    """PF11 as rows (conv, line_no, line): concatenating a conversation's
    lines by ``line_no`` gives ``render_chat_history``'s prompt.  No task
    gathers a conversation, so arbitrarily long conversations stay
    distributed; a writer sorted by (conv, line_no) produces the texts.
    Line 0 is the system block, message lines are numbered ``turn + 1``, the
    open assistant header is the last line."""
    first_sys = msgs.filter(F.col(role) == "system").groupBy(conv).agg(
        F.min_by(F.col(content), F.col(idx)).alias("_sys"))
    convs = msgs.groupBy(conv).agg(F.max(idx).alias("_last"))
    head = convs.join(first_sys, conv, "left").select(
        conv, F.lit(0).cast("bigint").alias("line_no"),
        F.concat(F.lit(f"{FV.LLAMA_SYSTEM_HEADER}\n\n"),
                 F.coalesce(F.nullif(F.col("_sys"), F.lit("")), F.lit(default_system)),
                 F.lit(f"{FV.LLAMA_EOT}\n")).alias("line"))
    body = msgs.filter(F.col(role).isin("user", "assistant")).select(
        conv, (F.col(idx) + 1).cast("bigint").alias("line_no"),
        F.concat(F.when(F.col(role) == "user", F.lit(f"{FV.LLAMA_USER_HEADER}\n\n"))
                 .otherwise(F.lit(f"{FV.LLAMA_ASSISTANT_HEADER}\n\n")), F.col(content),
                 F.lit(f"{FV.LLAMA_EOT}\n")).alias("line"))
    tail = convs.select(conv, (F.col("_last") + 2).cast("bigint").alias("line_no"),
                        F.lit(f"{FV.LLAMA_ASSISTANT_HEADER}\n\n").alias("line"))
    return head.unionByName(body).unionByName(tail)


def render_plain_history(msgs: DataFrame, conv: str = "conv_id", idx: str = "turn", role: str = "role",
                         content: str = "text") -> DataFrame:
    """PF12: 'System: / Human: / Assistant:' lines then 'Assistant:'."""
    line = F.when(F.col(role) == "system", F.concat(F.lit("System: "), F.col(content), F.lit("\n"))) \
            .when(F.col(role) == "user", F.concat(F.lit("Human: "), F.col(content), F.lit("\n"))) \
            .when(F.col(role) == "assistant", F.concat(F.lit("Assistant: "), F.col(content), F.lit("\n"))) \
            .otherwise(F.lit(""))
    body = _ordered_concat(msgs.select(conv, idx, line.alias("_line")), conv, idx, "_line", "_body")
    return body.select(conv, F.concat("_body", F.lit("Assistant:")).alias("prompt"))


def render_plain_lines(msgs: DataFrame, conv: str = "conv_id", idx: str = "turn", role: str = "role",
                       content: str = "text") -> DataFrame:
    """PF12 as rows (conv, line_no, line): joined by ``line_no`` they are
    ``render_plain_history``'s prompt; no task gathers a conversation."""
    label = F.when(F.col(role) == "system", "System: ").when(F.col(role) == "user", "Human: ") \
             .when(F.col(role) == "assistant", "Assistant: ")
    body = msgs.filter(label.isNotNull()).select(conv, F.col(idx).cast("bigint").alias("line_no"),
                                                 F.concat(label, F.col(content), F.lit("\n")).alias("line"))
    tail = msgs.groupBy(conv).agg((F.max(idx) + 1).cast("bigint").alias("line_no")).withColumn(
        "line", F.lit("Assistant:"))
    return body.unionByName(tail)


def history_lines(rows: DataFrame, conv: str = "conv_id", idx: str = "msg_idx") -> DataFrame:
    """AG8 as rows (conv, line_no, line), the distributed form of ``history_text``."""
    return rows.select(conv, F.col(idx).alias("line_no"),
                       F.concat(F.col("role"), F.lit(": "), F.col("content"), F.lit("\n")).alias("line"))


def export_messages(msgs: DataFrame, conv: str = "conv_id", idx: str = "turn", role: str = "role",
                    content: str = "text", ts: str | None = None) -> DataFrame:
    """SNK12 as one row per message (conversation_id, index, message_json) with
    the 1-based position as index, for conversations beyond one task."""
    stamp = F.coalesce(F.col(ts).cast("string"), F.lit("Unknown")) if ts else F.lit("Unknown")
    placed = exclusive_running_sum(msgs.withColumn("_one", F.lit(1)), conv, idx, "_one", "_pos", ties=[role, content])
    index = (F.col("_pos") + 1).cast("bigint")
    return placed.select(F.col(conv).cast("string").alias("conversation_id"), index.alias("index"),
                         F.to_json(F.struct(index.alias("index"), F.col(role).alias("role"),
                                            F.col(content).alias("content"), stamp.alias("timestamp")))
                         .alias("message_json"))


def conversation_stats(msgs: DataFrame, conv: str = "conv_id", role: str = "role") -> DataFrame:
    """AG15: messages and user questions per conversation."""
    return msgs.groupBy(conv).agg(F.count(F.lit(1)).alias("n_messages"),
                                  F.count_if(F.col(role) == "user").alias("n_questions"))


def _ws_count(c: Column) -> Column:
    cleaned = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+", " "))
    return F.when(cleaned == "", 0).otherwise(F.size(F.split(cleaned, " ")))


def token_usage(msgs: DataFrame, conv: str = "conv_id", idx: str = "turn", role: str = "role",
                content: str = "text") -> DataFrame:
    """AG20: for every assistant turn, whitespace tokens of the plain prompt
    (all earlier messages + 'Assistant:') and of the completion; summed per
    conversation.  The running prompt size is a streaming running sum."""
    label = F.when(F.col(role) == "system", "System: ").when(F.col(role) == "user", "Human: ") \
             .when(F.col(role) == "assistant", "Assistant: ")
    m = msgs.withColumn("_tok", F.when(label.isNull(), 0).otherwise(_ws_count(F.concat(label, F.col(content)))))
    m = exclusive_running_sum(m, conv, idx, "_tok", "_before")
    a = m.filter(F.col(role) == "assistant").select(
        conv, (F.col("_before") + 1).alias("prompt_tokens"), _ws_count(F.col(content)).alias("completion_tokens"))
    return a.groupBy(conv).agg(F.count(F.lit(1)).alias("n_completions"),
                               F.sum("prompt_tokens").cast("bigint").alias("prompt_tokens"),
                               F.sum("completion_tokens").cast("bigint").alias("completion_tokens")) \
            .withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def exclusive_running_sum(df: DataFrame, part: str, idx: str, value: str, out: str,
                          block: int = 1000, ties: list[str] | None = None) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same ``part``, ordered by
    ``idx`` (gaps and NULLs allowed; NULL values count 0, a NULL ``idx`` comes
    first).  Windows run per (part, block of ``block`` ordinals); the totals
    of earlier blocks come from a one-row-per-block table, so a very long
    group is spread over many tasks."""
    d = df.withColumn("_key", F.struct(part)).withColumn("_blk", F.coalesce(F.floor(F.col(idx) / block), F.lit(-(1 << 62))))
    d = d.repartition("_key", "_blk")
    w_in = Window.partitionBy("_key", "_blk").orderBy(idx, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    tot = d.groupBy("_key", "_blk").agg(F.sum(value).alias("_t")).select("_key", "_blk", F.coalesce(F.sum("_t").over(
        Window.partitionBy("_key").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_prev"))
    d = d.withColumn("_in", F.coalesce(F.sum(value).over(w_in), F.lit(0))).join(tot, ["_key", "_blk"])
    return d.withColumn(out, F.col("_prev") + F.col("_in")).drop("_key", "_blk", "_in", "_prev")


def doc_prompt(hits: DataFrame, part: str = "request_id", order: str = "rerank_rank",
               question: str = "question", content: str = "content") -> DataFrame:
    """AG16: header + 'Câu hỏi: q \\n Câu trả lời: c \\n\\n' per hit in rank order."""
    line = F.concat(F.lit(FV.DOC_PROMPT_QUESTION), F.coalesce(F.col(question), F.lit("")),
                    F.lit(FV.DOC_PROMPT_ANSWER), F.coalesce(F.col(content), F.lit("")), F.lit(FV.DOC_PROMPT_SEPARATOR))
    body = _ordered_concat(hits.select(part, order, line.alias("_line")), part, order, "_line", "_body")
    return body.select(part, F.concat(F.lit(FV.DOC_PROMPT_HEADER), "_body").alias("doc_prompt"))


def rag_messages(prompts: DataFrame, questions: DataFrame, part: str = "request_id",
                 history: DataFrame | None = None, system: str = FV.RAG_SYSTEM_PROMPT) -> DataFrame:
    """AG17: [system] + history + [user(doc context + question + instruction)]."""
    df = prompts.join(questions.select(part, "question"), part)
    user = F.struct(F.lit("user").alias("role"),
                    F.concat("doc_prompt", F.lit(FV.RAG_USER_QUESTION), "question", F.lit(FV.RAG_USER_TAIL))
                    .alias("content"))
    sys_msg = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    hist = F.array().cast("array<struct<role:string,content:string>>")
    if history is not None:
        df = df.join(history.select(part, "history"), part, "left")
        hist = F.coalesce(F.col("history"), hist)
    return df.select(part, F.concat(sys_msg, hist, F.array(user)).alias("messages"))


def export_conversations(msgs: DataFrame, conv: str = "conv_id", idx: str = "turn", role: str = "role",
                         content: str = "text", ts: str | None = None) -> DataFrame:
    """SNK12: per conversation: id, message count and 1-based indexed messages
    (timestamp 'Unknown' when absent) as a JSON document."""
    stamp = F.coalesce(F.col(ts).cast("string"), F.lit("Unknown")) if ts else F.lit("Unknown")
    g = msgs.groupBy(conv).agg(F.count(F.lit(1)).alias("total_messages"),
                               F.sort_array(F.collect_list(F.struct(F.col(idx).alias("_i"), F.col(role).alias("role"),
                                                                    F.col(content).alias("content"),
                                                                    stamp.alias("timestamp")))).alias("_m"))
    msgs_json = F.transform("_m", lambda s, i: F.struct((i + 1).alias("index"), s["role"].alias("role"),
                                                         s["content"].alias("content"), s["timestamp"].alias("timestamp")))
    return g.select(F.col(conv).cast("string").alias("conversation_id"), "total_messages",
                    F.to_json(msgs_json).alias("messages_json"))


def with_chat_defaults(df: DataFrame) -> DataFrame:
    """SNK7: defaults of appended chat rows (completed = not is_request)."""
    return df.withColumn("is_request", F.coalesce(F.col("is_request"), F.lit(True))) \
             .withColumn("completed", ~F.col("is_request")) \
             .withColumn("conversation_id", F.coalesce(F.col("conversation_id"), F.lit("")))


def append_rows(df: DataFrame, path: str) -> None:
    """SNK7: append to a parquet table (each batch is one atomic job commit)."""
    df.write.mode("append").parquet(path)


def append_documents(df: DataFrame, path: str) -> None:
    """SNK7: append (question, content) documents with their creation and
    update times; other columns are not stored."""
    df.select(F.col("question").cast("string"), F.col("content").cast("string"),
              F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at")) \
      .write.mode("append").parquet(path)
