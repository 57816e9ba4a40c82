"""Corpus preparation: profiling (AG1-AG4, AG21, AG25), cleaning and quality
filters (PF1-PF5, PF7), output formats (SNK2, SNK3, SNK5, PF9, PF10, PF13),
content typing (PF6) and payload filters (PF8)."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as FV
from tessera.functions.text import char_length, clean_text, detect_content_type, is_blank


def quality_filter(df: DataFrame, preset: str = "B", question: str = "question",
                   answer: str = "answer") -> DataFrame:
    """PF1 + PF2: clean both texts, then keep rows passing the preset."""
    min_q, min_a, max_a, max_q, need_qmark = FV.QUALITY_PRESETS[preset]
    out = df.withColumn(question, clean_text(question)).withColumn(answer, clean_text(answer))
    cond = quality_condition(F.col(question), F.col(answer), preset)
    return out.filter(cond)


def quality_condition(q: Column, a: Column, preset: str) -> Column:
    min_q, min_a, max_a, max_q, need_qmark = FV.QUALITY_PRESETS[preset]
    cond = (F.length(q) >= min_q) & (F.length(a) >= min_a) & (F.length(a) <= max_a)
    if max_q is not None:
        cond = cond & (F.length(q) <= max_q)
    if need_qmark:
        cond = cond & q.endswith("?")
    return cond


def text_profile(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """AG1: raw length profile.  Lengths are small integers, so the exact
    median keeps one counter per distinct length (bounded memory)."""
    ql, al = char_length(question), char_length(answer)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(ql), 6).alias("q_len_mean"), F.min(ql).cast("bigint").alias("q_len_min"),
        F.max(ql).cast("bigint").alias("q_len_max"), F.round(F.median(ql), 6).alias("q_len_median"),
        F.round(F.avg(al), 6).alias("a_len_mean"), F.min(al).cast("bigint").alias("a_len_min"),
        F.max(al).cast("bigint").alias("a_len_max"), F.round(F.median(al), 6).alias("a_len_median"),
        F.count_if(is_blank(question)).alias("empty_questions"),
        F.count_if(is_blank(answer)).alias("empty_answers"),
    )


def qmark_share(df: DataFrame, question: str = "question") -> DataFrame:
    """AG2: questions ending in '?' after stripping, count and percent."""
    ends = clean_text(question).endswith("?")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ends).alias("n_qmark")).select(
        "n_rows", "n_qmark",
        F.round(F.col("n_qmark") * 100.0 / F.col("n_rows"), 1).alias("pct_qmark"))


def retention(df: DataFrame, preset: str = "B", question: str = "question",
              answer: str = "answer") -> DataFrame:
    """AG3: raw and kept counts in one pass, kept share as 'x.y%'."""
    kept = quality_condition(clean_text(question), clean_text(answer), preset)
    agg = df.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(kept).alias("kept_rows"))
    pct = F.round(F.col("kept_rows") * 100.0 / F.col("raw_rows"), 1)
    return agg.select(F.lit(preset).alias("preset"), "raw_rows", "kept_rows",
                      F.concat(F.format_number(pct, 1), F.lit("%")).alias("retention_rate"))


def post_stats(kept: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """AG4: lengths after filtering."""
    ql, al = F.length(question), F.length(answer)
    return kept.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(ql), 6).alias("q_len_mean"), F.min(ql).cast("bigint").alias("q_len_min"),
        F.max(ql).cast("bigint").alias("q_len_max"),
        F.round(F.avg(al), 6).alias("a_len_mean"), F.min(al).cast("bigint").alias("a_len_min"),
        F.max(al).cast("bigint").alias("a_len_max"))


def to_instruction(df: DataFrame, text: str = FV.INSTRUCTION_TEXT) -> DataFrame:
    """SNK2 frame: constant instruction + input/output."""
    return df.select(*[c for c in df.columns if c not in ("question", "answer")],
                     F.lit(text).alias("instruction"), F.col("question").alias("input"),
                     F.col("answer").alias("output"))


def to_conversation(df: DataFrame) -> DataFrame:
    """SNK3 frame: two-turn array of role/content structs."""
    conv = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    return df.select(*[c for c in df.columns if c not in ("question", "answer")], conv.alias("conversations"))


def render_train_chat(df: DataFrame, system: str = FV.TRAIN_SYSTEM_PROMPT) -> DataFrame:
    """PF9: full training text; only ``text`` (plus keys) is kept."""
    keys = [c for c in df.columns if c not in ("instruction", "input", "output")]
    return df.select(*keys, F.concat(
        F.lit(f"{FV.LLAMA_BEGIN}{FV.LLAMA_SYSTEM_HEADER}\n\n{system}{FV.LLAMA_EOT}{FV.LLAMA_USER_HEADER}\n\n"),
        F.col("instruction"), F.lit(" "), F.col("input"),
        F.lit(f"{FV.LLAMA_EOT}{FV.LLAMA_ASSISTANT_HEADER}\n\n"),
        F.col("output"), F.lit(FV.LLAMA_EOT)).alias("text"))


def render_eval_prompt(df: DataFrame, system: str = FV.TRAIN_SYSTEM_PROMPT) -> DataFrame:
    """PF10: the same template up to the assistant header."""
    keys = [c for c in df.columns if c not in ("instruction", "input", "output")]
    return df.select(*keys, F.concat(
        F.lit(f"{FV.LLAMA_BEGIN}{FV.LLAMA_SYSTEM_HEADER}\n\n{system}{FV.LLAMA_EOT}{FV.LLAMA_USER_HEADER}\n\n"),
        F.col("instruction"), F.lit(" "), F.col("input"),
        F.lit(f"{FV.LLAMA_EOT}{FV.LLAMA_ASSISTANT_HEADER}\n\n")).alias("prompt"))


def strip_response(df: DataFrame, generated: str = "generated", prompt: str = "prompt",
                   end_tokens=None) -> DataFrame:
    """PF13: drop the prompt when it occurs, then end tokens, then trim."""
    end_tokens = FV.END_TOKENS if end_tokens is None else end_tokens
    g, p = F.col(generated), F.col(prompt)
    r = F.when(g.contains(p), F.trim(F.replace(g, p, F.lit("")))).otherwise(g)
    for t in end_tokens:
        r = F.replace(r, F.lit(t), F.lit(""))
    return df.withColumn("response", F.trim(r))


def require_fields(df: DataFrame, a: str = "question", b: str = "context") -> DataFrame:
    """PF3: keep rows where both fields are non-empty."""
    return df.filter((F.coalesce(F.col(a), F.lit("")) != "") & (F.coalesce(F.col(b), F.lit("")) != ""))


def enrich_payload(df: DataFrame, content: str = "content", question: str = "question") -> DataFrame:
    """PF7: doc_length, has_question, content_type."""
    return df.withColumns({
        "doc_length": F.coalesce(F.length(content), F.lit(0)).cast("bigint"),
        "has_question": F.coalesce(F.col(question), F.lit("")) != "",
        "content_type": detect_content_type(content),
    })


_COMPARE = {"eq": operator.eq, "gte": operator.ge, "lte": operator.le, "gt": operator.gt, "lt": operator.lt}


def payload_filter(df: DataFrame, filters: dict | None) -> DataFrame:
    """PF8: AND of equality and range conditions.  A dict value with range
    keys adds range bounds; a dict without them adds nothing."""
    triples = [(field, op, bound) for field, value in (filters or {}).items()
               for op, bound in (value.items() if isinstance(value, dict) else [("eq", value)])]
    tests = [_COMPARE[op](F.col(field), F.lit(bound)) for field, op, bound in triples if op in _COMPARE]
    return df.filter(reduce(operator.and_, tests)) if tests else df


def padding_efficiency(df: DataFrame, tokens_col: str, max_len: int) -> DataFrame:
    """AG25: sum(tokens) / (rows * max_len)."""
    return df.agg(F.sum(F.least(F.col(tokens_col), F.lit(max_len))).alias("real_tokens"),
                  F.count(F.lit(1)).alias("n_rows")).select(
        F.col("real_tokens").cast("bigint").alias("real_tokens"), "n_rows",
        (F.col("n_rows") * F.lit(max_len)).cast("bigint").alias("padded_tokens"),
        F.round(F.col("real_tokens") / (F.col("n_rows") * F.lit(max_len)), 6).alias("efficiency"))


def corpus_overview(df: DataFrame, order_col: str, sample_col: str, cut: int = 100) -> DataFrame:
    """AG21: rows, columns, dtypes and the first sample cut to ``cut`` chars."""
    first = F.min_by(F.col(sample_col), F.col(order_col))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), first.alias("first")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(",".join(f"{n}:{t}" for n, t in df.dtypes)).alias("dtypes"),
        F.substring("first", 1, cut).alias("sample"))


def dataset_metadata(raw: DataFrame, preset: str = "B", question: str = "question",
                     answer: str = "answer") -> DataFrame:
    """SNK5: one-row metadata in a single pass over the raw rows."""
    min_q, min_a, max_a, max_q, need_qmark = FV.QUALITY_PRESETS[preset]
    q, a = clean_text(question), clean_text(answer)
    kept = quality_condition(q, a, preset)
    filters = [f"Minimum question length: {min_q} characters",
               f"Minimum answer length: {min_a} characters",
               f"Maximum answer length: {max_a} characters"]
    if max_q is not None:
        filters.append(f"Maximum question length: {max_q} characters")
    if need_qmark:
        filters.append("Questions must end with '?'")
    agg = raw.agg(F.count(F.lit(1)).alias("raw_samples"), F.count_if(kept).alias("total_samples"),
                  F.avg(F.when(kept, F.length(q))).alias("q"), F.avg(F.when(kept, F.length(a))).alias("a"))
    pct = F.round(F.col("total_samples") * 100.0 / F.col("raw_samples"), 1)
    return agg.select("total_samples", "raw_samples",
                      F.concat(F.format_number(pct, 1), F.lit("%")).alias("retention_rate"),
                      F.round("q", 6).alias("avg_question_length"), F.round("a", 6).alias("avg_answer_length"),
                      F.lit("|".join(filters)).alias("filters_applied"))
