"""Query-side text operators: cleaning and validation (PF14, PF15),
response normalisation (PF16), follow-up detection (PF17, PF18), route
normalisation (PF19), query-variant parsing (PF20), synonym expansion
(SO3, JN4) and web-result rendering (AG18, AG19).

All are column expressions or grouped DataFrame steps; lexicons are
parameters and are compiled into expressions (no join against a lexicon
table, so nothing is paired row-by-row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as FV
from tessera.functions.text import WHITESPACE_RUN, clean_text

_EDGE_WS = r"^[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+$"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` (all Unicode whitespace)."""
    return F.regexp_replace(c, _EDGE_WS, "")


def clean_query(c: Column | str) -> Column:
    """PF14: strip, drop trailing '?!.', collapse whitespace; NULL if <= 3 chars."""
    col = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(py_strip(col), r"[?!.]+$", "")
    s = clean_text(s)
    return F.when(col.isNull(), F.lit(None)).when(F.length(s) > 3, s)


def validate_query(c: Column | str, min_len: int = 5, max_len: int = 1000) -> tuple[Column, Column]:
    """PF15 (first rule set): (valid, reason)."""
    col = F.col(c) if isinstance(c, str) else c
    s = py_strip(col)
    reason = (F.when(col.isNull() | (col == ""), F.lit(FV.QUERY_ERR_EMPTY))
               .when(F.length(s) < min_len, F.lit(FV.QUERY_ERR_SHORT))
               .when(F.length(s) > max_len, F.lit(FV.QUERY_ERR_LONG))
               .when(~s.rlike(r"\p{L}"), F.lit(FV.QUERY_ERR_ALPHA))
               .otherwise(F.lit(FV.QUERY_OK)))
    return reason == FV.QUERY_OK, reason


def simple_valid_query(c: Column | str) -> Column:
    """PF15 (second rule set): 5 < len < 500 and at least one letter."""
    s = py_strip(F.col(c) if isinstance(c, str) else c)
    return (F.length(s) > 5) & (F.length(s) < 500) & s.rlike(r"\p{L}")


def normalise_response(answer: Column, sources: Column, confidence: Column) -> tuple[Column, Column, Column]:
    """PF16: trimmed answer, trimmed non-empty sources, confidence clamped to [0, 1]."""
    a = F.coalesce(py_strip(answer), F.lit(""))
    src = F.filter(F.transform(sources, lambda x: py_strip(x)), lambda x: x != "")
    conf = F.least(F.greatest(confidence.cast("double"), F.lit(0.0)), F.lit(1.0))
    return a, src, conf


def follow_up_flag(msg: Column, lexicon: list[str] | None = None) -> Column:
    """PF17: any indicator is a substring of the lower-cased message."""
    lexicon = FV.FOLLOW_UP_INDICATORS if lexicon is None else lexicon
    low = F.lower(F.coalesce(msg, F.lit("")))
    cond = F.lit(False)
    for w in lexicon:
        cond = cond | low.contains(w)
    return cond


def needs_rewrite(history_len: Column, follow_up: Column) -> Column:
    """PF18: ``not history or (len(history) <= 1 and not follow_up)`` keeps the
    message as it is; everything else is rewritten."""
    keep = (history_len == 0) | ((history_len <= 1) & ~follow_up)
    return ~keep


def normalise_route(model_output: Column, message: Column, labels: list[str] | None = None,
                    keywords: list[str] | None = None) -> tuple[Column, Column]:
    """PF19: exact label; else the first label contained; else calculation
    keyword -> agent_tools; else legal_rag.  Returns (route, how)."""
    labels = FV.ROUTE_LABELS if labels is None else labels
    keywords = FV.CALC_KEYWORDS if keywords is None else keywords
    out = F.lower(py_strip(F.coalesce(model_output, F.lit(""))))
    low_msg = F.lower(F.coalesce(message, F.lit("")))
    exact = out.isin(*labels)
    contained = None
    for lab in labels:
        contained = F.when(out.contains(lab), F.lit(lab)) if contained is None else contained.when(out.contains(lab), F.lit(lab))
    kw = F.lit(False)
    for k in keywords:
        kw = kw | low_msg.contains(k)
    route = F.when(exact, out).otherwise(F.coalesce(contained, F.when(kw, F.lit(FV.ROUTE_KEYWORD)),
                                                    F.lit(FV.ROUTE_DEFAULT)))
    how = F.when(exact, "exact").when(contained.isNotNull(), "contained").when(kw, "keyword").otherwise("default")
    return route, how


def parse_query_variants(df: DataFrame, response: str, original: str, n: int = 3,
                         keys: list[str] | None = None) -> DataFrame:
    """PF20: one row per variant (keys..., variant_idx, query)."""
    keys = keys or []
    lines = F.split(py_strip(F.coalesce(F.col(response), F.lit(""))), "\n")
    lines = F.transform(lines, lambda x: py_strip(x))
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    lines = F.transform(lines, lambda x: py_strip(F.regexp_replace(x, r"^[0-9.\-) ]+", "")))
    lines = F.filter(lines, lambda x: x != "")
    padded = F.concat(lines, F.array_repeat(F.col(original), F.greatest(F.lit(n) - F.size(lines), F.lit(0))))
    return df.select(*keys, F.posexplode(F.slice(padded, 1, n)).alias("variant_idx", "query")) \
             .withColumn("variant_idx", F.col("variant_idx").cast("int"))


def expand_query(q: Column, lexicon: dict | None = None, max_variants: int = FV.MAX_EXPANSIONS) -> Column:
    """SO3 + JN4: the original query, then for every base term contained in the
    lower-cased query and every other synonym the query with the term
    replaced; distinct, in lexicon order, cut to ``max_variants``, joined by ' '."""
    lexicon = FV.LEGAL_EXPANSIONS if lexicon is None else lexicon
    low = F.lower(q)
    cands = [F.when(low.contains(base), F.replace(low, F.lit(base), F.lit(syn)))
             for base, syns in lexicon.items() for syn in syns if syn != base]
    arr = F.concat(F.array(q), F.filter(F.array(*cands), lambda x: x.isNotNull())) if cands else F.array(q)
    return F.array_join(F.slice(F.array_distinct(arr), 1, max_variants), " ")


def format_web_results(results: DataFrame, queries: DataFrame, part: str = "query_id") -> DataFrame:
    """AG18: numbered result list per query; a query without results gets the
    'none found' line.  results: (part, rank, title, url, content, score);
    queries: (part, query, answer)."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("title"), F.lit("\n"),
                    F.lit(FV.WEB_URL_PREFIX), F.col("url"), F.lit("\n"),
                    F.lit("   "), F.substring(F.col("content"), 1, 200), F.lit("...\n"),
                    F.lit(FV.WEB_SCORE_PREFIX), F.format_string("%.2f", F.coalesce(F.col("score"), F.lit(0.0))),
                    F.lit("\n\n"))
    body = results.groupBy(part).agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))).alias("_a"))
    body = body.select(part, F.array_join(F.transform("_a", lambda s: s["l"]), "").alias("_body"))
    j = queries.join(body, part, "left")
    head = F.concat(F.lit(FV.WEB_HEADER), F.col("query"), F.lit("\n\n"))
    ans = F.when(F.coalesce(F.col("answer"), F.lit("")) != "",
                 F.concat(F.lit(FV.WEB_ANSWER_HEADER), F.col("answer"), F.lit("\n\n"))).otherwise(F.lit(""))
    tail = F.coalesce(F.col("_body"), F.lit(FV.WEB_NONE_FOUND))
    return j.select(part, F.concat(head, ans, F.lit(FV.WEB_DETAILS), tail).alias("formatted"))


def first_snippets(results: DataFrame, queries: DataFrame, part: str = "query_id") -> DataFrame:
    """AG19: the answer if present, else the first two contents cut to 150
    chars, else 'no information'."""
    top2 = results.filter(F.col("rank") <= 2).groupBy(part).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("- "), F.substring("content", 1, 150),
                                                             F.lit("...\n")).alias("l")))).alias("_a"))
    top2 = top2.select(part, F.concat(F.lit(FV.WEB_SNIPPET_HEADER),
                                      F.array_join(F.transform("_a", lambda s: s["l"]), "")).alias("_s"))
    j = queries.join(top2, part, "left")
    out = F.when(F.coalesce(F.col("answer"), F.lit("")) != "", F.col("answer")) \
           .otherwise(F.coalesce(F.col("_s"), F.lit(FV.WEB_NO_INFO)))
    return j.select(part, out.alias("snippet"))
