"""Column expressions over text.  All are built-in Spark functions, so they
stay inside whole-stage codegen; nothing here calls Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import fixed_values as FV

# Every character Python's ``str.split()`` treats as whitespace: Java ``\s``
# plus the Unicode separators plus the four information separators and NEL.
WHITESPACE_RUN = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+"

# Word characters for lexical search: letters, combining marks, digits.
TOKEN_SPLIT = r"[^\p{L}\p{M}\p{N}]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """NULL -> ''; collapse each whitespace run to one space; trim."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), WHITESPACE_RUN, " "))


def char_length(c: Column | str) -> Column:
    """Length in code points with NULL counted as 0."""
    return F.coalesce(F.length(_c(c)), F.lit(0))


def is_blank(c: Column | str) -> Column:
    """Python ``not s or s.strip() == ''`` for ASCII-space stripping."""
    return F.length(F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), WHITESPACE_RUN, " "))) == 0


def tokens(c: Column | str) -> Column:
    """Lower-cased word tokens (letters, marks, digits); empties dropped."""
    parts = F.split(F.lower(F.coalesce(_c(c), F.lit(""))), TOKEN_SPLIT)
    return F.array_remove(parts, "")


def whitespace_tokens(c: Column | str) -> Column:
    """Python ``str.split()`` tokens."""
    cleaned = clean_text(c)
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def search_text(question: Column | str, content: Column | str) -> Column:
    """``question + ' ' + content`` with missing parts as ''."""
    return F.concat(F.coalesce(_c(question), F.lit("")), F.lit(" "), F.coalesce(_c(content), F.lit("")))


def contains_any(c: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | c.contains(w)
    return cond


def detect_content_type(c: Column | str, rules=None, default: str = FV.CONTENT_TYPE_DEFAULT) -> Column:
    """Ordered substring rules over the lower-cased text; first match wins."""
    rules = FV.CONTENT_TYPE_RULES if rules is None else rules
    low = F.lower(F.coalesce(_c(c), F.lit("")))
    expr = None
    for label, words in rules:
        cond = contains_any(low, words)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def format_thousands(c: Column | str, decimals: int = 0) -> Column:
    """Python ``f'{x:,.Nf}'`` (HALF_EVEN rounding like Python)."""
    return F.format_number(_c(c), decimals)


def once(expr: Column) -> Column:
    """Generator wrapper that evaluates ``expr`` exactly once per row.

    Use as ``df.select(keys, once(tokens(...)).alias("t"))`` before lambdas
    that index into the array (``transform(seq, i -> slice(t, i, n))``):
    without it the optimizer may inline the tokenizer into the lambda and
    run it once per element."""
    return F.explode(F.array(expr))
