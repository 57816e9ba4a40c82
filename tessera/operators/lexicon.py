"""Matching texts against a lexicon table of any size (JN4, and the banned
words and content rules of AG22 and PF6 when they are tables).

All terms are searched in one pass over the texts: a task builds an automaton
over the terms and reads each text once, whatever the number of terms.  The
terms are sent to the tasks in parts of at most about ``PART_CHARS``
characters, so a lexicon beyond that takes one pass per part; the plan of a
part is the same for ten terms and for a hundred thousand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import fixed_values as FV
from tessera.operators.lexical import top_k

# characters of the terms of one part, on average
PART_CHARS = 8_000_000
# (text, term) rows that leave a task together
FLUSH_ROWS = 50_000


def find_terms(texts: DataFrame, lexicon: DataFrame, text_col: str, term_col: str = "base", keys: list[str] | None = None,
               part_chars: int = PART_CHARS) -> DataFrame:
    """(keys, term): every term that the lower-cased text contains, once per
    text row.  Terms are taken as they are (a term with a capital is never
    met); null and empty terms and null texts meet nothing; a term that the
    lexicon repeats counts once."""
    keys = keys or ["query_id"]
    spark = texts.sparkSession
    terms = lexicon.select(F.col(term_col).cast("string").alias("term")).filter("term <> ''").distinct()
    chars = terms.agg(F.sum(F.length("term"))).first()[0] or 0
    n_parts = max(1, -(-chars // part_chars))
    schema = T.StructType([*texts.select(*keys).schema.fields, T.StructField("term", T.StringType())])
    rows = texts.select(*keys, F.lower(text_col).alias("_low"))

    def matched(part: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick
            automaton = ahocorasick.Automaton()
            for t in shared.value:
                automaton.add_word(t, t)
            if shared.value:
                automaton.make_automaton()
            for b in batches:
                at, found = [], []
                for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                    here = {t for _, t in automaton.iter(text)} if text and shared.value else ()
                    at += [i] * len(here)
                    found += here
                    if len(at) >= FLUSH_ROWS or (at and i == b.num_rows - 1):
                        take = pa.array(at, pa.int64())
                        yield pa.RecordBatch.from_arrays([*(b.column(j).take(take) for j in range(len(keys))), pa.array(found, pa.string())],
                                                         names=[*keys, "term"])
                        at, found = [], []

        return rows.mapInArrow(run, schema)

    out = None
    for p in range(n_parts):
        mine = terms if n_parts == 1 else terms.filter(F.pmod(F.xxhash64("term"), F.lit(n_parts)) == p)
        one = matched([r["term"] for r in mine.collect()])            # at most about part_chars characters
        out = one if out is None else out.unionByName(one)
    return out


def expand_queries(queries: DataFrame, lexicon: DataFrame, query_col: str = "query", keys: list[str] | None = None,
                   max_variants: int = FV.MAX_EXPANSIONS, part_chars: int = PART_CHARS) -> DataFrame:
    """(keys, expanded): SO3 + JN4 with the lexicon as a table (base, ord,
    synonyms).  The query is followed by itself, lower-cased, with a base it
    contains replaced by a synonym, for every base by ``ord`` (ties by base)
    and every other synonym in turn; distinct, cut to ``max_variants`` and
    joined by one space.  Keys name a query; a null query gives an empty text."""
    keys = keys or ["query_id"]
    found = find_terms(queries, lexicon, query_col, keys=keys, part_chars=part_chars)
    lex = lexicon.select(F.col("base").alias("term"), "ord", F.posexplode("synonyms").alias("pos", "syn")).filter(
        F.col("syn").isNotNull() & (F.col("syn") != F.col("term")))
    named = [F.col(c).alias(f"_{c}") for c in keys]
    texts = queries.select(*named, F.col(query_col).alias("_q"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    cands = (found.join(lex, "term").join(texts, on).drop(*(f"_{c}" for c in keys))
             .withColumn("cand", F.replace(F.lower("_q"), F.col("term"), F.col("syn"))).filter(F.col("cand") != F.col("_q")))
    first = cands.groupBy(*keys, "cand").agg(F.min(F.struct("ord", "term", "pos")).alias("place"))
    kept = top_k(first, keys, [F.col("place")], max_variants - 1)
    more = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "cand"))).alias("_more"))
    more = more.select(*named, F.transform("_more", lambda x: x["cand"]).alias("_more"))
    words = F.concat(F.array(F.coalesce(F.col(query_col), F.lit(""))), F.coalesce("_more", F.array().cast("array<string>")))
    return queries.join(more, on, "left").select(*keys, F.array_join(words, " ").alias("expanded"))
