"""Evaluation over prediction tables: perplexity (EV1), ROUGE-N (EV2),
ROUGE-L (EV3), detail rows (EV4, JN8), judge summary (EV5), summaries
(AG12), histograms (AG13) and base-vs-tuned improvement (AG14, JN7).

ROUGE-N is a pure DataFrame job: n-grams are exploded with their counts per
(row, side), the two sides are joined on (row, n-gram) and the clipped
overlap is summed per row - nothing leaves the JVM.  ROUGE-L needs an LCS
per row; it runs as an Arrow pandas UDF using the bit-parallel LCS length
(one machine word per 64 tokens, rows independent).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import fixed_values as FV
from tessera.functions.text import once, tokens

ASCII_SPLIT = r"[^a-z0-9]+"


def rouge_tokens(c: Column | str, token_class: str = "unicode") -> Column:
    """Tokens for ROUGE: 'unicode' = letters/marks/digits; 'ascii' = [a-z0-9]
    runs of the lower-cased text (the common scorer's default)."""
    if token_class == "ascii":
        col = F.col(c) if isinstance(c, str) else c
        return F.array_remove(F.split(F.lower(F.coalesce(col, F.lit(""))), ASCII_SPLIT), "")
    return tokens(c)


def ngrams(toks: Column, n: int) -> Column:
    if n == 1:
        return toks
    return F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1),
                       lambda i: F.array_join(F.slice(toks, i, n), " "))


def _ngram_counts(df: DataFrame, id_col: str, text_col: str, n: int, token_class: str, side: str) -> DataFrame:
    t = df.select(id_col, once(rouge_tokens(text_col, token_class)).alias("_t"))
    g = t.select(id_col, F.when(F.size("_t") >= n, ngrams(F.col("_t"), n)).alias("_g"))
    return g.select(id_col, F.explode("_g").alias("gram")).groupBy(id_col, "gram").agg(
        F.count(F.lit(1)).alias(side))


def rouge_n(df: DataFrame, n: int, id_col: str = "id", reference: str = "reference",
            prediction: str = "prediction", token_class: str = "unicode") -> DataFrame:
    """EV2: (id, rouge{n}_p, rouge{n}_r, rouge{n}_f1) for every row.

    One pass over ``df``: the reference and prediction n-grams of a row are
    exploded together with a side tag, counted per (id, n-gram) and reduced
    per id (clipped overlap = sum of min counts).  A row without n-grams
    keeps one empty entry, so every input row has an output row."""
    t = df.select(id_col, once(F.struct(rouge_tokens(reference, token_class).alias("r"),
                                        rouge_tokens(prediction, token_class).alias("p"))).alias("_t"))

    def tagged(col, r, p):
        grams = F.when(F.size(col) >= n, ngrams(col, n)).otherwise(F.array().cast("array<string>"))
        return F.transform(grams, lambda g: F.struct(g.alias("gram"), F.lit(r).alias("r"), F.lit(p).alias("p")))

    both = F.concat(tagged(F.col("_t.r"), 1, 0), tagged(F.col("_t.p"), 0, 1))
    g = t.select(id_col, F.explode_outer(both).alias("_g"))
    per_gram = g.groupBy(id_col, F.col("_g.gram").alias("gram")).agg(
        F.coalesce(F.sum("_g.r"), F.lit(0)).alias("r"), F.coalesce(F.sum("_g.p"), F.lit(0)).alias("p"))
    per_row = per_gram.groupBy(id_col).agg(F.sum(F.least("r", "p")).alias("overlap"),
                                           F.sum("r").alias("n_ref"), F.sum("p").alias("n_pred"))
    ov = F.col("overlap").cast("double")
    prec = F.when(F.col("n_pred") > 0, ov / F.col("n_pred")).otherwise(0.0)
    rec = F.when(F.col("n_ref") > 0, ov / F.col("n_ref")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return per_row.select(id_col, prec.alias(f"rouge{n}_p"), rec.alias(f"rouge{n}_r"), f1.alias(f"rouge{n}_f1"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Bit-parallel LCS length (Hyyrö): O(len(a) * len(b) / wordsize)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for t in b:
        m = masks.get(t)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def _rouge_l_f1(ref: pd.Series, pred: pd.Series) -> pd.Series:
    out = np.zeros(len(ref), dtype=np.float64)
    for i, (r, p) in enumerate(zip(ref, pred)):
        r = list(r) if r is not None else []
        p = list(p) if p is not None else []
        if not r or not p:
            continue
        lcs = lcs_length(r, p)
        if lcs == 0:
            continue
        prec, rec = lcs / len(p), lcs / len(r)
        out[i] = 2 * prec * rec / (prec + rec)
    return pd.Series(out)


rouge_l_udf = F.pandas_udf(_rouge_l_f1, T.DoubleType())


def rouge_l(df: DataFrame, id_col: str = "id", reference: str = "reference",
            prediction: str = "prediction", token_class: str = "unicode") -> DataFrame:
    """EV3: LCS-based F1 per row (Arrow batches; tokens are built JVM-side)."""
    return df.select(id_col, rouge_l_udf(rouge_tokens(reference, token_class),
                                         rouge_tokens(prediction, token_class)).alias("rougeL_f1"))


def row_metrics(df: DataFrame, ns=(1, 2), with_l: bool = True, id_col: str = "id",
                reference: str = "reference", prediction: str = "prediction", loss: str | None = "loss",
                token_class: str = "unicode") -> DataFrame:
    """EV1-EV3 in one pass over ``df``: loss, perplexity, ROUGE-n F1 for
    every n in ``ns`` and ROUGE-L F1 per row.  Tokens are built once per row;
    the n-grams of every n and both sides are exploded together with tags,
    counted per (id, n, n-gram) and reduced per id."""
    tok = F.struct(rouge_tokens(reference, token_class).alias("r"), rouge_tokens(prediction, token_class).alias("p"))
    carried = [F.col(loss).cast("double").alias("_loss")] if loss else []
    t = df.select(id_col, *carried, once(tok).alias("_t"))
    if with_l:
        t = t.withColumn("_rl", rouge_l_udf(F.col("_t.r"), F.col("_t.p")))
    def tag(n: int, is_ref: bool):
        return lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"),
                                  F.lit(1 if is_ref else 0).alias("r"), F.lit(0 if is_ref else 1).alias("p"))

    parts = []
    for n in ns:
        for is_ref, col in ((True, F.col("_t.r")), (False, F.col("_t.p"))):
            grams = F.when(F.size(col) >= n, ngrams(col, n)).otherwise(F.array().cast("array<string>"))
            parts.append(F.transform(grams, tag(n, is_ref)))
    keep = [c for c in ("_loss", "_rl") if c in t.columns]
    g = t.select(id_col, *keep, F.explode_outer(F.concat(*parts)).alias("_g"))
    per_gram = g.groupBy(id_col, *keep, F.col("_g.n").alias("n"), F.col("_g.gram").alias("gram")).agg(
        F.coalesce(F.sum("_g.r"), F.lit(0)).alias("r"), F.coalesce(F.sum("_g.p"), F.lit(0)).alias("p"))
    aggs = []
    for n in ns:
        on = F.col("n") == n
        aggs += [F.sum(F.when(on, F.least("r", "p")).otherwise(0)).alias(f"_ov{n}"),
                 F.sum(F.when(on, F.col("r")).otherwise(0)).alias(f"_nr{n}"),
                 F.sum(F.when(on, F.col("p")).otherwise(0)).alias(f"_np{n}")]
    per_row = per_gram.groupBy(id_col, *keep).agg(*aggs)
    out = [id_col]
    if loss:
        out += [F.col("_loss").alias("loss"), F.exp("_loss").alias("perplexity")]
    for n in ns:
        ov = F.col(f"_ov{n}").cast("double")
        prec = F.when(F.col(f"_np{n}") > 0, ov / F.col(f"_np{n}")).otherwise(0.0)
        rec = F.when(F.col(f"_nr{n}") > 0, ov / F.col(f"_nr{n}")).otherwise(0.0)
        out.append(F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias(f"rouge{n}_f1"))
    if with_l:
        out.append(F.col("_rl").alias("rougeL_f1"))
    return per_row.select(*out)


def perplexity(df: DataFrame, loss: str = "loss") -> DataFrame:
    """EV1: per-row exp(loss)."""
    return df.withColumn("perplexity", F.exp(F.col(loss)))


def eval_details(preds: DataFrame, metrics: DataFrame, id_col: str = "id",
                 model_type: str = "base_model", model_name: str = "model") -> DataFrame:
    """EV4 + JN8: rows joined on the row id (not on position) with a nested metrics struct."""
    m = metrics.select(id_col, F.struct(*[c for c in metrics.columns if c != id_col]).alias("metrics"))
    return preds.join(m, id_col).select(id_col, F.lit(model_type).alias("model_type"),
                                       F.lit(model_name).alias("model_name"), *[c for c in preds.columns if c != id_col],
                                       "metrics")


SUMMARY_METRICS = ["loss", "perplexity", "rouge1_f1", "rouge2_f1", "rougeL_f1"]


def eval_summary(metrics: DataFrame, total_rows: int | None = None, cols: list[str] | None = None) -> DataFrame:
    """AG12: mean and population std of each metric, the rows that have a
    value for it (``evaluated_<metric>``), the rows with every metric
    (``num_samples_evaluated``) and all rows of the test set
    (``total_samples``, the rows of ``metrics`` unless given)."""
    cols = [c for c in (cols or SUMMARY_METRICS) if c in metrics.columns]
    whole = None
    for c in cols:
        whole = F.col(c).isNotNull() if whole is None else whole & F.col(c).isNotNull()
    aggs = [F.count_if(whole).alias("num_samples_evaluated"),
            (F.count(F.lit(1)) if total_rows is None else F.max(F.lit(total_rows))).cast("bigint").alias("total_samples")]
    for c in cols:
        aggs += [F.avg(c).alias(f"avg_{c}"), F.stddev_pop(c).alias(f"std_{c}"), F.count(c).alias(f"evaluated_{c}")]
    return metrics.agg(*aggs)


def metric_histogram(df: DataFrame, col: str, bins: int = FV.HISTOGRAM_BINS) -> DataFrame:
    """AG13: equal-width bins between min and max (0-based; the maximum falls
    in the last bin).  min/max are one aggregate row read on the driver."""
    mm = df.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    mn, mx = mm["mn"], mm["mx"]
    if mn is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n bigint")
    width = (mx - mn) if mx > mn else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(mn)) * bins / F.lit(width)), F.lit(bins - 1)).cast("int")
    h = df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.select("bin", (F.lit(mn) + F.col("bin") * F.lit(width) / bins).alias("lo"),
                    (F.lit(mn) + (F.col("bin") + 1) * F.lit(width) / bins).alias("hi"), "n")


def improvement(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """AG14 + JN7: melt both one-row summaries into (metric, value), join on
    metric; ROUGE improves upwards, loss/perplexity downwards; x 100."""
    metrics = [f"avg_{m}" for m in SUMMARY_METRICS if f"avg_{m}" in base.columns and f"avg_{m}" in tuned.columns]

    def melt(df, name):
        return df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name))
                                             for m in metrics])).alias("s")).select("s.*")

    j = melt(base, "base_value").join(melt(tuned, "tuned_value"), "metric")
    up = F.col("metric").contains("rouge")
    imp = F.when(up, (F.col("tuned_value") - F.col("base_value")) / F.col("base_value")) \
           .otherwise((F.col("base_value") - F.col("tuned_value")) / F.col("base_value")) * 100
    txt = F.when(imp > 0, F.concat(F.lit("+"), F.format_string("%.2f", imp), F.lit("%"))) \
           .otherwise(F.concat(F.format_string("%.2f", imp), F.lit("%")))
    return j.withColumn("improvement", imp).withColumn("improvement_str", txt)


def judge_summary(scores: DataFrame, criteria: list[str]) -> DataFrame:
    """EV5: mean of each judge criterion (0-10) and of their per-row average."""
    overall = sum((F.col(c) for c in criteria[1:]), F.col(criteria[0])) / len(criteria)
    return scores.agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(c).alias(f"avg_{c}") for c in criteria],
                      F.avg(overall).alias("avg_overall"))
