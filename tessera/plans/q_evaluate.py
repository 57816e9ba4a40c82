"""Evaluation queries over (reference, prediction, loss) rows built from
user/assistant pairs of ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evaluate as ev
from tessera.plans.catalog import register
from tessera.plans.sqlbits import tok
from tessera.sources import tables as T

PRED_SQL = """(SELECT u.conv_id * 1000 + u.turn AS id, u.text AS instruction_input, a.text AS reference,
       u.text AS prediction, 0.5 + (u.conv_id % 17) / 10.0 + (u.turn % 5) / 20.0 AS loss
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant')"""
TUNED_SQL = PRED_SQL.replace("u.text AS prediction", "u.text || ' ' || split_part(a.text, '.', 1) AS prediction") \
                    .replace("0.5 + (u.conv_id", "0.8 * (0.5 + (u.conv_id").replace("/ 20.0 AS loss", "/ 20.0) AS loss")


def _preds(spark, sf):
    return T.predictions(T.table(spark, sf, "conversations"))


def _tuned(spark, sf):
    qa = T.qa_pairs(T.table(spark, sf, "conversations"))
    return qa.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
                     F.col("question").alias("instruction_input"), F.col("answer").alias("reference"),
                     F.concat("question", F.lit(" "), F.substring_index("answer", ".", 1)).alias("prediction"),
                     (F.lit(0.8) * (F.lit(0.5) + (F.col("conv_id") % 17) / 10.0 + (F.col("turn") % 5) / 20.0)).alias("loss"))


def _rouge_sql(source, n, alias):
    def grams(col):
        t = tok(col)
        if n == 1:
            return t
        return f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"
    return f"""
{alias}_r AS (SELECT id, g, count(*) AS r FROM (SELECT id, unnest({grams('reference')}) AS g FROM {source}) GROUP BY 1, 2),
{alias}_p AS (SELECT id, g, count(*) AS p FROM (SELECT id, unnest({grams('prediction')}) AS g FROM {source}) GROUP BY 1, 2),
{alias}_o AS (SELECT id, sum(least(r, p)) AS ov FROM {alias}_r JOIN {alias}_p USING (id, g) GROUP BY 1),
{alias} AS (SELECT s.id,
   CASE WHEN tp.np > 0 THEN coalesce(o.ov, 0)::DOUBLE / tp.np ELSE 0.0 END AS pr,
   CASE WHEN tr.nr > 0 THEN coalesce(o.ov, 0)::DOUBLE / tr.nr ELSE 0.0 END AS rc
 FROM {source} s LEFT JOIN (SELECT id, sum(r) AS nr FROM {alias}_r GROUP BY 1) tr USING (id)
 LEFT JOIN (SELECT id, sum(p) AS np FROM {alias}_p GROUP BY 1) tp USING (id)
 LEFT JOIN {alias}_o o USING (id)),
{alias}_f AS (SELECT id, pr, rc, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM {alias})"""


def _rn(spark, sf, n, df=None):
    r = ev.rouge_n(df if df is not None else _preds(spark, sf), n)
    return r.select("id", *[F.round(c, 6).alias(c) for c in r.columns if c != "id"])


@register("rouge1", sql=f"WITH {_rouge_sql(PRED_SQL, 1, 'r1').strip()} "
                        "SELECT id, round(pr, 6) AS rouge1_p, round(rc, 6) AS rouge1_r, round(f1, 6) AS rouge1_f1 FROM r1_f")
def rouge1(spark, sf):
    """EV2 n=1 (unicode token class)."""
    return _rn(spark, sf, 1)


@register("rouge2", sql=f"WITH {_rouge_sql(PRED_SQL, 2, 'r2').strip()} "
                        "SELECT id, round(pr, 6) AS rouge2_p, round(rc, 6) AS rouge2_r, round(f1, 6) AS rouge2_f1 FROM r2_f")
def rouge2(spark, sf):
    """EV2 n=2."""
    return _rn(spark, sf, 2)


# LCS row by row: row[j] is the LCS of the first i reference and j prediction tokens
LCS_SQL = f"""
lt AS (SELECT id, {tok('reference')} AS r, {tok('prediction')} AS p FROM {PRED_SQL}),
lr AS (SELECT id, 0 AS i, list_transform(p, lambda x: 0) AS row FROM lt
       UNION ALL
       SELECT id, i + 1, list_transform(range(1, len(cand) + 1), lambda j: list_max(cand[1:j])) FROM (
         SELECT lr.id, i, list_transform(range(1, len(p) + 1), lambda k: greatest(row[k],
                CASE WHEN p[k] = r[i + 1] THEN 1 + CASE WHEN k = 1 THEN 0 ELSE row[k - 1] END ELSE 0 END)) AS cand
         FROM lr JOIN lt ON lt.id = lr.id WHERE i < len(r))),
ll AS (SELECT lt.id, coalesce(row[len(p)], 0)::DOUBLE AS l, len(r) AS nr, len(p) AS np FROM lr JOIN lt ON lt.id = lr.id
       WHERE i = len(r)),
lf AS (SELECT id, CASE WHEN l = 0 THEN 0.0 ELSE 2 * (l / np) * (l / nr) / (l / np + l / nr) END AS rougel_f1 FROM ll)
"""


@register("rouge_scores", sql=f"WITH RECURSIVE {_rouge_sql(PRED_SQL, 1, 'r1').strip()}, {_rouge_sql(PRED_SQL, 2, 'r2').strip()}, {LCS_SQL} "
                              'SELECT r1_f.id, round(r1_f.f1, 6) AS rouge1_f1, round(r2_f.f1, 6) AS rouge2_f1, '
                              'round(rougel_f1, 6) AS "rougeL_f1" FROM r1_f JOIN r2_f ON r2_f.id = r1_f.id JOIN lf ON lf.id = r1_f.id')
def rouge_scores(spark, sf):
    """EV2 + EV3: ROUGE-1/2/L F1 per row in one pass (L through the Arrow LCS UDF)."""
    m = ev.row_metrics(_preds(spark, sf), loss=None)
    return m.select("id", *[F.round(c, 6).alias(c) for c in m.columns if c != "id"])


def _metrics(spark, sf, df, with_l=False):
    """EV1 + EV2 (+ EV3) per row in one pass over the prediction table."""
    return ev.row_metrics(df, with_l=with_l)


def _summary_sql(source, a):
    return f"""{_rouge_sql(source, 1, a + '1').strip()},
{_rouge_sql(source, 2, a + '2').strip()},
{a}_m AS (SELECT s.id, s.loss, exp(s.loss) AS perplexity, x.f1 AS rouge1_f1, y.f1 AS rouge2_f1
       FROM {source} s JOIN {a}1_f x USING (id) JOIN {a}2_f y USING (id)),
{a}_s AS (SELECT count(*) AS num_samples_evaluated, avg(loss) AS avg_loss, stddev_pop(loss) AS std_loss,
       avg(perplexity) AS avg_perplexity, stddev_pop(perplexity) AS std_perplexity,
       avg(rouge1_f1) AS avg_rouge1_f1, stddev_pop(rouge1_f1) AS std_rouge1_f1,
       avg(rouge2_f1) AS avg_rouge2_f1, stddev_pop(rouge2_f1) AS std_rouge2_f1 FROM {a}_m)"""


SUMMARY_COLS = ["avg_loss", "std_loss", "avg_perplexity", "std_perplexity", "avg_rouge1_f1", "std_rouge1_f1",
                "avg_rouge2_f1", "std_rouge2_f1"]


EVALUATED = ["loss", "perplexity", "rouge1_f1", "rouge2_f1"]


@register("eval_summary", sql=f"WITH {_summary_sql(PRED_SQL, 'b')} SELECT num_samples_evaluated, "
                              + ", ".join(f"round({c}, 6) AS {c}" for c in SUMMARY_COLS)
                              + ", (SELECT count(*) FROM b_m) AS total_samples, "
                              + ", ".join(f"(SELECT count({c}) FROM b_m) AS evaluated_{c}" for c in EVALUATED) + " FROM b_s")
def eval_summary(spark, sf):
    """AG12 + EV1: means and population stds (perplexity = mean of exp(loss))."""
    s = ev.eval_summary(_metrics(spark, sf, _preds(spark, sf)))
    return s.select("num_samples_evaluated", "total_samples", *[F.round(c, 6).alias(c) for c in SUMMARY_COLS],
                    *[f"evaluated_{c}" for c in EVALUATED])


@register("eval_summary_full", sql=f"WITH RECURSIVE {_summary_sql(PRED_SQL, 'b')}, {LCS_SQL} SELECT num_samples_evaluated, "
          + ", ".join(f"round({c}, 6) AS {c}" for c in SUMMARY_COLS) + ", (SELECT count(*) FROM b_m) AS total_samples, "
          + ", ".join(f"(SELECT count({c}) FROM b_m) AS evaluated_{c}" for c in EVALUATED)
          + ', (SELECT round(avg(rougel_f1), 6) FROM lf) AS "avg_rougeL_f1"'
          + ', (SELECT round(stddev_pop(rougel_f1), 6) FROM lf) AS "std_rougeL_f1"'
          + ', (SELECT count(rougel_f1) FROM lf) AS "evaluated_rougeL_f1" FROM b_s')
def eval_summary_full(spark, sf):
    """AG12 including ROUGE-L."""
    s = ev.eval_summary(_metrics(spark, sf, _preds(spark, sf), with_l=True))
    return s.select(*[F.round(c, 6).alias(c) if c.startswith(("avg_", "std_")) else c for c in s.columns])


@register("eval_details", sql=f"""
WITH {_summary_sql(PRED_SQL, 'b')}
SELECT s.id, 'base_model' AS model_type, 'model' AS model_name, s.instruction_input, s.reference, s.prediction,
       round(m.loss, 6) AS loss, round(m.perplexity, 6) AS perplexity, round(m.rouge1_f1, 6) AS rouge1_f1,
       round(m.rouge2_f1, 6) AS rouge2_f1
FROM {PRED_SQL} s JOIN b_m m USING (id)
""")
def eval_details(spark, sf):
    """EV4 + JN8: detail rows joined on the row id, metrics nested then flattened for comparison."""
    p = _preds(spark, sf)
    d = ev.eval_details(p.drop("loss"), _metrics(spark, sf, p))
    return d.select("id", "model_type", "model_name", "instruction_input", "reference", "prediction",
                    *[F.round(f"metrics.{c}", 6).alias(c) for c in ["loss", "perplexity", "rouge1_f1", "rouge2_f1"]])


@register("loss_histogram", sql=f"""
WITH p AS {PRED_SQL}, mm AS (SELECT min(loss) AS mn, max(loss) AS mx FROM p),
b AS (SELECT least(floor((loss - mn) * 50 / CASE WHEN mx > mn THEN mx - mn ELSE 1.0 END), 49)::INT AS bin,
             mn, CASE WHEN mx > mn THEN mx - mn ELSE 1.0 END AS w FROM p, mm)
SELECT bin, round(min(mn) + bin * min(w) / 50, 6) AS lo, round(min(mn) + (bin + 1) * min(w) / 50, 6) AS hi, count(*) AS n
FROM b GROUP BY bin
""")
def loss_histogram(spark, sf):
    """AG13: 50 equal-width bins of the loss."""
    h = ev.metric_histogram(_preds(spark, sf), "loss", 50)
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@register("improvement", sql=f"""
WITH {_summary_sql(PRED_SQL, 'b')}, {_summary_sql(TUNED_SQL, 't')},
bm AS (SELECT unnest(['avg_loss', 'avg_perplexity', 'avg_rouge1_f1', 'avg_rouge2_f1']) AS metric,
              unnest([avg_loss, avg_perplexity, avg_rouge1_f1, avg_rouge2_f1]) AS base_value FROM b_s),
tm AS (SELECT unnest(['avg_loss', 'avg_perplexity', 'avg_rouge1_f1', 'avg_rouge2_f1']) AS metric,
              unnest([avg_loss, avg_perplexity, avg_rouge1_f1, avg_rouge2_f1]) AS tuned_value FROM t_s),
j AS (SELECT metric, base_value, tuned_value,
             CASE WHEN contains(metric, 'rouge') THEN (tuned_value - base_value) / base_value
                  ELSE (base_value - tuned_value) / base_value END * 100 AS imp FROM bm JOIN tm USING (metric))
SELECT metric, round(base_value, 6) AS base_value, round(tuned_value, 6) AS tuned_value, round(imp, 6) AS improvement,
       CASE WHEN imp > 0 THEN '+' || printf('%.2f', imp) || '%' ELSE printf('%.2f', imp) || '%' END AS improvement_str
FROM j
""")
def improvement(spark, sf):
    """AG14 + JN7: base predictions vs tuned predictions (question + first answer sentence, 0.8 x loss)."""
    base = ev.eval_summary(_metrics(spark, sf, _preds(spark, sf)), cols=["loss", "perplexity", "rouge1_f1", "rouge2_f1"])
    tuned = ev.eval_summary(_metrics(spark, sf, _tuned(spark, sf)), cols=["loss", "perplexity", "rouge1_f1", "rouge2_f1"])
    i = ev.improvement(base, tuned)
    return i.select("metric", F.round("base_value", 6).alias("base_value"), F.round("tuned_value", 6).alias("tuned_value"),
                    F.round("improvement", 6).alias("improvement"), "improvement_str")


JUDGE_CRITERIA = ["accuracy", "safety", "completeness", "clarity", "relevance"]


@register("judge_summary", sql="""
WITH s AS (SELECT l.quality * 10.0 AS accuracy, (1 - l.toxic) * 10.0 AS safety, least(d.n_chars / 1000.0, 10.0) AS completeness,
                  10.0 - least(d.n_chars / 2000.0, 10.0) AS clarity, l.quality * 5.0 + (1 - l.toxic) * 5.0 AS relevance
           FROM labels l JOIN documents d USING (doc_id))
SELECT count(*) AS n_rows, round(avg(accuracy), 6) AS avg_accuracy, round(avg(safety), 6) AS avg_safety,
       round(avg(completeness), 6) AS avg_completeness, round(avg(clarity), 6) AS avg_clarity,
       round(avg(relevance), 6) AS avg_relevance,
       round(avg((accuracy + safety + completeness + clarity + relevance) / 5), 6) AS avg_overall
FROM s
""")
def judge_summary(spark, sf):
    """EV5: five 0-10 judge criteria derived from labels and document length."""
    l = T.table(spark, sf, "labels")
    d = T.table(spark, sf, "documents").select("doc_id", "n_chars")
    s = l.join(d, "doc_id").select(
        (F.col("quality") * 10.0).alias("accuracy"), ((1 - F.col("toxic")) * 10.0).alias("safety"),
        F.least(F.col("n_chars") / 1000.0, F.lit(10.0)).alias("completeness"),
        (F.lit(10.0) - F.least(F.col("n_chars") / 2000.0, F.lit(10.0))).alias("clarity"),
        (F.col("quality") * 5.0 + (1 - F.col("toxic")) * 5.0).alias("relevance"))
    out = ev.judge_summary(s, JUDGE_CRITERIA)
    return out.select("n_rows", *[F.round(c, 6).alias(c) for c in out.columns if c != "n_rows"])


@register("perplexity_rows", sql=f"SELECT id, round(loss, 6) AS loss, round(exp(loss), 6) AS perplexity FROM {PRED_SQL}")
def perplexity_rows(spark, sf):
    """EV1 per row."""
    p = ev.perplexity(_preds(spark, sf))
    return p.select("id", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"))
