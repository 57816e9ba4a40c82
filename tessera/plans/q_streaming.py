"""Streaming queries: each runs a Structured Streaming job over a driver
table (file stream, ``availableNow``) into the shared checkpoint folder and
returns the sink table, so the result can be checked like any batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.plans.catalog import ORACLE, register
from tessera.plans.q_chat import SESS_SQL
from tessera.plans.q_chunk import CH_SQL, KEPT_B, QA_SCHEMA, _defective_lines
from tessera.plans.sqlbits import hash_vectors
from tessera.sources import tables as T
from tessera.streaming import jobs

TS_FMT_SPARK = "yyyy-MM-dd HH:mm:ss"
TS_FMT_SQL = "%Y-%m-%d %H:%M:%S"
ALERT_THRESHOLD = 5.0
HISTORY_EPOCH = 1_704_067_200  # event time of turn t: 2024-01-01 + t seconds


def _events_stream(spark, sf):
    s = jobs.table_stream(spark, sf, "events", "ts")
    return s.select("event_id", F.col("event_type").alias("bot_id"), F.col("user_id").cast("string").alias("user_id"),
                    F.col("event_type").alias("series"), "value",
                    # watermarks need TIMESTAMP; the session time zone is UTC, so wall-clock values are kept
                    F.col("ts").cast("timestamp").alias("ts"), F.col("ts").alias("wall_ts"),
                    F.col("props").alias("content"))


@register("stream_sessions", sql=SESS_SQL + """
SELECT event_id, bot_id, user_id, session_start,
       substr(sha256(bot_id || '.' || user_id || '.' || session_start), 1, 33) AS conversation_id FROM o
""")
def stream_sessions(spark, sf):
    """ST1: every access gets its 360 s sliding-TTL session id as it streams in."""
    s = jobs.stream_session_ids(_events_stream(spark, sf), ["bot_id", "user_id"], wall_clock="wall_ts")
    return spark.read.parquet(jobs.drain(s, "sessions", "append"))


@register("stream_history", sql="""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT c.conv_id, c.turn, count(p.turn)::INT AS n_prior,
       coalesce(string_agg(p.role, '|' ORDER BY p.turn), '') AS prior_roles,
       coalesce(string_agg(p.role || ': ' || p.text, chr(10) ORDER BY p.turn), '') AS prior_text
FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn < c.turn AND p.turn >= c.turn - 6
GROUP BY c.conv_id, c.turn
""")
def stream_history(spark, sf):
    """ST2: stateful history (last 6 messages with their texts) per conversation; event time = turn seconds."""
    s = jobs.table_stream(spark, sf, "conversations", "turn")
    s = s.withColumn("ts", F.timestamp_seconds(F.col("turn") + HISTORY_EPOCH))
    out = spark.read.parquet(jobs.drain(jobs.stream_history(s, 6), "history", "append"))
    text = F.array_join(F.transform("prior", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return out.select("conv_id", "turn", "n_prior", "prior_roles", text.alias("prior_text"))


@register("stream_ingest_documents", sql=CH_SQL + f""",
chunk_texts AS (SELECT doc_id, chunk_idx, array_to_string(toks[chunk_idx * 462 + 1 : chunk_idx * 462 + 512], ' ') AS content FROM c),
v AS {hash_vectors('(SELECT doc_id * 1000 + chunk_idx AS pid, content FROM chunk_texts)', 'pid', 'content')},
e AS (SELECT id, count(*) FILTER (WHERE v <> 0) AS n_cells, round(sum(v * (b + 1)), 5) + 0.0 AS weighted FROM v GROUP BY 1)
SELECT doc_id * 1000 + chunk_idx AS point_id, doc_id, chunk_idx::INT AS chunk_idx, least(512, n - chunk_idx * 462) AS n_tokens,
       coalesce(e.n_cells, 0) AS n_cells, coalesce(e.weighted, 0.0) AS weighted
FROM c LEFT JOIN e ON e.id = doc_id * 1000 + chunk_idx
""")
def stream_ingest_documents(spark, sf):
    """ST3: streamed documents chunked, embedded and upserted; a digest of the vectors is checked."""
    s = jobs.table_stream(spark, sf, "documents", "doc_id")
    sdf, foreach = jobs.stream_ingest_documents(s)
    r = jobs.live_points(spark, jobs.drain(sdf, "ingest", "append", foreach))
    cells = F.transform("embedding", lambda x, i: x * (i + 1))
    return r.select("point_id", "doc_id", "chunk_idx", "n_tokens",
                    F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("n_cells"),
                    (F.round(F.aggregate(cells, F.lit(0.0), lambda a, x: a + x), 5) + F.lit(0.0)).alias("weighted"))


@register("stream_ingest_store", sql=ORACLE["stream_ingest_documents"])
def stream_ingest_store(spark, sf):
    """ST3 into a bucketed store; the result is that of ``stream_ingest_documents``."""
    sdf, foreach = jobs.stream_ingest_store(jobs.table_stream(spark, sf, "documents", "doc_id"))
    r = jobs.ingested(spark, jobs.drain(sdf, "ingest-store", "append", foreach)).points()
    cells = F.transform("embedding", lambda x, i: x * (i + 1))
    return r.select("point_id", "doc_id", "chunk_idx", "n_tokens",
                    F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("n_cells"),
                    (F.round(F.aggregate(cells, F.lit(0.0), lambda a, x: a + x), 5) + F.lit(0.0)).alias("weighted"))


@register("stream_dedup_content", sql="SELECT DISTINCT props AS content FROM events")
def stream_dedup_content(spark, sf):
    """ST4: each content once within 400 days of event time (the events span a month)."""
    d = jobs.stream_dedup_content(_events_stream(spark, sf).select("content", "ts"), "content", within="400 days")
    return spark.read.parquet(jobs.drain(d, "dedup", "append")).select("content")


def _alert_sql(condition, minutes):
    return f"""
WITH e AS (SELECT event_type AS series, {condition} AS ok, ts FROM events),
w AS (SELECT series, ok, date_trunc('minute', ts) AS m, date_trunc('minute', ts) - to_minutes(k) AS ws
      FROM e, (SELECT unnest(range(0, {minutes})) AS k))
SELECT series, strftime(ws, '{TS_FMT_SQL}') AS window_start, count(*) AS n_samples, count(DISTINCT m) AS n_minutes,
       count(DISTINCT m) = {minutes} AND bool_and(ok) AS firing
FROM w GROUP BY series, ws
"""


def _alert(spark, sf, condition, minutes):
    a = jobs.sustained_alert(_events_stream(spark, sf), "series", condition, minutes)
    r = jobs.read_latest(spark, jobs.drain(a, "alerts", "update", jobs.write_batch), ["series", "window_start"])
    return r.select("series", F.date_format("window_start", TS_FMT_SPARK).alias("window_start"), "n_samples",
                    F.col("n_minutes").cast("bigint").alias("n_minutes"), "firing")


ALERT_SQL = _alert_sql(f"value > {ALERT_THRESHOLD}", 5)


@register("sustained_alert", sql=ALERT_SQL)
def sustained_alert(spark, sf):
    """ST5: value > 5 in every sample of five minutes that all have samples."""
    return _alert(spark, sf, F.col("value") > ALERT_THRESHOLD, 5)


@register("sustained_alert_2m", sql=_alert_sql("event_type <> 'error' AND value < 100", 2))
def sustained_alert_2m(spark, sf):
    """ST5: a condition over several columns held for two minutes."""
    return _alert(spark, sf, (F.col("series") != "error") & (F.col("value") < 100), 2)


@register("sustained_alert_batch", sql=ALERT_SQL)
def sustained_alert_batch(spark, sf):
    """ST5 batch twin over the events table."""
    a = metrics.sustained_windows(T.metric_samples(T.table(spark, sf, "events")), "series",
                                  F.col("value") > ALERT_THRESHOLD, 5)
    return a.select("series", F.date_format("window_start", TS_FMT_SPARK).alias("window_start"), "n_samples",
                    F.col("n_minutes").cast("bigint").alias("n_minutes"), "firing")


@register("metric_busy", sql="""
WITH e AS (SELECT event_id, value, ts, lag(value) OVER (ORDER BY ts, event_id) AS pv, lag(ts) OVER (ORDER BY ts, event_id) AS pt
           FROM events WHERE event_type = 'view'),
r AS (SELECT ts, CASE WHEN pv IS NOT NULL AND epoch_us(ts) > epoch_us(pt)
      THEN (CASE WHEN value < pv THEN value ELSE value - pv END) / ((epoch_us(ts) - epoch_us(pt)) / 1e6) END AS irate FROM e)
SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '""" + TS_FMT_SQL + """') AS window_start, count(irate) AS n_rates,
       round(100 - avg(irate) * 100, 6) AS busy_pct FROM r GROUP BY 1
""")
def metric_busy(spark, sf):
    """ST7, CPU form: 100 - average instant rate of the idle counter ('view')."""
    b = metrics.busy_percent(T.metric_samples(T.table(spark, sf, "events")), "view")
    return b.select(F.date_format("window_start", TS_FMT_SPARK).alias("window_start"), "n_rates",
                    F.round("busy_pct", 6).alias("busy_pct"))


@register("metric_rate", sql=f"""
WITH e AS (SELECT event_id, event_type AS series, value, ts,
                  lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pv,
                  lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pt FROM events),
i AS (SELECT *, CASE WHEN pv IS NULL THEN NULL WHEN value < pv THEN value ELSE value - pv END AS inc,
             (epoch_us(ts) - epoch_us(pt)) / 1e6 AS dt FROM e),
r AS (SELECT *, CASE WHEN dt > 0 THEN inc / dt END AS irate FROM i),
w AS (SELECT r.*, date_trunc('minute', ts) - to_minutes(k) AS ws FROM r, (SELECT unnest(range(0, 5)) AS k))
SELECT series, strftime(ws, '{TS_FMT_SQL}') AS window_start, count(*) AS n_samples, round(sum(inc) / 300, 6) AS rate,
       round(arg_max(irate, (ts, event_id)), 6) AS irate
FROM w GROUP BY series, ws
""")
def metric_rate(spark, sf):
    """ST6: reset-aware rate over 5 minutes and irate of the last two samples, every minute."""
    r = metrics.metric_rate(T.metric_samples(T.table(spark, sf, "events")))
    return r.select("series", F.date_format("window_start", TS_FMT_SPARK).alias("window_start"), "n_samples",
                    F.round("rate", 6).alias("rate"), F.round("irate", 6).alias("irate"))


@register("stream_metric_rate", sql=ORACLE["metric_rate"])
def stream_metric_rate(spark, sf):
    """ST6 streamed: the result is that of ``metric_rate``."""
    r = jobs.stream_metric_rate(_events_stream(spark, sf))
    return r.select("series", F.date_format("window_start", TS_FMT_SPARK).alias("window_start"), "n_samples",
                    F.round("rate", 6).alias("rate"), F.round("irate", 6).alias("irate"))


@register("metric_ratio", sql=f"""
WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS ws,
                  avg(CASE WHEN event_type = 'view' THEN value END) AS num,
                  avg(CASE WHEN event_type = 'click' THEN value END) AS den FROM events GROUP BY 1)
SELECT strftime(ws, '{TS_FMT_SQL}') AS window_start, round(num, 6) AS num, round(den, 6) AS den,
       CASE WHEN den <> 0 THEN round((1 - num / den) * 100, 6) END AS ratio_pct FROM w
""")
def metric_ratio(spark, sf):
    """ST7: (1 - view / click) * 100 per 5-minute window, streamed."""
    m = jobs.metric_ratio(_events_stream(spark, sf), "series", "value", "view", "click")
    out = jobs.drain(m, "ratio", "update", jobs.write_batch)
    r = jobs.read_latest(spark, out, ["window_start"])
    return r.select(F.date_format("window_start", TS_FMT_SPARK).alias("window_start"),
                    F.round("num", 6).alias("num"), F.round("den", 6).alias("den"),
                    F.round("ratio_pct", 6).alias("ratio_pct"))


@register("stream_import_progress", sql=f"""
SELECT count(*) FILTER (WHERE (conv_id + turn) % 7 <> 0)::HUGEINT AS total_processed,
       count(*) FILTER (WHERE (conv_id + turn) % 7 = 0)::HUGEINT AS total_errors FROM {KEPT_B}
""".replace("::HUGEINT", "::BIGINT"))
def stream_import_progress(spark, sf):
    """ST8: QA lines (some cut short) streamed file by file; the totals do not
    depend on how the lines fell into batches."""
    from pyspark.sql import types as Ty

    from tessera.operators import prep
    from tessera.sources import jsonl
    kept = prep.quality_filter(T.qa_pairs(T.table(spark, sf, "conversations")), "B")
    src = jsonl.scratch_path(spark, "import-src")
    _defective_lines(kept, ["question", "answer"]).repartition(4).write.mode("overwrite").text(src)
    schema = spark.createDataFrame([], QA_SCHEMA).schema
    st = Ty.StructType(schema.fields + [Ty.StructField(jsonl.BAD, Ty.StringType())])
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(src)
    parsed = lines.select(F.from_json("value", st, {"mode": "PERMISSIVE",
                                                    "columnNameOfCorruptRecord": jsonl.BAD}).alias("r")).select("r.*")
    out = jobs.drain(parsed, "import", "append", jobs.import_progress_writer(["question", "answer"]))
    return jobs.import_totals(spark.read.parquet(f"{out}/progress"))


@register("stream_closed_sessions", sql=f"""
WITH a AS (SELECT event_id, event_type AS bot_id, user_id::VARCHAR AS user_id, ts FROM events),
l AS (SELECT *, lag(ts) OVER (PARTITION BY bot_id, user_id ORDER BY ts, event_id) AS prev FROM a),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= 360000000 THEN 1 ELSE 0 END)
             OVER (PARTITION BY bot_id, user_id ORDER BY ts, event_id) AS g FROM l),
o AS (SELECT bot_id, user_id, min(ts) AS b, max(ts) + INTERVAL 360 SECOND AS e, count(*) AS n_events FROM s GROUP BY bot_id, user_id, g)
SELECT bot_id, user_id, strftime(b, '{TS_FMT_SQL}') AS session_start, strftime(e, '{TS_FMT_SQL}') AS session_end, n_events,
       e <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) AS closed FROM o
""")
def stream_closed_sessions(spark, sf):
    """ST1 (session-window form): sessions emitted once the watermark has
    passed their end, and those still open when the input ends."""
    keys = ["bot_id", "user_id"]
    closed = spark.read.parquet(jobs.drain(jobs.stream_sessions(_events_stream(spark, sf), keys), "closed-sessions", "append"))
    events = T.timed_accesses(T.table(spark, sf, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    r = jobs.all_sessions(closed, events, keys)
    return r.select(*keys, F.date_format("session_start", TS_FMT_SPARK).alias("session_start"),
                    F.date_format("session_end", TS_FMT_SPARK).alias("session_end"), "n_events", "closed")
