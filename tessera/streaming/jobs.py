"""Structured Streaming twins (ST1-ST8).

Every job is a streaming DataFrame plan plus a sink.  Sinks write into the
shared checkpoint folder with a checkpoint location next to them, so a
restarted query resumes exactly; ``foreachBatch`` sinks overwrite a folder
named by the batch id, so a replayed batch replaces its own output
(idempotent).  Aggregations run in *update* mode and the readers keep the
last version of every key, which also covers keys whose window the
watermark has not closed yet when an ``availableNow`` run ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera import fixed_values as FV
from tessera.functions.time import epoch_micros, from_epoch_micros
from tessera.sources.jsonl import scratch_path

WATERMARK = "10 minutes"


def table_stream(spark: SparkSession, sf_dir: str, name: str, order: str, slices: int = 3,
                 files_per_slice: int | None = None) -> DataFrame:
    """A driver table replayed as a file stream of ``slices`` micro-batches in
    the order of ``order`` (a numeric or timestamp column; NULLs come first).

    The table is written once as slices of equal ranges, one after the other,
    and read ``files_per_slice`` files at a time, so state and watermark pass
    from batch to batch as in a live stream.  By default a slice has its share
    of as many files as the table has read partitions, so that no task writes
    or reads more of it than of the table itself.
    """
    return replay(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"), order, slices, files_per_slice)


def replay(df: DataFrame, order: str, slices: int = 3, files_per_slice: int | None = None) -> DataFrame:
    """``df`` as a file stream of ``slices`` micro-batches (see ``table_stream``)."""
    spark, kind = df.sparkSession, dict(df.dtypes)[order]
    files = files_per_slice or max(1, -(-df.rdd.getNumPartitions() // slices))
    key = epoch_micros(F.col(order), kind) if kind.startswith("timestamp") else F.col(order).cast("long")
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // slices))
    part = F.coalesce(F.floor((key - F.lit(lo)) / F.lit(width)), F.lit(0)) if lo is not None else F.lit(0)
    path = scratch_path(spark, "replay")
    for i in range(slices):
        # one job per slice: the file source takes files by their time
        df.filter(part == i).repartition(files).write.mode("append").parquet(path)
        # a slice of few rows may have left files out: a micro-batch is always one slice
        for _ in range(files * (i + 1) - len(spark.read.schema(df.schema).parquet(path).inputFiles())):
            df.limit(0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(sdf: DataFrame, name: str, output_mode: str = "append",
          foreach: Callable[[DataFrame, int, str], None] | None = None) -> str:
    """Run ``sdf`` until the available input is consumed; return the sink folder."""
    spark = sdf.sparkSession
    out, ckpt = scratch_path(spark, name), scratch_path(spark, name + "-checkpoint")
    w = sdf.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if foreach is not None:
        q = w.foreachBatch(lambda df, bid: foreach(df, bid, out)).start()
    else:
        q = w.format("parquet").option("path", out).start()
    q.awaitTermination()
    return out


def write_batch(df: DataFrame, batch_id: int, out: str) -> None:
    df.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite") \
      .parquet(f"{out}/batch={batch_id}")


def read_latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Last emitted version of every key across the update-mode batches."""
    df = spark.read.parquet(out)
    cols = [c for c in df.columns if c not in keys and c not in ("_batch", "batch")]
    last = df.groupBy(*keys).agg(F.max(F.struct("_batch", *cols)).alias("_l"))
    return last.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in cols])


# --------------------------------------------------------------------------- ST1
def stream_sessions(sdf: DataFrame, keys: list[str], ts: str = "ts", ttl: int = FV.SESSION_TTL_SECONDS,
                    watermark: str = WATERMARK) -> DataFrame:
    """ST1 (closed sessions): session windows with a ``ttl`` gap per key, in
    append mode - a session is emitted once the watermark passes its end."""
    s = sdf.withWatermark(ts, watermark).groupBy(*keys, F.session_window(ts, f"{ttl} seconds").alias("w")) \
           .agg(F.count(F.lit(1)).alias("n_events"))
    return s.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def all_sessions(closed: DataFrame, events: DataFrame, keys: list[str], ts: str = "ts",
                 ttl: int = FV.SESSION_TTL_SECONDS, watermark: str = WATERMARK) -> DataFrame:
    """The emitted sessions (``closed`` true) and those still open when the
    input has ended (``closed`` false): sessions that end after the final
    watermark, built from the events of the keys that have one."""
    last = events.agg(F.max(ts).alias("last")).select((F.col("last") - F.expr(f"INTERVAL {watermark}")).alias("mark"))
    tail = events.join(F.broadcast(last)).filter(F.col(ts) + F.expr(f"INTERVAL {ttl} seconds") > F.col("mark"))
    keyed = events.withColumn("_key", F.struct(*keys)).join(
        tail.select(F.struct(*keys).alias("_key")).distinct(), "_key", "left_semi")
    rest = keyed.groupBy(*keys, F.session_window(ts, f"{ttl} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    rest = rest.join(F.broadcast(last)).filter(F.col("w.end") > F.col("mark")).select(
        *keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")
    return closed.withColumn("closed", F.lit(True)).unionByName(rest.withColumn("closed", F.lit(False)))


SESSION_SCHEMA = "event_id long, bot_id string, user_id string, t_us long, start_us long"
SESSION_STATE = "bots array<string>, users array<string>, last_us array<long>, start_us array<long>, until_ms array<long>"
# groups of keys that share one state row: a call handles many keys at once
SESSION_GROUPS = 128


def _session_fn(ttl_us: int):
    columns = ["bot", "user", "last_us", "start_us", "until_ms"]

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = pd.DataFrame({c: pd.Series(v, dtype=t) for c, v, t in zip(
            columns, state.get if state.exists else ([],) * 5, [object, object, "int64", "int64", "int64"])})
        new = pd.DataFrame() if state.hasTimedOut else pd.concat([pd.DataFrame(), *pdfs], ignore_index=True)
        if len(new):   # this group's accesses in one micro-batch
            both = pd.MultiIndex.from_arrays([pd.concat([held["bot"], new["bot_id"]]), pd.concat([held["user"], new["user_id"]])])
            code = pd.factorize(both)[0]
            new = new.assign(code=code[len(held):]).sort_values(["code", "t_us", "event_id"], ignore_index=True)
            at = new["code"].to_numpy()
            none = new["t_us"].isna().to_numpy()
            t = new["t_us"].fillna(0).to_numpy(dtype="int64")
            # what the state says of a row's key
            slot = np.full(code.max() + 1, -1)
            slot[code[:len(held)]] = np.arange(len(held))
            known = slot[at] >= 0
            last, start = (np.append(held[c].to_numpy(dtype="int64"), 0)[slot[at]] for c in ("last_us", "start_us"))
            first = np.append(True, at[1:] != at[:-1])
            # an access without a time, last of its key, is in the session of the one before
            timed = np.maximum.accumulate(np.where(~none | first, np.arange(len(t)), 0))
            t = np.where(none[timed], np.where(known, last, 0), t[timed])
            lost = none[timed] & ~known
            # accesses come in the order of time, so the last before a row is that of the row before or of the state
            before = np.where(first, last, np.maximum(np.append(0, t[:-1]), np.where(known, last, np.append(0, t[:-1]))))
            opens = (first & ~known) | (t - before >= ttl_us)    # the key expired: a new session
            starts = np.where(opens, t, start)
            origin = np.maximum.accumulate(np.where(opens | first, np.arange(len(t)), 0))
            starts = starts[origin]
            end = np.append(first[1:], True)
            # the watermark runs on the event-time column, so the timeout does too:
            # the gaps may be measured on a wall clock of another zone
            latest = new.groupby("code", sort=True)["event_ms"].max().fillna(0).to_numpy(dtype="int64")
            until = np.maximum(latest + ttl_us // 1000, mark + 1)
            was = slot[at[end]]
            until = np.where(was >= 0, np.maximum(until, np.append(held["until_ms"].to_numpy(dtype="int64"), 0)[was]), until)
            state_rows = pd.DataFrame({
                "bot": new["bot_id"].to_numpy(dtype=object)[end], "user": new["user_id"].to_numpy(dtype=object)[end],
                "last_us": np.where(known, np.maximum(t, last), t)[end], "start_us": starts[end], "until_ms": until})[~lost[end]]
            held = held.drop(index=was[was >= 0])
        held = held[held["until_ms"] >= mark]    # keys without an access whose time is up
        if len(new):
            held = pd.concat([held, state_rows], ignore_index=True)
        if len(held):
            text = lambda c: [None if x is None or x != x else x for x in held[c]]
            state.update((text("bot"), text("user"), *(held[c].astype("int64").tolist() for c in columns[2:])))
            state.setTimeoutTimestamp(max(int(held["until_ms"].min()), mark, 1))
        else:
            state.remove()
        if len(new):
            yield pd.DataFrame({"event_id": new["event_id"].to_numpy(), "bot_id": new["bot_id"], "user_id": new["user_id"],
                                "t_us": pd.arrays.IntegerArray(t, none), "start_us": pd.arrays.IntegerArray(starts, lost)})
    return fn


def stream_session_ids(sdf: DataFrame, keys: list[str], ts: str = "ts", ttl: int = FV.SESSION_TTL_SECONDS,
                       watermark: str = WATERMARK, wall_clock: str | None = None, groups: int = SESSION_GROUPS) -> DataFrame:
    """ST1 (per access): every access gets its (bot, user) session at once,
    like a key refreshed on each access that expires ``ttl`` seconds after
    the last one (a gap of exactly ``ttl`` starts a new session).  State per
    key is a few numbers and is dropped once the key has expired in event time.
    The keys are hashed into ``groups``, and one call does all keys of a group
    in a micro-batch: calls do not grow with the number of keys.
    ``wall_clock`` names a ``timestamp_ntz`` column whose wall-clock time
    measures the gaps (the watermark itself needs the TIMESTAMP ``ts``)."""
    t_us = epoch_micros(F.col(wall_clock), "timestamp_ntz") if wall_clock else F.unix_micros(ts)
    group = F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group")
    bot, user = keys
    s = sdf.withWatermark(ts, watermark).select("event_id", F.col(bot).alias("bot_id"), F.col(user).alias("user_id"), group, ts,
                                                t_us.alias("t_us"), F.unix_millis(ts).alias("event_ms"))
    out = s.groupBy("_group").applyInPandasWithState(
        _session_fn(ttl * 1_000_000), SESSION_SCHEMA, SESSION_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    start = from_epoch_micros(F.col("start_us"), "timestamp_ntz" if wall_clock else "timestamp")
    start_txt = F.date_format(start, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return out.select("event_id", *keys, start_txt.alias("session_start"),
                      F.substring(F.sha2(F.concat_ws(".", *keys, start_txt), 256), 1, 33).alias("conversation_id"))


# --------------------------------------------------------------------------- ST2
HISTORY_SCHEMA = ("conv_id long, turn long, n_prior int, prior_roles string, "
                  "prior array<struct<turn:long,role:string,content:string>>")
HISTORY_STATE = "roles array<string>, turns array<long>, texts array<string>, event_ms long"


def _history_fn(max_messages: int, retention_ms: int | None):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        roles, turns, texts, max_ms = state.get if state.exists else ([], [], [], None)
        roles, turns, texts = list(roles), list(turns), list(texts)
        rows = []
        chunks = list(pdfs)  # one conversation's new rows: bounded by that micro-batch
        if chunks:
            for r in pd.concat(chunks).sort_values("turn").itertuples(index=False):
                if retention_ms is not None and max_ms is not None and r.event_ms - max_ms > retention_ms:
                    roles, turns, texts = [], [], []    # idle for too long, whenever the state is cleaned up
                prior = [{"turn": t, "role": a, "content": x} for t, a, x in zip(turns, roles, texts)]
                rows.append((key[0], int(r.turn), len(turns), "|".join(x or "" for x in roles), prior))
                roles.append(r.role)
                turns.append(int(r.turn))
                texts.append(r.text)
                roles, turns, texts = roles[-max_messages:], turns[-max_messages:], texts[-max_messages:]
                max_ms = int(r.event_ms) if max_ms is None else max(max_ms, int(r.event_ms))
        state.update((roles, turns, texts, max_ms))
        if max_ms is not None and retention_ms is not None:
            state.setTimeoutTimestamp(max(max_ms + retention_ms, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "n_prior", "prior_roles", "prior"])
    return fn


def stream_history(sdf: DataFrame, max_messages: int = 6, ts: str = "ts", watermark: str = WATERMARK,
                   retention_ms: int | None = None) -> DataFrame:
    """ST2: per conversation, every new message is emitted with the (at most
    ``max_messages``) messages before it: their turns, roles and texts.  State
    holds only those messages.  By default a conversation's history is never
    forgotten, like the batch twin; ``retention_ms`` of event time without a
    new message drops it, which bounds the number of conversations held."""
    rows = sdf.withColumn("event_ms", F.unix_millis(ts))
    how = GroupStateTimeout.NoTimeout if retention_ms is None else GroupStateTimeout.EventTimeTimeout
    return rows.withWatermark(ts, watermark).groupBy("conv_id").applyInPandasWithState(
        _history_fn(max_messages, retention_ms), HISTORY_SCHEMA, HISTORY_STATE, "append", how)


# --------------------------------------------------------------------------- ST3
def stream_ingest_documents(sdf: DataFrame, size: int = FV.CHUNK_TOKENS, overlap: int = FV.CHUNK_OVERLAP,
                            encoder=None) -> tuple[DataFrame, Callable]:
    """ST3: new document -> token chunks -> embedding -> upsert.  The returned
    ``foreach`` writes each batch's points under ``points`` and its document
    ids under ``docs``; ``live_points`` merges them on read, so a document that
    comes again replaces all its earlier chunks, also when it has fewer."""
    from tessera.operators import chunk, embed

    def foreach(df: DataFrame, batch_id: int, out: str) -> None:
        # a document twice in one batch: the larger text stands, on every replay
        docs = df.groupBy("doc_id").agg(F.max("text").alias("text"))
        points = embed.embed(chunk.point_ids(chunk.chunk_tokens(docs, "text", size, overlap)), "chunk_key", "content", encoder)
        write_batch(points.select("point_id", "doc_id", "chunk_idx", "n_tokens", "content", "embedding"),
                    batch_id, f"{out}/points")
        write_batch(docs.select("doc_id"), batch_id, f"{out}/docs")

    return sdf.select("doc_id", "text"), foreach


def live_points(spark: SparkSession, out: str) -> DataFrame:
    """The points of every document's last ingestion."""
    last = spark.read.parquet(f"{out}/docs").groupBy("doc_id").agg(F.max("_batch").alias("_batch"))
    return spark.read.parquet(f"{out}/points").join(last, ["doc_id", "_batch"]).drop("_batch", "batch")


POINTS = "point_id long, doc_id long, chunk_idx int, n_tokens long, content string, embedding array<double>"


def stream_ingest_store(sdf: DataFrame, size: int = FV.CHUNK_TOKENS, overlap: int = FV.CHUNK_OVERLAP, encoder=None,
                        buckets: int = 16) -> tuple[DataFrame, Callable]:
    """ST3 into a bucketed store under ``out``: a batch rewrites the buckets of
    its documents, whose earlier chunks go; a batch that is replayed changes
    nothing.  ``ingested(...).points()`` reads one version."""
    from tessera.operators import chunk, embed

    def foreach(df: DataFrame, batch_id: int, out: str) -> None:
        docs = df.groupBy("doc_id").agg(F.max("text").alias("text"))
        points = embed.embed(chunk.point_ids(chunk.chunk_tokens(docs, "text", size, overlap)), "chunk_key", "content", encoder)
        ingested(df.sparkSession, out, buckets).replace(points, docs, "doc_id", f"batch-{batch_id}")

    return sdf.select("doc_id", "text"), foreach


def ingested(spark: SparkSession, out: str, buckets: int = 16):
    """The store that ``stream_ingest_store`` writes under ``out``."""
    from tessera.operators.point_store import PointStore
    return PointStore(spark, f"{out}/store", POINTS, "doc_id", buckets)


# --------------------------------------------------------------------------- ST4
def stream_dedup_content(sdf: DataFrame, content: str = "content", ts: str = "ts",
                         within: str = "30 days") -> DataFrame:
    """ST4: a content is emitted once; repetitions within ``within`` of event
    time are dropped, and state is held no longer than that.  The state holds
    a digest per content, whatever its length; null contents are one."""
    digest = sdf.withColumn("_digest", F.sha2(F.col(content).cast("string"), 256))
    return digest.withWatermark(ts, within).dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


# --------------------------------------------------------------------------- ST5
def sustained_alert(sdf: DataFrame, series: str, condition: F.Column, for_minutes: int = 5, ts: str = "ts",
                    watermark: str = WATERMARK) -> DataFrame:
    """ST5: evaluated every minute, the alert fires if each of the last
    ``for_minutes`` minutes has samples and the condition held for all of
    them.  ``condition`` is a boolean column (NULL counts as false)."""
    from tessera.operators.metrics import sustained_windows
    return sustained_windows(sdf.withWatermark(ts, watermark), series, condition, for_minutes, ts)


# --------------------------------------------------------------------------- ST6
INCREASE_SCHEMA = "series string, event_id long, t_us long, value double, increase double, irate double"
INCREASE_STATE = "t_us array<long>, ids array<long>, vals array<double>"
# rows of one frame that a series gives back
INCREASE_ROWS = 20_000


def _increase_fn(delay_ms: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark_us = state.getCurrentWatermarkMs() * 1000

        def arrays(t, ids, vals) -> tuple:
            ids, vals = pd.Series(ids, dtype=None if len(ids) else "int64"), pd.Series(vals, dtype="float64")
            none = ids.isna().to_numpy()
            return (np.asarray(t, dtype="int64"), none, ids.where(~none, 0).to_numpy(dtype="int64"), vals.to_numpy())

        # numbers only: a frame of the stream is dropped once its columns are taken
        parts = [arrays(*(list(v) for v in state.get))] if state.exists else [arrays([], [], [])]
        n_old = len(parts[0][0])
        for p in pdfs:
            p = p[p["t_us"] >= mark_us]
            parts.append(arrays(p["t_us"], p["event_id"], p["value"]))
        t, none, ids, vals = (np.concatenate(c) for c in zip(*parts))
        del parts
        order = np.lexsort((ids, none, t))
        new = order >= n_old
        t, none, ids, vals = t[order], none[order], ids[order], vals[order]
        # a sample that comes between two others changes the one after it
        touched = new.copy()
        touched[1:] |= new[:-1]
        # no later sample counts before this series' own watermark; the last before it stays
        own_us = (int(t[-1]) // 1000 - delay_ms) * 1000 if len(t) else mark_us
        first = max(int(np.searchsorted(t, max(mark_us, own_us))) - 1, 0)
        state.update((t[first:].tolist(), [None if z else i for z, i in zip(none[first:].tolist(), ids[first:].tolist())],
                      [None if v != v else v for v in vals[first:].tolist()]))
        touched = np.flatnonzero(touched)
        for i in range(0, len(touched), INCREASE_ROWS):
            at = touched[i:i + INCREASE_ROWS]
            before = np.where(at > 0, vals[at - 1], np.nan)
            with np.errstate(all="ignore"):
                gain = np.where(vals[at] < before, vals[at], vals[at] - before)
                seconds = np.where(at > 0, (t[at] - t[at - 1]) / 1e6, 0.0)
                rate = np.where(seconds > 0, gain / seconds, np.nan)
            yield pd.DataFrame({"series": key[0], "event_id": pd.arrays.IntegerArray(ids[at], none[at]), "t_us": t[at], "value": vals[at],
                                "increase": gain, "irate": rate})
    return fn


def stream_counter_increase(sdf: DataFrame, series: str = "series", ts: str = "ts", value: str = "value",
                            tie: str = "event_id", watermark: str = WATERMARK) -> DataFrame:
    """ST6: per sample its increase and instant rate (``counter_increase``), at
    once; a late sample inside the watermark is put in its place and the sample
    after it emitted again, so the last version of every (series, sample)
    equals the batch result (``read_latest``).  Samples before the watermark
    and samples without a time are dropped.  A call holds a series' samples of
    one micro-batch as three numbers each.  State per series: the samples since
    its own newest one less (somewhat more than) the watermark's delay, and the
    one before; it is never dropped, as the next sample of an idle series needs
    it."""
    rows = sdf.filter(F.col(ts).isNotNull()).select(
        F.col(series).cast("string").alias("series"), F.col(tie).alias("event_id"), F.col(value).cast("double").alias("value"),
        F.col(ts).alias("ts"), F.unix_micros(ts).alias("t_us"))
    start = F.timestamp_seconds(F.lit(0))
    delay = sdf.sparkSession.range(1).select(F.unix_millis(start + F.expr(f"INTERVAL {watermark}")) - F.unix_millis(start)).first()[0]
    # more than the delay: a month of an interval counts as 31 days there
    out = rows.withWatermark("ts", watermark).groupBy("series").applyInPandasWithState(
        _increase_fn(delay + delay // 8), INCREASE_SCHEMA, INCREASE_STATE, "update", GroupStateTimeout.NoTimeout)
    null = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("series", "event_id", from_epoch_micros(F.col("t_us"), "timestamp").alias("ts"),
                      null("value"), null("increase"), null("irate"))


def stream_metric_rate(sdf: DataFrame, name: str = "rate", watermark: str = WATERMARK, **windows) -> DataFrame:
    """ST6: ``rate`` and ``irate`` at every step of a streamed counter (columns
    series, ts, value, event_id), from the last version of every increase."""
    from tessera.operators.metrics import rate_windows
    out = drain(stream_counter_increase(sdf, watermark=watermark), name, "update", write_batch)
    return rate_windows(read_latest(sdf.sparkSession, out, ["series", "event_id"]), **windows)


# --------------------------------------------------------------------------- ST7
def metric_ratio(sdf: DataFrame, series: str, value: str, num: str, den: str, window: str = "5 minutes",
                 ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """ST7: (1 - num / den) * 100 per tumbling window.  Both are gauges: each
    is its average over the window, so the ratio does not depend on how many
    samples either series has (conditional aggregation is the pivot)."""
    g = sdf.withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("w")).agg(
        F.avg(F.when(F.col(series) == num, F.col(value))).alias("num"),
        F.avg(F.when(F.col(series) == den, F.col(value))).alias("den"))
    return g.select(F.col("w.start").alias("window_start"), "num", "den",
                    F.when(F.col("den") != 0, (F.lit(1.0) - F.col("num") / F.col("den")) * 100).alias("ratio_pct"))


# --------------------------------------------------------------------------- ST8
def import_progress_writer(data_cols: list[str]):
    """ST8: each batch appends its valid rows to ``<out>/rows`` and, in the
    same pass (``observe``), counts processed and malformed lines; the counts
    go to ``<out>/progress`` under the batch id, so a replay replaces them."""
    def foreach(df: DataFrame, batch_id: int, out: str) -> None:
        from pyspark.sql import Observation

        from tessera.sources.jsonl import BAD
        obs = Observation(f"import-{batch_id}")
        seen = df.observe(obs, F.count(F.lit(1)).alias("lines"), F.count(BAD).alias("errors"))
        seen.filter(F.col(BAD).isNull()).select(*data_cols) \
            .write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        m = obs.get
        df.sparkSession.createDataFrame(
            [(batch_id, int(m["lines"]) - int(m["errors"]), int(m["errors"]))],
            "batch_id long, processed long, errors long").write.mode("overwrite") \
            .parquet(f"{out}/progress/batch={batch_id}")
    return foreach


def import_totals(progress: DataFrame) -> DataFrame:
    """Processed and malformed lines over all batches, however they were cut."""
    return progress.agg(F.sum("processed").alias("total_processed"), F.sum("errors").alias("total_errors"))
