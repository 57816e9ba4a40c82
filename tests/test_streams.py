"""Streams over several micro-batches: state hand-over, late rows, replacement,
and the same results in every session time zone."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import chat, chunk, metrics
from tessera.sources.jsonl import scratch_path
from tessera.streaming import jobs

T0 = dt.datetime(2024, 3, 10, 1, 0, 0)       # hours before a daylight-saving change in New York


def files(spark, batches, schema):
    """A stream that reads one list of rows per micro-batch."""
    path = scratch_path(spark, "batches")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Tokyo"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sessions_over_batches_in_every_zone(spark, zone):
    schema = "event_id long, bot_id string, user_id string, wall_ts timestamp_ntz"
    seconds = [[0, 100, 459], [500, 460, 900], [1300, 5000, 4990]]       # out of order inside and across batches
    rows, n = [], 0
    for batch in seconds:
        rows.append([(n + i, "b", None if s == 900 else "u", T0 + dt.timedelta(seconds=s)) for i, s in enumerate(batch)])
        n += len(batch)
    s = files(spark, rows, schema).withColumn("ts", F.col("wall_ts").cast("timestamp"))
    out = spark.read.parquet(jobs.drain(jobs.stream_session_ids(s, ["bot_id", "user_id"], wall_clock="wall_ts"), "s"))
    got = {r.event_id: r.session_start for r in out.collect()}
    flat = spark.createDataFrame([r for b in rows for r in b], schema)
    twin = {r.event_id: r.session_start for r in chat.sessionize(flat, ["bot_id", "user_id"], "wall_ts").collect()}
    assert got == twin and len(got) == 9


@pytest.mark.parametrize("groups", [1, 3])
def test_sessions_of_many_keys_share_a_call(spark, groups):
    schema = "event_id long, bot_id string, user_id string, ts timestamp"
    rows = [(i, None if i % 5 == 0 else f"b{i % 3}", None if i % 7 == 0 else str(i % 41), T0 + dt.timedelta(seconds=(i * 37) % 400 + 9 * i))
            for i in range(900)]
    s = files(spark, [rows[:300], rows[300:500], rows[500:]], schema)
    out = spark.read.parquet(jobs.drain(jobs.stream_session_ids(s, ["bot_id", "user_id"], watermark="2 hours", groups=groups), "g"))
    got = {r.event_id: r.session_start for r in out.collect()}
    flat = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    twin = {r.event_id: r.session_start for r in chat.sessionize(flat, ["bot_id", "user_id"], "ts").collect()}
    assert got == twin and 82 < len(set(got.values())) and len(got) == 900


def test_an_access_without_a_time_is_in_the_session_before(spark):
    schema = "event_id long, bot_id string, user_id string, ts timestamp"
    rows = [(1, "b", "u", T0), (2, "b", "u", None), (3, "b", "u", T0 + dt.timedelta(hours=1)), (4, "b", "v", T0), (5, "b", "w", None)]
    s = files(spark, [rows, [(6, "b", "v", None)]], schema)
    out = spark.read.parquet(jobs.drain(jobs.stream_session_ids(s, ["bot_id", "user_id"], groups=1), "n"))
    got = {r.event_id: r.session_start and r.session_start[11:13] for r in out.collect()}
    assert got == {1: "01", 2: "02", 3: "02", 4: "01", 5: None, 6: "01"}


def test_history_carries_messages_between_batches(spark):
    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    day = dt.timedelta(days=30)
    s = files(spark, [[(1, 0, "user", "a", T0), (1, 1, "assistant", "b", T0)], [(2, 0, "user", "x", T0 + day)],
                      [(1, 7, "user", "c", T0 + 2 * day)]], schema)
    out = spark.read.parquet(jobs.drain(jobs.stream_history(s, 2), "h"))
    got = {(r.conv_id, r.turn): [(m.turn, m.content) for m in r.prior] for r in out.collect()}
    assert got == {(1, 0): [], (1, 1): [(0, "a")], (2, 0): [], (1, 7): [(0, "a"), (1, "b")]}
    forgetful = spark.read.parquet(jobs.drain(jobs.stream_history(s, 2, retention_ms=1000), "h2"))
    assert {(r.conv_id, r.turn): r.n_prior for r in forgetful.collect()}[(1, 7)] == 0


def test_reingested_documents_replace_their_chunks(spark):
    long_text = " ".join(f"w{i}" for i in range(1500))
    s = files(spark, [[(1, long_text), (2, "two words")], [(3, long_text)], [(1, "only this"), (2, "")]],
              "doc_id long, text string")
    sdf, foreach = jobs.stream_ingest_documents(s)
    live = jobs.live_points(spark, jobs.drain(sdf, "i", "append", foreach)).collect()
    assert sorted((r.doc_id, r.chunk_idx) for r in live) == [(1, 0), (3, 0), (3, 1), (3, 2), (3, 3)]
    assert [r.content for r in live if r.doc_id == 1] == ["only this"] and all(len(r.embedding) == 64 for r in live)


def test_long_documents_keep_distinct_points(spark):
    docs = spark.createDataFrame([(1, "w " * 2300), (2, "x")], "doc_id long, text string")
    p = chunk.point_ids(chunk.chunk_tokens(docs, "text", 3, 1)).collect()
    assert len({r.chunk_key for r in p}) == len(p) == 1151 and sum(r.point_id is None for r in p) == 150


def test_contents_repeat_after_the_delay(spark):
    schema = "content string, ts timestamp"
    hour = dt.timedelta(hours=1)
    s = files(spark, [[("a", T0), ("b", T0), ("a", T0)], [("a", T0 + hour / 2), ("c", T0 + 9 * hour)],
                      [("d", T0 + 20 * hour)], [("a", T0 + 21 * hour), ("late", T0)]], schema)
    out = spark.read.parquet(jobs.drain(jobs.stream_dedup_content(s, within="2 hours"), "d"))
    assert sorted(r.content for r in out.collect()) == ["a", "a", "b", "c", "d"]


def minutes(*values):
    return [(i, T0 + dt.timedelta(minutes=m, seconds=30), "s", float(v)) for i, (m, v) in enumerate(values)]


def test_alert_needs_every_minute(spark, zone):
    schema = "event_id long, ts timestamp, series string, value double"
    rows = minutes((0, 9), (1, 9), (2, 9), (3, 9), (4, 9), (5, 1), (10, 9), (20, 9), (21, 9), (23, 9), (24, 9), (25, 9))
    s = files(spark, [rows[:4], rows[4:8], rows[8:]], schema)
    a = jobs.sustained_alert(s, "series", F.col("value") > 5, 5)
    r = jobs.read_latest(spark, jobs.drain(a, "a", "update", jobs.write_batch), ["series", "window_start"])
    twin = metrics.sustained_windows(spark.createDataFrame(rows, schema), "series", F.col("value") > 5, 5)
    key = lambda df: {(x.window_start, x.n_samples, x.n_minutes, x.firing) for x in df.collect()}
    assert key(r) == key(twin) and [x.n_minutes for x in r.filter("firing").collect()] == [5]


@pytest.mark.parametrize("batches", [1, 3, 17])
def test_streamed_rate_equals_batch(spark, batches):
    schema = "event_id long, ts timestamp, series string, value double"
    values = [(7 * i * i) % 50 for i in range(68)]                       # with counter resets
    rows = [(i, T0 + dt.timedelta(seconds=20 * i), None if i % 3 == 0 else "a", None if i == 31 else float(v))
            for i, v in enumerate(values)]
    late = [rows[i ^ 5] if (i ^ 5) < 68 else rows[i] for i in range(68)]   # out of order by up to five samples
    late.insert(14, (900, T0 + dt.timedelta(seconds=200), "a", 3.0))     # a tie in time, told apart by its id
    size = -(-len(late) // batches)
    s = files(spark, [late[k:k + size] for k in range(0, len(late), size)], schema)
    got = jobs.stream_metric_rate(s, f"rate{batches}")
    twin = metrics.metric_rate(spark.createDataFrame(late, schema))
    key = lambda df: {(x.series, x.window_start, x.n_samples, x.rate and round(x.rate, 9), x.irate and round(x.irate, 9))
                      for x in df.collect()}
    assert key(got) == key(twin) and got.count() > 20


def test_samples_before_the_watermark_are_dropped(spark):
    schema = "event_id long, ts timestamp, series string, value double"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    s = files(spark, [[(1, at(0), "a", 1.0), (2, at(40), "a", 5.0)], [(3, at(41), "a", 6.0)], [(4, at(1), "a", 2.0), (5, None, "a", 9.0)],
                      [(6, at(35), "a", 3.0)]], schema)
    out = jobs.drain(jobs.stream_counter_increase(s), "late", "update", jobs.write_batch)
    got = {r.event_id: r.increase for r in jobs.read_latest(spark, out, ["series", "event_id"]).collect()}
    assert got == {1: None, 2: 2.0, 3: 1.0, 6: 2.0}


def test_a_replayed_slice_is_dealt_over_files(spark):
    df = spark.range(0, 4000, numPartitions=7).selectExpr("id", "cast(id as string) AS text")
    # the second slice has one row, the third none of its own below the last
    df = df.filter("id < 1333 or id = 2000 or id = 3999").repartition(7)
    sdf = jobs.replay(df, "id")
    sizes = {}

    def seen(batch, batch_id, out):
        sizes[batch_id] = sorted(r[0] for r in batch.select("id").collect()), batch.select(F.input_file_name()).distinct().count()

    jobs.drain(sdf, "slices", foreach=seen)
    ids = [sizes[i][0] for i in sorted(sizes)]
    assert [len(x) for x in ids] == [1333, 1, 1] and ids[1:] == [[2000], [3999]] and sizes[0][1] == 3


def test_increases_keep_only_the_samples_that_can_still_matter(spark):
    import numpy as np
    import pandas as pd

    class State:
        exists, kept = False, None

        def getCurrentWatermarkMs(self):  # noqa: N802
            return 0

        def update(self, kept):
            self.kept = kept

    state = State()
    t = np.random.default_rng(0).permutation(100_000) * 1_000_000
    frames = (pd.DataFrame({"t_us": t[i:i + 5000], "event_id": t[i:i + 5000], "value": 1.0 * (t[i:i + 5000] % 7)}) for i in range(0, 100_000, 5000))
    out = list(jobs._increase_fn(600_000)(("s",), frames, state))
    assert sum(map(len, out)) == 100_000 and max(map(len, out)) <= jobs.INCREASE_ROWS and len(state.kept[0]) == 602
    assert out[0]["t_us"].tolist()[:2] == [0, 1_000_000] and out[0]["increase"].isna().sum() == 1


def test_ratio_of_gauges_and_busy_share(spark):
    schema = "event_id long, ts timestamp, series string, value double"
    free, total = [(i, T0 + dt.timedelta(seconds=i), "free", 25.0) for i in range(10)], [(99, T0, "total", 100.0)]
    s = files(spark, [free[:5], free[5:], total], schema)
    m = jobs.metric_ratio(s, "series", "value", "free", "total")
    r = jobs.read_latest(spark, jobs.drain(m, "r", "update", jobs.write_batch), ["window_start"]).collect()
    assert [x.ratio_pct for x in r] == [75.0]
    idle = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=10 * i), "idle", 2.0 * i) for i in range(5)], schema)
    assert [x.busy_pct for x in metrics.busy_percent(idle, "idle").collect()] == [80.0]


def test_open_sessions_are_covered(spark):
    schema = "event_id long, bot_id string, user_id string, ts timestamp"
    rows = [(i, "b", "u" if i % 2 else None, T0 + dt.timedelta(seconds=200 * i)) for i in range(30)]
    s = files(spark, [rows[:10], rows[10:20], rows[20:]], schema)
    closed = spark.read.parquet(jobs.drain(jobs.stream_sessions(s, ["bot_id", "user_id"]), "c"))
    every = jobs.all_sessions(closed, spark.createDataFrame(rows, schema), ["bot_id", "user_id"]).collect()
    assert sum(r.n_events for r in every) == 30 and {r.closed for r in every} == {True, False}


def test_import_totals_over_batches(spark):
    p = spark.createDataFrame([(0, 5, 1), (1, 7, 0), (2, 0, 2)], "batch_id long, processed long, errors long")
    assert tuple(jobs.import_totals(p).first()) == (12, 3)
