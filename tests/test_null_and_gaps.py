"""No row is lost to a NULL key, and "last" and "before" go by position."""

from __future__ import annotations

import datetime as dt

from tessera.operators import chat, evaluate, metrics

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_sessions_keep_null_keys(spark):
    df = spark.createDataFrame([(1, "b", "u", at(0)), (2, None, "u", at(10)), (3, None, "u", at(5000)), (4, "b", None, at(0)),
                                (5, None, "u", at(100))], "event_id long, bot_id string, user_id string, ts timestamp")
    got = {r.event_id: r.session_start for r in chat.sessionize(df, ["bot_id", "user_id"]).collect()}
    assert len(got) == 5 and got[2] == got[5] != got[3]


def test_rates_keep_null_series(spark):
    df = spark.createDataFrame([(1, at(0), None, 1.0), (2, at(10), None, 4.0), (3, at(20), "s", 1.0)],
                               "event_id long, ts timestamp, series string, value double")
    got = {r.event_id: r.increase for r in metrics.counter_increase(df).collect()}
    assert got == {1: None, 2: 3.0, 3: None}
    assert metrics.metric_rate(df).filter("series is null").count() > 0


def rows(spark, turns, conv=1):
    return spark.createDataFrame([(conv, t, "user" if i % 2 == 0 else "assistant", f"m{i}") for i, t in enumerate(turns)],
                                 "conv_id long, msg_idx long, role string, content string")


def test_last_and_prior_by_position(spark):
    r = rows(spark, range(0, 30, 3)).unionByName(rows(spark, [0, 5000, 12_000], None))
    last = chat.last_n_turns(r, 6).collect()
    assert sorted(x.msg_idx for x in last if x.conv_id == 1) == [12, 15, 18, 21, 24, 27]
    assert sum(x.conv_id is None for x in last) == 3
    prior = {(x.msg_idx, x.prior_idx) for x in chat.prior_window(r, 2).filter("conv_id = 1").collect()}
    assert prior == {(3 * i, 3 * j) for i in range(10) for j in range(max(0, i - 2), i)}
    assert {(x.msg_idx, x.prior_idx) for x in chat.prior_window(r, 2).filter("conv_id is null").collect()} == {
        (5000, 0), (12_000, 0), (12_000, 5000)}


def test_running_sums_with_gaps_and_nulls(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, 90_000, 3), (1, None, 7), (None, 1, 4), (None, 2, None), (None, 9, 1)],
                               "conv_id long, turn long, v long")
    got = {(r.conv_id, r.turn): r.before for r in chat.exclusive_running_sum(df, "conv_id", "turn", "v", "before").collect()}
    assert got == {(1, None): 0, (1, 5): 7, (1, 90_000): 9, (None, 1): 0, (None, 2): 4, (None, 9): 4}


def test_line_forms_give_the_same_texts(spark):
    msgs = spark.createDataFrame([(1, 0, "system", "s"), (1, 4, "user", "q"), (1, 9, "assistant", "a")],
                                 "conv_id long, turn long, role string, text string")
    lines = sorted((r.line_no, r.line) for r in chat.render_plain_lines(msgs).collect())
    assert "".join(x for _, x in lines) == chat.render_plain_history(msgs).first().prompt
    assert [r["index"] for r in chat.export_messages(msgs).orderBy("index").collect()] == [1, 2, 3]


def test_evaluated_and_total_counts(spark):
    m = spark.createDataFrame([(1, 1.0, 0.5), (2, None, 0.25), (3, 3.0, None)], "id long, loss double, rouge1_f1 double")
    s = evaluate.eval_summary(m).first()
    assert (s.num_samples_evaluated, s.total_samples, s.evaluated_loss, s.evaluated_rouge1_f1) == (1, 3, 2, 2)
    assert evaluate.eval_summary(m, total_rows=10).first().total_samples == 10


def test_append_documents(spark, tmp_path):
    path = str(tmp_path / "docs")
    for q in ("a", "b"):
        chat.append_documents(spark.createDataFrame([(q, "text", 1)], "question string, content string, x int"), path)
    got = spark.read.parquet(path)
    assert got.columns == ["question", "content", "created_at", "updated_at"] and got.count() == 2
