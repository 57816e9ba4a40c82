"""Metric-series jobs (ST6, ST5 batch twin).

``previous_row`` gives every sample the previous sample of its series
without a window over the whole series: windows run per (series, time
bucket) and the first row of a bucket takes the last row of the nearest
earlier non-empty bucket, which comes from a table with one row per
(series, bucket).  A series holding a third of all samples is therefore
spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.time import epoch_micros


def previous_row(df: DataFrame, keys: list[str], ts: str, cols: list[str], tie: str,
                 bucket_seconds: int = 3600) -> DataFrame:
    """Adds ``prev_<c>`` for ``ts`` and every column in ``cols``."""
    # a struct of the keys: NULL equals NULL, so a NULL series keeps its rows
    e = df.withColumn("_t", epoch_micros(F.col(ts), dict(df.dtypes)[ts])).withColumn("_key", F.struct(*keys)).withColumn(
        "_bk", F.coalesce(F.floor(F.col("_t") / F.lit(bucket_seconds * 1_000_000)), F.lit(-1))).repartition("_key", "_bk")
    carried = [ts, *cols]
    last = e.groupBy("_key", "_bk").agg(F.max(F.struct("_t", tie, *carried)).alias("_last")).select(
        "_key", "_bk", F.lag("_last").over(Window.partitionBy("_key").orderBy("_bk")).alias("_prev_last"))
    e = e.join(last, ["_key", "_bk"])
    w = Window.partitionBy("_key", "_bk").orderBy("_t", tie)
    for c in carried:
        e = e.withColumn(f"prev_{c}", F.coalesce(F.lag(c).over(w), F.col(f"_prev_last.{c}")))
    return e.drop("_t", "_key", "_bk", "_prev_last")


def counter_increase(df: DataFrame, series: str = "series", ts: str = "ts", value: str = "value",
                     tie: str = "event_id") -> DataFrame:
    """Per sample: increase since the previous sample (a drop is a counter
    reset, so the increase is the new value) and the instant rate."""
    p = previous_row(df, [series], ts, [value], tie)
    inc = F.when(F.col(f"prev_{value}").isNull(), F.lit(None)) \
           .when(F.col(value) < F.col(f"prev_{value}"), F.col(value)) \
           .otherwise(F.col(value) - F.col(f"prev_{value}"))
    ts_type = dict(df.dtypes)[ts]
    dt = (epoch_micros(F.col(ts), ts_type) - epoch_micros(F.col(f"prev_{ts}"), ts_type)) / 1e6
    return p.withColumn("increase", inc).withColumn("irate", F.when(dt > 0, inc / dt))


def metric_rate(df: DataFrame, series: str = "series", ts: str = "ts", value: str = "value",
                tie: str = "event_id", range_: str = "5 minutes", step: str = "1 minute",
                range_seconds: int = 300) -> DataFrame:
    """ST6: at every step, rate = sum of increases in the last ``range_`` /
    range seconds; irate = instant rate of the last sample in the range."""
    return rate_windows(counter_increase(df, series, ts, value, tie), series, ts, tie, range_, step, range_seconds)


def rate_windows(inc: DataFrame, series: str = "series", ts: str = "ts", tie: str = "event_id",
                 range_: str = "5 minutes", step: str = "1 minute", range_seconds: int = 300) -> DataFrame:
    """``rate`` and ``irate`` at every step from samples with their ``increase``
    and ``irate``, whether ``counter_increase`` or the stream found them."""
    g = inc.groupBy(series, F.window(ts, range_, step).alias("w")).agg(
        F.count(F.lit(1)).alias("n_samples"),
        (F.sum("increase") / range_seconds).alias("rate"),
        F.max_by("irate", F.struct(F.col(ts), F.col(tie))).alias("irate"))
    return g.select(series, F.col("w.start").alias("window_start"), "n_samples", "rate", "irate")


def sustained_windows(df: DataFrame, series: str, condition: F.Column, for_minutes: int, ts: str = "ts") -> DataFrame:
    """ST5, batch and streaming: one row per series and minute-aligned window
    of ``for_minutes`` minutes.  A bit per minute says that it has samples."""
    w = df.select(F.col(series).alias("series"), F.coalesce(condition, F.lit(False)).alias("_ok"), F.col(ts).alias("_ts"),
                  F.window(ts, f"{for_minutes} minutes", "1 minute").alias("w"))
    ntz = dict(df.dtypes)[ts] == "timestamp_ntz"
    kind = "timestamp_ntz" if ntz else "timestamp"
    offset = (epoch_micros(F.col("_ts"), kind) - epoch_micros(F.col("w.start"), kind)) / F.lit(60_000_000)
    minute = F.pow(F.lit(2.0), F.floor(offset)).cast("long")
    g = w.withColumn("_minute", minute).groupBy("series", "w").agg(
        F.count(F.lit(1)).alias("n_samples"), F.bit_count(F.bit_or("_minute")).alias("n_minutes"),
        F.min(F.col("_ok").cast("int")).alias("_all"))
    return g.select("series", F.col("w.start").alias("window_start"), "n_samples", "n_minutes",
                    ((F.col("n_minutes") == for_minutes) & (F.col("_all") == 1)).alias("firing"))


def busy_percent(df: DataFrame, idle: str, series: str = "series", ts: str = "ts", value: str = "value",
                 tie: str = "event_id", window: str = "5 minutes") -> DataFrame:
    """ST7, CPU form: 100 - 100 * average instant rate of the idle counter, per
    tumbling window."""
    r = counter_increase(df.filter(F.col(series) == idle), series, ts, value, tie)
    g = r.groupBy(F.window(ts, window).alias("w")).agg(F.count("irate").alias("n_rates"), F.avg("irate").alias("_idle"))
    return g.select(F.col("w.start").alias("window_start"), "n_rates", (F.lit(100.0) - F.col("_idle") * 100).alias("busy_pct"))
