"""Session construction and the few cluster-facing helpers every job shares."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Conservative defaults sized for large inputs; a cluster's own settings win
# because ``getOrCreate`` returns the active session unchanged.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tessera", checkpoint: str | None = None) -> SparkSession:
    """Return the active session, or build a local one (tools, bench), whose
    scratch tables go to the folder ``checkpoint``."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    builder = builder.config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, the warehouse - the other shared folder a session
    names - holds the scratch tables.  Never a folder of one machine's own.
    """
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tessera")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


# A row of ids, scores and short strings takes well under this many bytes.
NARROW_ROW_BYTES = 200
BROADCAST_BYTES = 40 << 20


def bounded_rows(df: DataFrame, max_rows: int) -> int | None:
    """Row count if it is at most ``max_rows`` else None; reads no further."""
    n = df.limit(max_rows + 1).count()
    return n if n <= max_rows else None


def broadcast_if_small(df: DataFrame, row_bytes: int = NARROW_ROW_BYTES) -> DataFrame:
    """Broadcast ``df`` only when rows times ``row_bytes`` is proven to stay
    under ``BROADCAST_BYTES``; it must hold narrow columns only, never texts.

    The frame is written to the shared folder first, so the probe and the join
    read the same rows, nothing is left in executor memory, and a lost
    executor does not compute it again.  Beyond the bound Spark plans a
    shuffle join (AQE may still convert it from run-time sizes).
    """
    from tessera.sources.jsonl import scratch_path
    wide = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map")]
    if wide:
        raise ValueError(f"only narrow columns may be broadcast, not {wide}")
    path = scratch_path(df.sparkSession, "narrow")
    df.write.parquet(path)
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    return F.broadcast(df) if bounded_rows(df, BROADCAST_BYTES // row_bytes) is not None else df
