"""Epoch arithmetic that does not depend on the session time zone.

``timestamp_ntz`` values are wall-clock times; converting them through
``TIMESTAMP`` would apply the session zone (and its daylight-saving jumps)
to differences between them.  These helpers measure them on the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_micros(c: Column, dtype: str) -> Column:
    """Microseconds since the epoch: wall clock for ``timestamp_ntz``, instant otherwise."""
    if dtype == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), c)
    return F.unix_micros(c)


def from_epoch_micros(m: Column, dtype: str) -> Column:
    """Inverse of ``epoch_micros`` for the same type."""
    if dtype == "timestamp_ntz":
        return F.timestamp_add("MICROSECOND", m, F.lit(_EPOCH_NTZ).cast("timestamp_ntz"))
    return F.timestamp_micros(m)
