"""tessera: corpus preparation, retrieval, chat-log and evaluation jobs on Spark.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing is materialised on the driver except bounded values:
one-row aggregates and size-checked broadcast blocks.
"""

from tessera.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
