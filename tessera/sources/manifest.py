"""Versions of a table folder.

A table kept in parts has a manifest: which parts make up the version, and
which batch made it.  A change writes new parts beside the old ones and then
one small manifest folder, whose job commit is the moment the change is
there; readers take the newest manifest and are never disturbed.  One writer
at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Manifest:
    """Manifests under ``path``; a part is a row of the given columns."""

    def __init__(self, spark: SparkSession, path: str, columns: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/manifest"
        self.schema = f"{columns}, batch string, version long"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            self._write(spark.createDataFrame([], columns), 0, None)

    def _write(self, parts: DataFrame, version: int, batch: str | None) -> None:
        # a version without parts is still a row, with null columns
        mark = self.spark.range(1).select(F.lit(batch).cast("string").alias("batch"), F.lit(version).cast("long").alias("version"))
        rows = mark.join(parts.withColumn("_on", F.lit(True)), F.lit(True), "left").drop("_on")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version-{version:012d}")

    def history(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/*")

    def version(self) -> int:
        return self.history().agg(F.max("version")).first()[0]

    def parts(self, version: int | None = None) -> list:
        """The parts of a version, the newest if none is given."""
        at = self.version() if version is None else version
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/version-{at:012d}").drop("batch", "version")
        return rows.dropna(how="all").collect()

    def has(self, batch: str | None) -> bool:
        """Whether the batch is in already: applying it again changes nothing."""
        return batch is not None and not self.history().filter(F.col("batch") == batch).isEmpty()

    def commit(self, parts: list[tuple], columns: str, batch: str | None = None) -> int:
        version = self.version() + 1
        self._write(self.spark.createDataFrame(parts, columns), version, batch)
        return version


def remove_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
