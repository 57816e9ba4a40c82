"""A point table that is updated without rewriting it (SNK8, SNK9, ST3).

Points are hashed by id into a fixed number of buckets.  A change reads and
rewrites only the buckets that its ids fall into, under a new version; the
manifest says which version every bucket stands at.  A bucket is always one
folder, so reading never grows with the number of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import chunk
from tessera.sources.manifest import Manifest, remove_folder

PARTS = "bucket int, made long, n long"


class PointStore:
    """Points of one ``schema`` (with ``id_col``) under the shared folder
    ``path``.  ``buckets`` is fixed when the store is made: size it so that a
    bucket is a few hundred megabytes."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, id_col: str = "point_id", buckets: int = 64):
        self.spark, self.path, self.id_col, self.buckets = spark, path.rstrip("/"), id_col, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.manifest = Manifest(spark, self.path, PARTS)

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.id_col), F.lit(self.buckets)).cast("int")

    def _read(self, parts: list) -> DataFrame:
        # never a folder of an empty bucket: it has none
        paths = [f"{self.path}/data/made={p['made']}/bucket={p['bucket']}" for p in parts if p["n"]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def points(self, version: int | None = None) -> DataFrame:
        """All points of a version, the newest if none is given."""
        return self._read(self.manifest.parts(version))

    def _change(self, ids: DataFrame, changed, batch: str | None) -> int:
        """Rewrite the buckets of ``ids`` as ``changed`` makes them."""
        if self.manifest.has(batch):
            return self.manifest.version()
        parts = {p["bucket"]: p for p in self.manifest.parts()}
        touched = [r[0] for r in ids.select(self._bucket().alias("b")).distinct().collect()]     # at most ``buckets``
        made = self.manifest.version() + 1
        out = f"{self.path}/data/made={made}"
        rows = changed(self._read([parts[b] for b in touched if b in parts])).select(
            *(F.col(f.name).cast(f.dataType) for f in self.schema.fields))
        (rows.withColumn("bucket", self._bucket()).repartition(max(1, len(touched)), "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(out))
        written = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        sizes = {r["bucket"]: r["count"] for r in self.spark.read.schema(written).parquet(out).groupBy("bucket").count().collect()}
        for b in touched:
            parts[b] = {"bucket": b, "made": made, "n": sizes.get(b, 0)}
        return self.manifest.commit([(p["bucket"], p["made"], p["n"]) for p in parts.values()], PARTS, batch)

    def upsert(self, points: DataFrame, batch: str | None = None, seq_col: str | None = None) -> int:
        """Insert or replace by id; of several rows of one id that with the
        largest ``seq_col`` (without one: any).  A null id is an id.  A
        ``batch`` that is in already changes nothing.  Returns the version."""
        seq = seq_col or "_seq"
        given = points if seq_col else points.withColumn("_seq", F.lit(0))
        latest = chunk.latest_per_id(given.select(*self.schema.fieldNames(), *([seq] if seq not in self.schema.fieldNames() else [])),
                                     self.id_col, seq)
        key = F.struct(self.id_col)      # NULL equals NULL
        keep = lambda base: base.withColumn("_key", key).join(
            latest.select(key.alias("_key")), "_key", "left_anti").drop("_key")
        return self._change(points, lambda base: keep(base).select(*self.schema.fieldNames()).unionByName(
            latest.select(*self.schema.fieldNames())), batch)

    def delete(self, ids: DataFrame, batch: str | None = None) -> int:
        """Delete by id; ids that are not there are ignored."""
        gone = ids.select(F.struct(self.id_col).alias("_key")).distinct()
        return self._change(ids, lambda base: base.withColumn("_key", F.struct(self.id_col)).join(gone, "_key", "left_anti").drop("_key"), batch)

    def replace(self, points: DataFrame, owners: DataFrame, owner_col: str, batch: str | None = None) -> int:
        """Replace everything the owners (e.g. documents) have by ``points``;
        the id must be hashed by its owner, i.e. ``id_col`` is ``owner_col``."""
        if self.id_col != owner_col:
            raise ValueError("a store that replaces by owner is bucketed by the owner")
        gone = owners.select(F.struct(owner_col).alias("_key")).distinct()
        keep = lambda base: base.withColumn("_key", F.struct(owner_col)).join(gone, "_key", "left_anti").drop("_key")
        return self._change(owners, lambda base: keep(base).unionByName(points.select(*self.schema.fieldNames())), batch)

    def vacuum(self) -> int:
        """Remove the data of older versions; returns how many folders went.
        No reader of an older version may be running."""
        used = {(p["made"], p["bucket"]) for p in self.manifest.parts()}
        old = self.manifest.history().select("made", "bucket").dropna().distinct().collect()     # buckets times versions
        gone = [(r["made"], r["bucket"]) for r in old if (r["made"], r["bucket"]) not in used]
        for made, bucket in gone:
            remove_folder(self.spark, f"{self.path}/data/made={made}/bucket={bucket}")
        return len(gone)
