"""Exact dense top-k over cells of neighbouring points (TK1, JN2, EM2 at scale).

The points are ordered by the signs of their projections on the principal
directions of a bounded sample, so that a prefix of the signs is a region, and
cut into cells of at most ``cell_points`` points; from a quarter of that on a
cell also ends where the signs change.  A cell keeps its centre c
and radius r: by Cauchy-Schwarz no point of it has a product with a query q
above ``q.c + |q| r``.  The search has two rounds:

1. every query scores the points of the few cells with the largest bounds (of
   every group of cells); the k-th score found (or the threshold, if none is) is
   its floor;
2. a query is compared with a cell only if the cell's bound reaches the floor.

In both rounds a group of whole cells, of a bounded size in bytes, meets the
queries as in ``dense``: bounds, choice and scores of a query and a cell are
made in one place, so no table of (query, cell) pairs is ever written.

Nothing is approximate: the result, ties included, is that of
``dense.dense_candidates``.  How many cells are left out depends on the data
(clustered points: most; isotropic noise: none, and the plain search is
cheaper).  The number of cells grows with the points, each is one row, and
neither points nor centres are broadcast or sent to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.dense import POINT_BLOCK, QUERY_BLOCK, _best, _element, _groups, _matrix, _meeting, _merged, _runs, usable_vector
from tessera.operators.lexical import top_k
from tessera.sources.jsonl import scratch_path

CELL_POINTS = 256
SEED_CELLS = 4
# bytes of the sample that gives the directions, and the signs of an order key
SAMPLE_BYTES, SIGNS = 8 << 20, 48
# bounds allow for the rounding of products and of scores to 9 decimals
SLACK = 1e-6


@dataclass
class CellIndex:
    """``cells``: cell, dim, n, centre, radius, point_ids, vectors (one flat array)."""
    cells: DataFrame

    @property
    def centres(self) -> DataFrame:
        return self.cells.select("cell", "dim", "centre", "radius")


def _directions(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(length, mean, directions as rows) of the commonest vector length, from
    the points whose ids have the smallest hashes."""
    common = points.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    dim = common["dim"]
    rows = points.filter(F.col("dim") == dim).orderBy(F.xxhash64("point_id"), "point_id").limit(
        max(2, SAMPLE_BYTES // (8 * dim))).select("vec").collect()
    sample = np.array([r["vec"] for r in rows])
    mean = sample.mean(axis=0)
    _, _, directions = np.linalg.svd(sample - mean, full_matrices=False)
    return dim, mean, directions[:SIGNS]


def write_cells(points: DataFrame, path: str, id_col: str = "point_id", vec_col: str = "embedding",
                cell_points: int = CELL_POINTS) -> CellIndex:
    """Cut ``points`` into cells and write them to ``path`` (a shared folder).
    Vectors that are null, empty or hold a null or non-finite component are
    left out; vectors of unlike lengths never share a cell."""
    spark = points.sparkSession
    kind = _element((points, vec_col))
    p = points.filter(usable_vector(vec_col)).select(
        F.col(id_col).cast("long").alias("point_id"), F.size(vec_col).alias("dim"), F.col(vec_col).cast("array<double>").alias("vec"))
    dim, mean, directions = _directions(p)
    weights = (1 << np.arange(len(directions))[::-1]).astype(np.int64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.zeros(b.num_rows, dtype=np.int64)
            mine = b.column("dim").to_numpy() == dim
            if mine.any():
                x = _matrix(b.column("vec").filter(pa.array(mine)))
                keys[mine] = ((x - mean) @ directions.T > 0) @ weights
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys)], names=[*b.schema.names, "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            x = np.concatenate([_matrix(h.column("vec")) for h in held])
            ids = np.concatenate([h.column("point_id").to_numpy() for h in held])
            centre = x.mean(axis=0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
            return pa.RecordBatch.from_arrays(
                [pa.array([x.shape[1]], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([centre]), pa.array([radius]),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([x.ravel()])],
                names=["dim", "n", "centre", "radius", "point_ids", "vectors"])

        size = 0
        for b in batches:
            dims, keys = b.column("dim").to_numpy(), b.column("key").to_numpy()
            # runs of equal length and signs
            edges = np.flatnonzero((dims[1:] != dims[:-1]) | (keys[1:] != keys[:-1])) + 1
            for at, end in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
                while at < end:
                    last = (held[-1].column("dim")[0].as_py(), held[-1].column("key")[-1].as_py()) if held else None
                    if held and (last[0] != dims[at] or size == cell_points or (last[1] != keys[at] and size >= cell_points / 4)):
                        yield row()
                        held, size = [], 0
                    take = min(cell_points - size, end - at)
                    held.append(b.slice(at, take))
                    size, at = size + take, at + take
        if held:
            yield row()

    ordered = (p.mapInArrow(keyed, "point_id long, dim int, vec array<double>, key long")
               .repartitionByRange("dim", "key", "point_id").sortWithinPartitions("dim", "key", "point_id"))
    cells = ordered.mapInArrow(cut, "dim int, n int, centre array<double>, radius double, point_ids array<long>, vectors array<double>")
    cells = cells.withColumn("vectors", F.col("vectors").cast(kind))    # the values themselves, not more bytes
    cells.withColumn("cell", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    return load_cells(spark, path)


def load_cells(spark: SparkSession, path: str) -> CellIndex:
    return CellIndex(spark.read.parquet(path))


def _compared(q: DataFrame, keys: list[str], index: CellIndex, groups: tuple[int, int], k: int, threshold: float | None,
              seeds: int | None, query_block: int, count: bool = False) -> DataFrame:
    """(keys, point_id, score): per query and group of cells the best ``k``
    points of its ``seeds`` best cells or, with none given, of the cells whose
    bound reaches its floor.  With ``count``: (n), numbers of chosen cells."""
    kind = _element((index.cells, "vectors"), (q, "vec"))
    floor = F.lit(None).cast("double") if seeds else F.col("floor")
    queries = q.select(*keys, "dim", F.col("vec").cast(kind).alias("_vec"), floor.alias("_bound"))
    centres = index.cells.select("dim", "cell", F.col("centre").alias("_centre"), F.col("radius").alias("_bound"), F.lit(0).alias("_side"))
    members = index.cells.select("dim", "cell", "vectors", F.posexplode("point_ids").alias("_at", "_point")).select(
        "dim", "cell", "_point", F.slice("vectors", F.col("_at") * F.col("dim") + 1, F.col("dim")).cast(kind).alias("_vec"), F.lit(1).alias("_side"))
    met = _meeting(queries, centres.unionByName(members, allowMissingColumns=True), keys, "cell", groups, ["cell"])
    scored = [*q.select(*keys).schema.fields, T.StructField("point_id", T.LongType()), T.StructField("score", T.DoubleType())]
    least = -np.finfo(np.float64).max if threshold is None else threshold

    def one(x: np.ndarray, chosen: np.ndarray, points: np.ndarray, ids: np.ndarray, of: np.ndarray) -> list[tuple]:
        """Best points of each of the queries ``x`` among its chosen cells."""
        parts = []
        wanted = np.flatnonzero(chosen.any(axis=0)[of])          # points of any chosen cell
        for j in range(0, len(wanted), POINT_BLOCK):
            some = wanted[j:j + POINT_BLOCK]
            mine = chosen[:, of[some]]
            asking = np.flatnonzero(mine.any(axis=1))
            scores = np.where(mine[asking], np.round(x[asking] @ points[some].T, 9), -np.inf)
            r, c = _best(scores, ids[some], k, least)
            parts.append((asking[r], ids[some][c], scores[r, c]))
        return parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cells, held, points = None, [], [], None
        for spot, side, rows in _runs(batches):
            if spot != at:
                at, cells, held, points = spot, [], [], None
            if side == 0:
                cells.append((rows.column("cell").to_numpy(), _matrix(rows.column("_centre")), rows.column("_bound").to_numpy()))
            elif side == 1:
                held.append((rows.column("cell").to_numpy(), _matrix(rows.column("_vec")), rows.column("_point").to_numpy()))
            elif cells:
                if points is None:
                    names, centres, radius = (np.concatenate(c) for c in zip(*cells))
                    of, points, ids = (np.concatenate(c) for c in zip(*held))
                    of, held = np.searchsorted(names, of), []
                x = _matrix(rows.column("_vec"))
                bound = x @ centres.T
                bound += np.sqrt((x ** 2).sum(axis=1))[:, None] * radius[None, :] + SLACK
                # queries that are near the same cells are compared together
                near = np.argsort(bound.argmax(axis=1), kind="stable")
                if seeds:
                    chosen = np.zeros(bound.shape, dtype=bool)
                    chosen[_best(bound, names, seeds, None)] = True
                else:
                    chosen = bound >= rows.column("_bound").to_numpy()[:, None]
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array([int(chosen.sum())])], names=["n"])
                    continue
                for i in range(0, len(x), query_block):
                    some = near[i:i + query_block]
                    parts = one(x[some], chosen[some], points, ids, of)
                    if parts:
                        r, found, score = _merged(parts, k)
                        yield pa.RecordBatch.from_arrays(
                            [*(rows.column(c).take(pa.array(some[r])) for c in keys), pa.array(found), pa.array(score)],
                            names=[*keys, "point_id", "score"])

    return met.select("dim", "_i", "_j", "_side", *keys, "cell", "_point", "_bound", "_centre", "_vec").mapInArrow(
        run, "n long" if count else T.StructType(scored))


def search_cells(index: CellIndex, queries: DataFrame, k: int, threshold: float | None = None, keys: list[str] | None = None,
                 qvec_col: str = "query_vec", query_block: int = QUERY_BLOCK, seeds: int = SEED_CELLS,
                 work: dict | None = None) -> DataFrame:
    """(keys, point_id, score, search_rank): the ``k`` points with the largest
    product per query, at least ``threshold``; ties by rising id.  A query is
    compared with the points of its own length; one that is null, empty or
    holds a null or non-finite component has no rows.  ``work`` is filled with
    the numbers of (query, cell) pairs of equal length and of those compared."""
    keys = keys or ["query_id"]
    spark = index.cells.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    q = queries.filter(usable_vector(qvec_col)).select(*keys, F.col(qvec_col).cast(_element((queries, qvec_col))).alias("vec"),
                                                       F.size(qvec_col).alias("dim"))
    size = index.cells.agg(F.sum("n").alias("n"), F.max("dim").alias("dim")).first()
    groups = _groups(q.count(), size["n"] or 0, size["dim"] or 1, query_block, POINT_BLOCK)
    order = [F.col("score").desc(), F.col("point_id")]
    ranked = top_k(_compared(q, keys, index, groups, k, threshold, seeds, query_block), keys, order, k)
    least = float("-inf") if threshold is None else float(threshold)
    floors = kept(ranked.filter(F.col("rank") == k).select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("score").alias("floor")), "cell-floors")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    limited = q.join(floors, on, "left").select(*keys, "vec", "dim", F.coalesce("floor", F.lit(least)).alias("floor"))
    if work is not None:
        every = q.groupBy("dim").count().join(index.cells.groupBy("dim").agg(F.count(F.lit(1)).alias("cells")), "dim")
        compared = _compared(limited, keys, index, groups, k, threshold, None, query_block, count=True)
        work |= {"pairs": int(every.agg(F.sum(F.col("count") * F.col("cells"))).first()[0] or 0),
                 "compared": int(compared.agg(F.sum("n")).first()[0] or 0)}
    return top_k(_compared(limited, keys, index, groups, k, threshold, None, query_block), keys, order, k, "search_rank")
