"""Search over cells: equal to comparing everything, few cells visited on
clustered points, ragged and broken vectors."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import dense, dense_cells
from tessera.sources.jsonl import scratch_path

P, Q = "point_id long, embedding array<double>", "query_id long, query_vec array<double>"


def rows(df):
    return sorted((r.query_id, r.search_rank, r.point_id, r.score) for r in df.collect())


def clustered(seed, clusters, each, dim, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = np.repeat(centres, each, axis=0) + spread * rng.normal(size=(clusters * each, dim))
    x[1::7] = x[1]                                                   # ties
    return x


@pytest.mark.parametrize("threshold", [None, 0.5, 30.0])
def test_equal_to_the_plain_search(spark, threshold):
    x = clustered(1, 20, 30, 12)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], P).repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[::11] * 1.1)] + [(999, [0.0] * 12)], Q)
    index = dense_cells.write_cells(p, scratch_path(spark, "cells"), cell_points=16)
    got = dense_cells.search_cells(index, q, 5, threshold, query_block=20)
    assert rows(got) == rows(dense.dense_candidates(q, p, 5, threshold))
    assert {r.n <= 16 for r in index.cells.collect()} == {True}


def test_few_cells_are_compared_on_clustered_points(spark):
    x = clustered(2, 64, 64, 16)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], P)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[::50])], Q)
    index = dense_cells.write_cells(p, scratch_path(spark, "cells"), cell_points=32)
    work = {}
    got = dense_cells.search_cells(index, q, 3, work=work)
    assert rows(got) == rows(dense.dense_candidates(q, p, 3, None))
    assert work["pairs"] == q.count() * index.cells.count() and work["compared"] < 0.35 * work["pairs"], work


@pytest.mark.parametrize("cells", [False, True])
def test_ragged_and_broken_vectors(spark, cells):
    nan, inf = float("nan"), float("inf")
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0, 2.0]), (4, [1.0, None]), (5, []), (6, [nan, 1.0]),
                               (7, [inf, 0.0]), (8, [0.5, 0.5]), (9, [2.0])], P)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0, 1.0]), (3, None), (4, [None, 1.0]), (5, []), (6, [1.0] * 4), (7, [3.0])], Q)
    if cells:
        found = dense_cells.search_cells(dense_cells.write_cells(p, scratch_path(spark, "cells")), q, 4)
    else:
        found = dense.dense_candidates(q, p, 4, None)
    assert rows(found) == [(1, 1, 1, 1.0), (1, 2, 8, 0.5), (2, 1, 3, 3.0), (7, 1, 9, 6.0)]


def test_empty_tables(spark):
    p, q = spark.createDataFrame([], P), spark.createDataFrame([(1, [1.0])], Q)
    index = dense_cells.write_cells(p, scratch_path(spark, "cells"))
    assert dense_cells.search_cells(index, q, 4).collect() == []
    full = dense_cells.write_cells(spark.createDataFrame([(1, [1.0])], P), scratch_path(spark, "cells"))
    assert dense_cells.search_cells(full, q.limit(0), 4).collect() == []


def test_no_query_and_cell_pairs_are_kept(spark):
    import glob

    from tessera.session import checkpoint_dir
    x = clustered(4, 10, 20, 6, spread=0.5)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], P)
    q = spark.createDataFrame([(i % 50, v.tolist()) for i, v in enumerate(x[:60])], Q)
    index = dense_cells.write_cells(p, scratch_path(spark, "cells"), cell_points=8)
    before = glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/tessera-scratch/cell-pairs*")
    got = dense_cells.search_cells(index, q, 4, query_block=7)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert rows(got) == rows(dense.dense_candidates(q, p, 4, None))
    assert glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/tessera-scratch/cell-pairs*") == before
