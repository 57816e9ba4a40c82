"""Whitening against the dense eigendecomposition, ties and odd inputs."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.llm import whitening
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def vectors(spark, arrays, ids=None):
    rows = [(i, None if a is None else [None if v is None else float(v) for v in a]) for i, a in zip(ids or range(len(arrays)), arrays)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def reference(x):
    """Exact deviations, eigenvalues (falling) and eigenvectors by numpy."""
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x.astype(object) - s) ** 2).sum(axis=1)
    e, v = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    return deviation, e[::-1], v[:, ::-1]


def test_query_equals_the_eigendecomposition(spark):
    got = QUERIES["op11_whitening"](spark, SF).toPandas()
    source = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = [r.vec_id for r in source]
    x = np.array([np.floor(1024 * np.array(r.embedding, dtype=np.float64)) for r in source]).astype(np.int64) + 100_000
    deviation, e, v = reference(x)
    assert len(got) == 8 * len(ids) and set(got.n) == {len(ids)} and (got.identity_error <= 1e-10).all()
    y = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = ((x - x.mean(axis=0)) @ v[:, :8]) / np.sqrt(e[:8])
    sign = np.sign((y * want).sum(axis=0))
    assert np.abs(y * sign - want).max() < 1e-8
    assert list(got.drop_duplicates("vec_id").set_index("vec_id").loc[ids].deviation) == list(deviation)
    share = got.drop_duplicates("component").set_index("component").explained
    assert np.allclose([share[i + 1] for i in range(8)], e[:8] / e.sum(), rtol=1e-10)


def test_few_strong_directions_need_few_passes(spark):
    """A check run follows the early end; repeated deviations are all found."""
    rng = np.random.default_rng(3)
    scale = np.array([8.0, 8.0, 8.0, 4.0, 2.0] + [0.01] * 75)
    rows = whitening.integer_vectors(vectors(spark, rng.normal(size=(600, 80)) * scale))
    model = whitening.fit(rows, 5)
    x = np.array([r.x for r in rows.select("x").collect()], dtype=np.int64)
    _, e, v = reference(x)
    assert model.passes < 60
    assert np.allclose(model.eigenvalues, e[:5], rtol=1e-12)
    assert np.allclose(np.abs((model.components * v[:, :5].T).sum(axis=1)), 1, atol=1e-12)


def test_exactly_repeated_deviations(spark):
    """Signed unit vectors: every deviation equal, so one run finds one component."""
    d = 12
    rows = whitening.integer_vectors(vectors(spark, [s * np.eye(d)[i] for i in range(d) for s in (1, -1)]))
    model = whitening.fit(rows, 8)
    assert len(model.eigenvalues) == 8 and np.allclose(model.eigenvalues, model.eigenvalues[0])
    assert np.allclose(model.components @ model.components.T, np.eye(8), atol=1e-13)
    assert whitening.identity_error(rows, model) < 1e-10


def test_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    df = vectors(spark, [[1, 2, 3], None, [1, None, 3], [1, nan, 3], [inf, 0, 0], [], [1, 2], [2, 2, 5], [1, 2, 3], [0, 1, 9], [1e30, 0, 0]],
                 [1, 2, 3, 4, 5, 6, 7, None, 1, 8, 9]).selectExpr("*", "'x' as whitened", "1 as n")
    got = whitening.whitened_rows(df).collect()
    assert sorted({r.vec_id for r in got}, key=str) == [1, 8, None]
    assert {r.component for r in got} == {1, 2}                     # four points in a plane
    assert {r.n for r in got} == {4} and sum(r.vec_id == 1 for r in got) == 4
    assert max(r.identity_error for r in got) < 1e-10
    x = np.array([[1, 2, 3], [2, 2, 5], [1, 2, 3], [0, 1, 9]]) * 1024 + 100_000
    assert {r.deviation for r in got} == set(reference(x)[0])


@pytest.mark.parametrize("arrays", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_no_deviation_gives_no_rows(spark, arrays):
    assert whitening.whitened_rows(vectors(spark, arrays)).collect() == []


def test_deviations_beyond_64_bits_are_exact_or_null(spark):
    big = [[2.0 ** 39, 0.0], [-(2.0 ** 39), 0.0], [0.5, 3.0]]
    rows = whitening.integer_vectors(vectors(spark, big))
    model = whitening.fit(rows, 2)
    got = {r.id: r.deviation for r in whitening.whiten(rows, model).collect()}
    assert got[0] is None and got[1] is None
    x = np.array([[2 ** 49, 0], [-(2 ** 49), 0], [512, 3072]], dtype=object) + 100_000
    assert got[2] == ((3 * x - x.sum(axis=0)) ** 2).sum(axis=1)[2]
