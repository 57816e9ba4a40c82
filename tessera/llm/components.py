"""Connected components of an edge table, by alternating stars.

Each round joins every node with the smallest node it knows (large star, then
small star), so a component shrinks to a star around its smallest id in a
logarithmic number of rounds.  Every round is written to the shared folder:
the plan stays short and a lost executor costs one round at most.  No edge,
node or component reaches the driver, and no task gathers the edges of a hub.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise


# at most twice so many nodes are hubs, whose edges are not gathered
HUB_SHARE, LEAST_HUB = 50_000, 256


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` with the smallest neighbour ``m`` of their node ``a``.  The
    nodes with more than a fixed share of the edges are few, so their row is
    broadcast and their edges stay where they are."""
    hubs = least.filter(F.col("n") > max(LEAST_HUB, total // HUB_SHARE)).select("a", "m")
    hubs = F.broadcast(materialise(hubs, "hubs"))
    rest = edges.join(hubs, "a", "left_anti").join(least.select("a", "m"), "a")
    return edges.join(hubs, "a").unionByName(rest)


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))


def _large_star(e: DataFrame, total: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (_with_least(both.filter("b > a"), _least(both), total)
            .select(F.col("b").alias("x"), F.least("a", "m").alias("b")).withColumnRenamed("x", "a").distinct())


def _small_star(e: DataFrame, total: int) -> DataFrame:
    least = _least(e)
    rest = _with_least(e, least, total).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of ``edges`` but the smallest of each
    component; ``component`` is that smallest id.  Self edges and edges with a
    null end are ignored; no edges give no rows."""
    e = materialise(edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).distinct(), "edges")
    while True:
        roots = e.select(F.col("b").alias("a")).distinct()
        heads = e.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
        if e.join(roots, "a", "left_semi").select("a").unionByName(heads).isEmpty():
            return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
        total = e.count()
        e = materialise(_small_star(materialise(_large_star(e, total), "edges"), total), "edges")


def spanning_links(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) that connect what the boolean matrix connects: at
    most one less than rows plus columns, never all pairs."""
    rows, cols = linked.shape
    far = rows + cols
    of_row = np.where(linked.any(axis=1), linked.argmax(axis=1) + rows, far)
    of_col = np.full(cols, far)
    while True:
        new_col = np.minimum(of_col, np.where(linked, of_row[:, None], far).min(axis=0, initial=far))
        new_row = np.minimum(of_row, np.where(linked, new_col[None, :], far).min(axis=1, initial=far))
        if (new_col == of_col).all() and (new_row == of_row).all():
            break
        of_row, of_col = new_row, new_col
    # every member is tied to the column its component is named after
    r = np.flatnonzero(of_row < far)
    c = np.flatnonzero((of_col < far) & (of_col != np.arange(cols) + rows))
    return np.concatenate([r, c + rows]), np.concatenate([of_row[r], of_col[c]])
