"""Near-duplicate vectors by product quantisation over inverted lists.

Index: vectors are scaled to length one (double precision), assigned to the
nearest of a few coarse centroids, and the residual is coded per subspace.
The centroids and codebooks are fitted on a bounded sample
(``TRAIN_VECTORS``); every vector is indexed, with the length of its own
coding error.

Search: two vectors of cosine ``t`` are at distance ``r = sqrt(2 - 2 t)`` at
most.  A list is probed if some query of a block can have such a neighbour in
it: its distance to the plane between its own and the list's centroid is at
most ``r``.  In a probed list the asymmetric distance from the query to the
coded vector (sums of table entries) may exceed ``r`` by the coding error at
most.  Both bounds are exact, so no pair is lost; survivors are rescored by
exact cosine.

Scale: equal vectors are one representative with a count.  Lists are split
into blocks by a hash of the id, so a hot list becomes many block pairs, each
a row of bounded size.  A block pair returns link counts and the edges of a
spanning forest, never all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.components import connected_components, spanning_links

TRAIN_VECTORS = 32_768      # rows, by hash of the id, that the quantisers are fitted on
BLOCK_ROWS = 512
MAX_CELLS = 1024
SLACK = 1e-6                # for rounding in the distance bounds; the rescoring is exact


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((centres ** 2).sum(1) - 2 * x @ centres.T, axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Index:
    """Coarse centroids and, per subspace, the codebook of residuals."""
    centres: np.ndarray
    edges: list[int]
    books: list[np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, cells: int, subspaces: int = 8, codes: int = 64) -> "Index":
        centres = _kmeans(x, min(cells, len(x)))
        near = np.argmin((centres ** 2).sum(1) - 2 * x @ centres.T, axis=1)
        rest = x - centres[near]
        edges = [round(i * x.shape[1] / min(subspaces, x.shape[1])) for i in range(min(subspaces, x.shape[1]) + 1)]
        return Index(centres, edges, [_kmeans(rest[:, a:b], min(codes, len(x))) for a, b in zip(edges, edges[1:])])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of every vector and its squared distance to every centroid."""
        d = (x ** 2).sum(1)[:, None] + (self.centres ** 2).sum(1) - 2 * x @ self.centres.T
        return d.argmin(axis=1), d

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the length of the coding error."""
        rest = x - self.centres[cell]
        codes = np.empty((len(x), len(self.books)), dtype=np.uint8)
        error = np.zeros(len(x))
        for s, (a, b, book) in enumerate(zip(self.edges, self.edges[1:], self.books)):
            codes[:, s] = np.argmin((book ** 2).sum(1) - 2 * rest[:, a:b] @ book.T, axis=1)
            error += ((rest[:, a:b] - book[codes[:, s]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def probes(self, cell: int, d: np.ndarray, radius: float) -> np.ndarray:
        """Cells in which some of the vectors (distances ``d``) of a cell can
        have a neighbour within the radius."""
        gaps = np.sqrt(((self.centres - self.centres[cell]) ** 2).sum(1))
        return np.flatnonzero(((d - d[:, [cell]]) <= 2 * radius * gaps + SLACK).any(axis=0))

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to coded vectors of one cell."""
        rest = q - self.centres[cell]
        out = np.zeros((len(q), len(codes)))
        for s, (a, b, book) in enumerate(zip(self.edges, self.edges[1:], self.books)):
            part = rest[:, a:b]
            table = (part ** 2).sum(1)[:, None] + (book ** 2).sum(1) - 2 * part @ book.T
            out += table[:, codes[:, s]]
        return np.sqrt(np.maximum(out, 0))


def usable(vec: str) -> F.Column:
    """Vectors that can link: no null or non-finite component, not all zero."""
    c = F.col(vec)
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(c.isNotNull() & F.forall(c, ok) & F.exists(c, lambda x: x != 0), F.lit(False))


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))


def _pair_links(a: dict, b: dict, same: bool, index: Index, threshold: float):
    """Linked pairs of two blocks as a boolean matrix."""
    radius = np.sqrt(max(0.0, 2 - 2 * threshold))
    near = index.distances(a["x"], b["cell"], b["codes"]) <= radius + b["error"] + SLACK
    if same:
        near &= ~np.eye(len(near), dtype=bool)
    i, j = np.nonzero(near)
    for at in range(0, len(i), 65_536):
        p, q = i[at:at + 65_536], j[at:at + 65_536]
        near[p, q] = (a["x"][p] * b["x"][q]).sum(axis=1) >= threshold
    return near


def link_vectors(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding",
                 group_col: str = "label", cells: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    Vectors link if their ``group_col`` is equal and not null, their lengths
    are equal, and their cosine is at least ``threshold``.  Vectors that are
    null, zero, or hold a null or non-finite component link with nothing, as
    do vectors with a null id.  Repeated rows count once; an empty table gives
    no rows; other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("grp"),
                     F.col(vec_col).alias("vec"))
    rows = rows.withColumn("usable", usable("vec") & F.col("grp").isNotNull() & F.col("id").isNotNull())
    rows = rows.withColumn("key", F.when(F.col("usable"), F.sha2(F.concat_ws(",", "vec"), 256)))
    members = materialise(rows.select("id", "grp", "key").distinct(), "vector-members")
    reps = (rows.filter("usable").groupBy("grp", "key")
            .agg(F.min("id").alias("id"), F.first("vec").alias("vec"), F.countDistinct("id").alias("copies")))
    reps = materialise(reps.select("id", "grp", "key", "copies", "vec", F.size("vec").alias("dim")), "vector-reps")
    found = []
    for dim in [r["dim"] for r in reps.select("dim").distinct().orderBy("dim").collect()]:
        found.append(_link_dim(reps.filter(F.col("dim") == dim), threshold, cells))
    pairs = None
    for f in found:
        pairs = f if pairs is None else pairs.unionByName(f)
    if pairs is None:
        pairs = spark.createDataFrame([], "id long, n long, other long")
    links = pairs.filter("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
    comps = connected_components(pairs.filter("other is not null"), "id", "other")
    per_rep = (reps.select("id", "grp", "key", "copies").join(links, "id", "left").join(comps, "id", "left")
               .select("grp", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                       F.coalesce("component", "id").alias("component_id")))
    return (members.join(per_rep, ["grp", "key"], "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))


def _link_dim(reps: DataFrame, threshold: float, cells: int | None) -> DataFrame:
    """Link counts (id, n) and spanning edges (id, other) of vectors of one length."""
    spark = reps.sparkSession
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    largest = reps.groupBy("grp").count().agg(F.max("count")).first()[0]
    cells = cells or int(min(MAX_CELLS, max(1, largest // BLOCK_ROWS)))
    sample = reps.orderBy(F.xxhash64("id")).limit(TRAIN_VECTORS).select("vec").toPandas()
    index = Index.fit(_unit(sample["vec"]), cells)
    shared = spark.sparkContext.broadcast(index)        # at most MAX_CELLS centroids and the codebooks

    def encode(batches):
        for b in batches:
            x = _unit(b["vec"])
            cell, d = shared.value.assign(x)
            codes, error = shared.value.encode(x, cell)
            probes = [shared.value.probes(c, d[[k]], radius).tolist() for k, c in enumerate(cell)]
            yield pd.DataFrame({"id": b["id"], "grp": b["grp"], "copies": b["copies"], "cell": cell,
                                "codes": [r.tobytes() for r in codes], "error": error,
                                "x": [r.tobytes() for r in x], "probes": probes})

    coded = materialise(reps.select("id", "grp", "copies", "vec").mapInPandas(
        encode, "id long, grp string, copies long, cell int, codes binary, error double, x binary, "
                "probes array<int>"), "vector-codes")
    sizes = coded.groupBy("grp", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("parts"))
    salted = coded.join(sizes, ["grp", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = materialise(salted.groupBy("grp", "cell", "part").agg(
        F.collect_list(F.struct("id", "copies", "codes", "error", "x")).alias("rows"),
        F.array_distinct(F.flatten(F.collect_set("probes"))).alias("probes")), "vector-blocks")
    # every pair of blocks once: a block with the blocks of its own and of later cells
    left = blocks.select("grp", "cell", "part", F.explode("probes").alias("other_cell"))
    right = sizes.select("grp", F.col("cell").alias("other_cell"), "parts")
    either = left.select("grp", F.least("cell", "other_cell").alias("cell"),
                         F.greatest("cell", "other_cell").alias("other_cell")).distinct()
    cell_pairs = (either.join(sizes.withColumnRenamed("parts", "own_parts"), ["grp", "cell"])
                  .join(right, ["grp", "other_cell"]))
    pairs = (cell_pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("own_parts") - 1)))
             .withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .filter("cell < other_cell or part <= other_part")
             .select("grp", "cell", "part", "other_cell", "other_part"))
    a = blocks.select("grp", "cell", "part", F.col("rows").alias("a"))
    b = blocks.select("grp", F.col("cell").alias("other_cell"), F.col("part").alias("other_part"),
                      F.col("rows").alias("b"))
    tasks = pairs.join(a, ["grp", "cell", "part"]).join(b, ["grp", "other_cell", "other_part"])

    def unpack(rows, cell):
        x = np.stack([np.frombuffer(r["x"], dtype=np.float64) for r in rows])
        return {"id": np.array([r["id"] for r in rows]), "copies": np.array([r["copies"] for r in rows]),
                "codes": np.stack([np.frombuffer(r["codes"], dtype=np.uint8) for r in rows]),
                "error": np.array([r["error"] for r in rows]), "x": x, "cell": cell}

    def search(batches):
        for batch in batches:
            for t in batch.itertuples(index=False):
                same = t.cell == t.other_cell and t.part == t.other_part
                one, two = unpack(t.a, t.cell), unpack(t.b, t.other_cell)
                near = _pair_links(one, two, same, shared.value, threshold)
                if not near.any():
                    continue
                counts = [(one["id"], near @ two["copies"])]
                if not same:
                    counts.append((two["id"], one["copies"] @ near))
                ids = np.concatenate([one["id"], two["id"]])
                p, q = spanning_links(near)
                edges = pd.DataFrame({"id": ids[p], "other": ids[q]}).query("id != other")
                n = pd.DataFrame({"id": np.concatenate([i for i, _ in counts]),
                                  "n": np.concatenate([c for _, c in counts])}).query("n > 0")
                yield pd.concat([n.assign(other=pd.NA), edges.assign(n=pd.NA)])[["id", "n", "other"]].astype(
                    {"n": "Int64", "other": "Int64"})

    return materialise(tasks.select("cell", "part", "other_cell", "other_part", "a", "b").mapInPandas(
        search, "id long, n long, other long"), "vector-links")
