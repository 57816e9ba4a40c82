"""Ranked lexical search by per-term geometric blocking.

A document's weight for a term is ``w * ((10^9 tf) div (1000 tf + 8 m))``, its
score for an item the sum over the item's terms, all in 64-bit integers.

Terms are numbered by falling ``w``, over all items alike.  The documents are
ordered by their strongest coordinates, so similar documents are neighbours,
and cut into shards of bounded size.  Inside a shard the posting list of every
term is clustered: some of its documents are pivots, every other joins the
pivot it is most similar to (inner product of the weights), and a cluster is a
block.  A block stores the coordinatewise maximum of its documents' weights
over the terms that some item asks together with its own.

A document is scored at the list of the first (strongest) term it shares with
the item.  In the list of term t only the coordinates from t on therefore
count, and their sum over a block's summary bounds every score the block can
give.  A first pass scores each item's most promising block of every shard and
yields the item's k-th score; a second pass skips a block only when its bound
is below that score, and scores the documents of all others.  Nothing is cut
off: the result is that of scoring everything, ties included.

The items are searched in groups of at most about ``GROUP_TERMS`` terms; a
group's terms, weights and k-th scores are sent to every task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

# (item, term) pairs of one group of items, on average; an item is never split
GROUP_TERMS = 200_000
# documents of a shard, cells of its dense matrix (8 bytes each), documents of a block
SHARD_DOCS, SHARD_CELLS, BLOCK_DOCS = 4096, 6_000_000, 64
# leading coordinates by which documents are ordered
LEADING = 3
# characters of texts handled together
SLICE_CHARS = 4_000_000

_SEPARATORS = bytes(i for i in range(128) if not chr(i).isalnum())
_FOLD = bytes(32 if i in _SEPARATORS else i + 32 if 65 <= i <= 90 else i for i in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order: maximal runs of ASCII letters and
    digits and of all characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, term) of every item, each once; the rows of one id are one item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                here = sorted(set(terms(text)))
                ids += [i] * len(here)
                found += here
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(found, pa.binary())],
                                             names=["id", "term"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(id_col, text_col).mapInArrow(run, f"id {kind}, term binary").distinct()


def document_terms(docs: DataFrame, wanted: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, nos, tfs): term count with repeats, numbers and counts of
    the wanted terms, for every document with a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = wanted.value
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            rows, sizes, nos, tfs, chars, ends = [], [], [], [], 0, [0]
            for i, text in enumerate(texts):
                found = terms(text)
                if found:
                    counts = Counter(number[t] for t in found if t in number)
                    nos.extend(counts.keys())
                    tfs.extend(counts.values())
                    rows.append(i)
                    sizes.append(len(found))
                    ends.append(len(nos))
                    chars += len(text)
                if rows and (chars > SLICE_CHARS or i == len(texts) - 1):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()),
                         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(nos, pa.int32())),
                         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tfs, pa.int64()))],
                        names=["doc_id", "n", "nos", "tfs"])
                    rows, sizes, nos, tfs, chars, ends = [], [], [], [], 0, [0]

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(
        run, "doc_id long, n long, nos array<int>, tfs array<long>")


@dataclass
class Group:
    """Items of one group: per item its term numbers, rising; per term the
    terms from it on that some item asks together with it."""
    ids: list
    asked: list[np.ndarray]
    partners: dict[int, np.ndarray]


def _group(ids: list, asked: list[np.ndarray]) -> Group:
    together: dict[int, list[np.ndarray]] = {}
    for nos in asked:
        for j, t in enumerate(nos.tolist()):
            together.setdefault(t, []).append(nos[j:])
    return Group(ids, asked, {t: np.unique(np.concatenate(x)) for t, x in together.items()})


def weighted(found: DataFrame, weights: Broadcast, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, lead_1.., nos, impacts): the weights of a document's terms by
    rising number, and its strongest coordinates, for documents with any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, w = weights.value
        for b in batches:
            if not b.num_rows:
                continue
            nos = number[b.column("nos").flatten().to_numpy()]
            tfs = b.column("tfs").flatten().to_numpy()
            sizes = b.column("nos").value_lengths().to_numpy().astype(np.int64)
            n = b.column("n").to_numpy()
            m = 10 + (90 * n * n_docs) // n_terms
            row = np.repeat(np.arange(b.num_rows), sizes)
            impact = w[nos] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[row]))
            lead = np.full((b.num_rows, LEADING), -1)
            strongest = np.lexsort((nos, -impact, row))
            starts = np.cumsum(sizes) - sizes
            for k in range(LEADING):
                has = sizes > k
                lead[has, k] = nos[strongest[starts[has] + k]]
            order = np.lexsort((nos, row))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(lead[:, k], pa.int32()) for k in range(LEADING)),
                 pa.ListArray.from_arrays(ends, pa.array(nos[order], pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(impact[order], pa.int64()))],
                names=["doc_id", *(f"lead_{k}" for k in range(LEADING)), "nos", "impacts"])

    leads = ", ".join(f"lead_{k} int" for k in range(LEADING))
    return found.filter("size(nos) > 0").mapInArrow(
        run, f"doc_id long, {leads}, nos array<int>, impacts array<long>")


SHARD_SCHEMA = ("doc_ids array<long>, ends array<int>, nos array<int>, impacts array<long>, lists array<int>, "
                "list_blocks array<int>, block_docs array<int>, members array<int>, maxima array<long>")


def _shard(ids: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], group: Group, block: int) -> dict:
    """Blocks and summaries of one shard: per list (term) its number of
    blocks, per block its number of documents, their places, and the maxima
    over the list's partners, block after block."""
    ends = np.cumsum([0] + [len(v[0]) for v in vectors])
    nos, impacts = np.concatenate([v[0] for v in vectors]), np.concatenate([v[1] for v in vectors])
    dense, columns = _dense(ends, nos, impacts)
    of_row = np.repeat(np.arange(len(ids)), np.diff(ends))
    by_term = np.lexsort((of_row, nos))
    cuts = np.searchsorted(nos[by_term], np.append(columns, columns[-1] + 1))
    lists, list_blocks, block_docs, members, maxima = [], [], [], [], []
    for c, t in enumerate(columns.tolist()):
        here = of_row[by_term[cuts[c]:cuts[c + 1]]]
        partner = group.partners[t]
        place = np.searchsorted(columns, partner)
        there = (place < len(columns)) & (columns[np.minimum(place, len(columns) - 1)] == partner)
        part = np.zeros((len(here), len(partner)), dtype=np.int64)
        part[:, there] = dense[np.ix_(here, place[there])]
        n = -(-len(here) // block)
        if n > 1:
            like = part.astype(np.float32)
            pivots = like[np.linspace(0, len(here) - 1, n).astype(int)]
            own = (like @ pivots.T).argmax(axis=1)
            order = np.argsort(own, kind="stable")
            sizes = np.bincount(own, minlength=n)
            sizes = sizes[sizes > 0]
            here, part = here[order], part[order]
        else:
            sizes = np.array([len(here)])
        starts = np.cumsum(sizes) - sizes
        lists.append(t)
        list_blocks.append(len(sizes))
        block_docs.append(sizes)
        members.append(here)
        maxima.append(np.maximum.reduceat(part, starts, axis=0).ravel())
    return {"doc_ids": ids, "ends": ends, "nos": nos, "impacts": impacts, "lists": lists, "list_blocks": list_blocks,
            "block_docs": np.concatenate(block_docs), "members": np.concatenate(members), "maxima": np.concatenate(maxima)}


def _dense(ends: np.ndarray, nos: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    columns, place = np.unique(nos, return_inverse=True)
    out = np.zeros((len(ends) - 1, len(columns)), dtype=np.int64)
    out[np.repeat(np.arange(len(ends) - 1), np.diff(ends)), place] = impacts
    return out, columns


def build_shards(vectors: DataFrame, group: Broadcast, shard_docs: int, block_docs: int) -> DataFrame:
    """One row per shard of neighbouring documents, with its blocks."""
    leads = [f"lead_{k}" for k in range(LEADING)]
    # the id last: any number of copies spreads over partitions and shards
    placed = vectors.repartitionByRange(*leads, "doc_id").sortWithinPartitions(*leads, "doc_id")
    types = {f.split()[0]: pa.list_(pa.int64() if "long" in f else pa.int32()) for f in SHARD_SCHEMA.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            made = _shard(ids, held, group.value, block_docs)
            return pa.RecordBatch.from_arrays([pa.array([np.asarray(made[c])], type=t) for c, t in types.items()], names=list(types))

        ids, held, present = [], [], set()
        for b in batches:
            ends = np.concatenate([[0], np.cumsum(b.column("nos").value_lengths().to_numpy())]).astype(np.int64)
            nos, impacts = b.column("nos").flatten().to_numpy(), b.column("impacts").flatten().to_numpy()
            for i, doc_id in enumerate(b.column("doc_id").to_pylist()):
                part = nos[ends[i]:ends[i + 1]]
                more = present.union(part.tolist())
                if ids and (len(ids) >= shard_docs or (len(ids) + 1) * len(more) > SHARD_CELLS):
                    yield row()
                    ids, held, more = [], [], set(part.tolist())
                present = more
                ids.append(doc_id)
                held.append((part, impacts[ends[i]:ends[i + 1]]))
        if ids:
            yield row()

    return placed.select("doc_id", "nos", "impacts").mapInArrow(run, SHARD_SCHEMA)


class _Open:
    """A shard row ready for search."""

    def __init__(self, row: dict, group: Group):
        self.ids = row["doc_ids"]
        self.dense, self.columns = _dense(row["ends"], row["nos"], row["impacts"])
        self.lists: dict[int, tuple] = {}
        block, member, cell = 0, 0, 0
        for t, n in zip(row["lists"].tolist(), row["list_blocks"].tolist()):
            sizes = row["block_docs"][block:block + n]
            width = len(group.partners[t])
            self.lists[t] = (np.concatenate([[0], np.cumsum(sizes)]) + member,
                             row["maxima"][cell:cell + n * width].reshape(n, width))
            block, member, cell = block + n, member + int(sizes.sum()), cell + n * width
        self.members = row["members"]
        self.group = group

    def bounds(self, asked: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(place in ``asked``, bound of each block) of the lists here."""
        out = []
        for j, t in enumerate(asked.tolist()):
            if t in self.lists:
                maxima = self.lists[t][1]
                out.append((j, maxima[:, np.searchsorted(self.group.partners[t], asked[j:])].sum(axis=1)))
        return out

    def postings(self, asked: np.ndarray, j: int) -> int:
        edges = self.lists[int(asked[j])][0]
        return int(edges[-1] - edges[0])

    def scores(self, asked: np.ndarray, chosen: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the documents of the chosen blocks, each once."""
        rows = []
        for j, blocks in chosen:
            edges = self.lists[int(asked[j])][0]
            rows += [self.members[edges[x]:edges[x + 1]] for x in blocks.tolist()]
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        found = np.unique(np.concatenate(rows))
        place = np.searchsorted(self.columns, asked)
        there = (place < len(self.columns)) & (self.columns[np.minimum(place, len(self.columns) - 1)] == asked)
        return found, self.dense[np.ix_(found, place[there])].sum(axis=1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by falling score, then rising id (null ids first)."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


NULL_ID = -(1 << 63)


def _search_pass(shards: DataFrame, group: Broadcast, floors: Broadcast | None, k: int, counts: bool) -> DataFrame:
    """(item, doc_id, score): each task's best ``k`` documents per item.  With
    no ``floors`` only the block with the largest bound of every shard is
    scored; with them every block whose bound reaches the item's floor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = group.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        work = np.zeros(4, dtype=np.int64)       # blocks, blocks scored, postings, documents scored
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(j)[i].values for j, n in enumerate(b.schema.names)}
                row["doc_ids"] = row["doc_ids"].fill_null(NULL_ID)
                row = {n: v.to_numpy() for n, v in row.items()}
                shard = _Open(row, g)
                for item, asked in enumerate(g.asked):
                    bounds = shard.bounds(asked)
                    if not bounds:
                        continue
                    if floors is None:
                        top = max(x[1].max() for x in bounds)
                        j, values = next(x for x in bounds if x[1].max() == top)
                        chosen = [(j, np.array([int(values.argmax())]))]
                    else:
                        floor = max(int(floors.value[item]), 1)
                        chosen = [(j, np.flatnonzero(v >= floor)) for j, v in bounds]
                        chosen = [x for x in chosen if len(x[1])]
                    rows, scores = shard.scores(asked, chosen)
                    work += [sum(len(x[1]) for x in bounds), sum(len(x[1]) for x in chosen),
                             sum(shard.postings(asked, j) for j, _ in bounds), len(rows)]
                    keep = scores > 0
                    if floors is not None:
                        keep &= scores >= floor
                    if keep.any():
                        ids, new = shard.ids[rows[keep]], scores[keep]
                        if item in held:
                            ids, new = np.concatenate([held[item][0], ids]), np.concatenate([held[item][1], new])
                        held[item] = _best(ids, new, k)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([-1 - i for i in range(4)], pa.int32()), pa.array([0] * 4, pa.int64()),
                                              pa.array(work, pa.int64())], names=["item", "doc_id", "score"])
        for item, (ids, scores) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(ids), pa.int32()), pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(scores, pa.int64())],
                names=["item", "doc_id", "score"])

    return shards.mapInArrow(run, "item int, doc_id long, score long")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", work: dict | None = None,
           group_terms: int = GROUP_TERMS, shard_docs: int = SHARD_DOCS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item, rank, doc id, score): the ``k`` documents with the highest score
    above 0 of every item, equal scores by rising id.

    Null and empty texts have no terms; rows of one item id are one item, a
    null id is an id; document rows that share an id are documents of their
    own.  Ids of documents are cast to long; other columns are ignored.
    ``work`` is filled with the numbers of blocks, of blocks scored, of
    postings and of documents scored of the second pass."""
    spark = docs.sparkSession
    pairs = materialise(item_terms(items, item_col, item_text), "search-items")
    kind = pairs.schema["id"].dataType.simpleString()
    schema = f"{item_col} {kind}, rank int, doc_id long, score long"
    n_groups = -(-pairs.count() // group_terms)
    results = []
    for g in range(n_groups):
        # the pairs of a group: about group_terms, a key and a short term each
        mine = pairs.filter(F.pmod(F.xxhash64("id"), F.lit(n_groups)) == g).collect()
        vocabulary = sorted({bytes(r["term"]) for r in mine})
        number = {t: i for i, t in enumerate(vocabulary)}
        found = materialise(document_terms(docs, spark.sparkContext.broadcast(number), id_col, text_col), "search-terms")
        totals = found.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        n_docs, n_terms = totals["n"], int(totals["l"] or 0)
        if not n_docs:
            continue
        df = {r["no"]: r["df"] for r in found.select(F.explode("nos").alias("no")).groupBy("no").agg(
            F.count(F.lit(1)).alias("df")).collect()}
        w = np.array([int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1)))) for i in range(len(number))])
        rank = np.lexsort((np.arange(len(w)), -w))
        renumber = np.empty(len(w), dtype=np.int64)
        renumber[rank] = np.arange(len(w))
        weights = spark.sparkContext.broadcast((renumber, w[rank].astype(np.int64)))
        ids: dict = {}
        for r in mine:
            ids.setdefault(r["id"], []).append(int(renumber[number[bytes(r["term"])]]))
        group = spark.sparkContext.broadcast(_group(list(ids), [np.array(sorted(x)) for x in ids.values()]))
        shards = materialise(build_shards(weighted(found, weights, n_docs, n_terms), group, shard_docs, block_docs),
                             "search-shards")
        first = _ranked(_search_pass(shards, group, None, k, False), k)
        kth = {r["item"]: r["score"] for r in first.filter(F.col("rank") == k).select("item", "score").collect()}
        floors = spark.sparkContext.broadcast(np.array([kth.get(i, 0) for i in range(len(ids))], dtype=np.int64))
        hits = materialise(_search_pass(shards, group, floors, k, work is not None), "search-hits")
        if work is not None:
            for r in hits.filter("item < 0").groupBy("item").agg(F.sum("score").alias("n")).collect():
                name = ("blocks", "blocks_scored", "postings", "documents_scored")[-1 - r["item"]]
                work[name] = work.get(name, 0) + r["n"]
            hits = hits.filter("item >= 0")
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, {item_col} {kind}")
        results.append(_ranked(hits, k).join(names, "item").select(item_col, F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], schema)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
