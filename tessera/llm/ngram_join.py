"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Texts become sets of word n-grams (lower-cased runs of word characters; a
text of fewer words is one n-gram of all of them).  Equal word sequences are
one representative with a count of its copies, so copies are never compared.

Forest: in each of ``TREES`` trees a text stands at the label of ``DEPTH``
MinHash values; the labels of a tree, sorted, are its prefix trie.  Texts are
matched by the whole label first, and the matched prefix is then shortened
value by value, down to the length ``shortest_prefix`` at which a pair right at
the threshold is met in some tree with the target recall, ``1 - (1 - threshold
** d) ** TREES``.  Shortening is adaptive: only texts of a trie node that
longer prefixes have not joined yet are compared again.  (Spark groups texts by
tree and shortest prefix, a task holds the subtrie below it in sorted order.)
A match is a candidate if the whole signatures (eight bits a value) and the set
sizes come near the threshold.  Nodes larger than a block are compared block
against block.

Verification: candidate edges are joined to components, and inside a component
the exact Jaccard similarity of every pair is computed from the full n-gram
sets, block against block.  It returns link counts and the edges of a spanning
forest, so a group of thousands of near copies gives thousands of rows, not
millions.  Two texts of different length ratio than the threshold are skipped
without loss.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.components import connected_components, spanning_links
from tessera.llm.warc import small_or_shuffled

TREES, DEPTH = 16, 6
NODE_BLOCK = 1024           # texts of a trie node that are compared at once
SET_BLOCK = 128             # texts whose n-gram sets are compared at once
SMALL_GROUP = 8
COLUMNS = 16_384            # n-grams of an incidence block
_WORDS = re.compile(r"\w+")


class _WordHashes(dict):
    """64-bit hashes of words; started anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
        return h


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def ngrams(words: list[str], n: int, memo: dict) -> np.ndarray:
    """Sorted distinct n-gram hashes; no words give none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(n, len(words))
    out = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - n + 1 + i]
    return np.unique(_mix(out))


def _parameters(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    top = np.iinfo(np.uint64).max
    return rng.integers(0, top, count, dtype=np.uint64) | np.uint64(1), rng.integers(0, top, count, dtype=np.uint64)


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(grams), 1024):
        part = grams[i:i + 1024]
        h = ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).astype(np.uint32)
        out = np.minimum(out, h.min(axis=1))
    return out


def shortest_prefix(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """How far prefixes must be shortened: the longest length that still meets
    a pair at the threshold with the target recall, one value if none does."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold ** d) ** trees >= recall:
            return d
    return 1


def _signatures(df: DataFrame, n: int, depth: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, size, prefixes, sig): the key names the word sequence."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, (a, b) = _WordHashes(), _parameters(TREES * DEPTH)
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"]):
                words = words_of(text)
                grams = ngrams(words, n, memo)
                if not len(grams):
                    rows.append((i, None, 0, [], b""))
                    continue
                sig = signature(grams, a, b)
                tree = sig.reshape(TREES, DEPTH)[:, :depth].astype(np.uint64)
                prefix = np.zeros(TREES, dtype=np.uint64)
                for d in range(depth):
                    prefix = _mix(prefix * np.uint64(31) + tree[:, d] + np.uint64(1))
                key = blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=20).hexdigest()
                rows.append((i, key, len(grams), prefix.astype(np.int64), (sig & np.uint32(255)).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["id", "key", "size", "prefixes", "sig"]).astype({"id": "Int64"})

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, "id long, key string, size long, prefixes array<long>, sig binary")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows with the starts of their groups; the last group of a batch
    waits for the next batch."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        starts = _starts(rows, keys)
        rest = rows.iloc[starts[-1]:]
        if starts[-1]:
            yield rows.iloc[:starts[-1]], starts[:-1]
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True), np.zeros(1, dtype=int)


def _starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(rows), dtype=bool)
    new[:1] = True
    for k in keys:
        v = rows[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _trie_edges(sig: np.ndarray, size: np.ndarray, label: np.ndarray, side: np.ndarray, depth: int, threshold: float,
                least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (rows) that connect the candidates of one trie node: along the
    sorted labels first, then under ever shorter prefixes, between texts that
    are not connected yet (of a pair of blocks, texts of different sides)."""
    order = np.lexsort(label.T[::-1])
    sig, size, label, side = sig[order], size[order], label[order], side[order]
    both = side.any()
    joined = ((sig[1:] == sig[:-1]).sum(axis=1) >= least) & (
        np.minimum(size[1:], size[:-1]) >= threshold * np.maximum(size[1:], size[:-1]))
    at = np.flatnonzero(joined)
    yield order[at], order[at + 1]
    part = np.concatenate([[0], np.cumsum(~joined)])        # the part each text is connected to
    for length in range(label.shape[1], depth - 1, -1):
        if not part.any():
            return
        cut = np.flatnonzero((label[1:, :length] != label[:-1, :length]).any(axis=1)) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(order)]):
            if e - s < 2 or (part[s:e] == part[s]).all():
                continue
            one = np.flatnonzero(side[s:e] == 0) + s
            two = np.flatnonzero(side[s:e] == 1) + s if both else one
            if not len(one) or not len(two):
                continue
            equal = np.zeros((len(one), len(two)), dtype=np.uint16)
            for c in range(sig.shape[1]):
                equal += sig[one, c][:, None] == sig[two, c][None, :]
            a, b = size[one][:, None], size[two][None, :]
            near = (equal >= least) & (np.minimum(a, b) >= threshold * np.maximum(a, b)) & (
                part[one][:, None] != part[two][None, :])
            if not near.any():
                continue
            p, q = spanning_links(near)
            members = np.concatenate([one, two])
            p, q = members[p], members[q]
            yield order[p], order[q]
            names = np.arange(part.max() + 1)
            while True:                          # the smallest part that the new edges reach
                to = names.copy()
                np.minimum.at(to, part[p], names[part[q]])
                np.minimum.at(to, part[q], names[part[p]])
                if (to == names).all():
                    break
                names = to
            part = names[part]


def _node_edges(batches: Iterator[pd.DataFrame], threshold: float, depth: int) -> Iterator[pd.DataFrame]:
    """Candidate edges inside the trie nodes (or pairs of their blocks)."""
    low = threshold - 4 * math.sqrt(threshold * (1 - threshold) / (TREES * DEPTH))
    least = TREES * DEPTH * (low * 255 / 256 + 1 / 256)
    for rows, starts in _groups(batches, ["tree", "prefix", "x", "y"]):
        sig = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint8).reshape(len(rows), -1)
        ids, size, tree, side = (rows[c].to_numpy() for c in ("id", "size", "tree", "side"))
        ends = np.append(starts[1:], len(rows))
        group = np.repeat(np.arange(len(starts)), ends - starts)
        small = np.repeat(ends - starts <= SMALL_GROUP, ends - starts)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for step in range(1, SMALL_GROUP):
            i = np.flatnonzero(small[:-step] & (group[step:] == group[:-step])) if len(rows) > step else np.empty(0, int)
            if not len(i):
                break
            j = i + step
            ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
            ok[ok] = (sig[i[ok]] == sig[j[ok]]).sum(axis=1) >= least
            found.append((ids[i[ok]], ids[j[ok]]))
        for s, e in zip(starts, ends):
            if e - s <= SMALL_GROUP:
                continue
            label = sig[s:e, tree[s] * DEPTH:(tree[s] + 1) * DEPTH]
            found += [(ids[s:e][p], ids[s:e][q]) for p, q in _trie_edges(
                sig[s:e], size[s:e], label, side[s:e], depth, threshold, least)]
        if found:
            yield pd.DataFrame({"a": np.concatenate([f[0] for f in found]),
                                "b": np.concatenate([f[1] for f in found])}).query("a != b")


def _set_links(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity of rows ``one`` and ``two`` reaches the threshold."""
    size = np.array([len(s) for s in sets])
    if len(one) == 1 and len(two) == 1:
        shared = np.array([[len(np.intersect1d(sets[one[0]], sets[two[0]], assume_unique=True))]])
    else:
        grams, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        shared = np.zeros((len(one), len(two)))
        for at in range(0, len(grams), COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS])
            held = np.zeros((len(sets), min(COLUMNS, len(grams) - at)), dtype=np.float32)
            held[row[lo:hi], column[lo:hi] - at] = 1
            shared += held[one] @ held[two].T
    union = size[one][:, None] + size[two][None, :] - shared
    return shared >= threshold * union - 1e-9


def _verified(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for rows, starts in _groups(batches, ["component", "x", "y"]):
        ends = np.append(starts[1:], len(rows))
        ids, side, copies = rows["id"].to_numpy(), rows["side"].to_numpy(), rows["copies"].to_numpy()
        grams = rows["grams"].to_numpy()
        counts, edges = [], []
        for s, e in zip(starts, ends):
            if e - s < 2:
                continue
            sets = [np.frombuffer(g, dtype=np.uint64) for g in grams[s:e]]
            one, two = np.flatnonzero(side[s:e] == 0), np.flatnonzero(side[s:e] == 1)
            same = not len(two)
            if same and len(one) == 2:
                one, two, same = one[:1], one[1:], False
            two = one if same else two
            if not len(one):
                continue
            near = _set_links(sets, one, two, threshold)
            if same:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            i, c = ids[s:e], copies[s:e]
            counts.append((i[one], near @ c[two]))
            if not same:
                counts.append((i[two], c[one] @ near))
            p, q = spanning_links(near)
            members = np.concatenate([i[one], i[two]])
            edges.append((members[p], members[q]))
        if counts:
            n = pd.DataFrame({"id": np.concatenate([x for x, _ in counts]),
                              "n": np.concatenate([x for _, x in counts])}).query("n > 0")
            ed = pd.DataFrame({"id": np.concatenate([x for x, _ in edges]),
                               "other": np.concatenate([x for _, x in edges])}).query("id != other")
            yield pd.concat([n.assign(other=pd.NA), ed.assign(n=pd.NA)])[["id", "n", "other"]].astype(
                {"n": "Int64", "other": "Int64"})


def _block_pairs(df: DataFrame, count: str, block: int, keys: list[str]) -> DataFrame:
    """Every row once per pair of blocks of its group that its own block is in:
    ``x <= y`` name the pair, ``side`` says which of the two the row is of."""
    parts = F.ceil(F.col(count) / F.lit(block)).cast("int")
    return (df.withColumn("parts", parts)
            .withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
            .withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("x", F.least("own", "other_part")).withColumn("y", F.greatest("own", "other_part"))
            .withColumn("side", (F.col("own") > F.col("other_part")).cast("int"))
            .repartition(*keys, "x", "y").sortWithinPartitions(*keys, "x", "y", "id"))


def link_texts(df: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9995,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links, copies) of every text.

    ``n_links`` counts the other texts whose n-gram sets have a Jaccard
    similarity of at least ``threshold`` (equal texts included), ``class_id``
    is the smallest id that links reach, ``copies`` the number of texts with
    the same words.  A text without words (null, empty, marks only) or with a
    null id links with nothing and is a class of its own.  Repeated rows count
    once; different texts under one id are one node of the links; other columns
    are ignored; an empty table gives no rows.
    """
    depth = shortest_prefix(threshold, recall)
    signed = materialise(_signatures(df, n, depth, id_col, text_col), "ngram-signatures")
    members = signed.select("id", "key").distinct()
    alive = signed.filter("id is not null and key is not null")
    reps = materialise(alive.groupBy("key").agg(
        F.min("id").alias("id"), F.first("size").alias("size"), F.first("sig").alias("sig"),
        F.first("prefixes").alias("prefixes")).join(
            members.filter("id is not null").groupBy("key").agg(F.count(F.lit(1)).alias("copies")), "key"),
        "ngram-representatives")

    # trie nodes with company, then candidate edges inside them
    light = reps.select("id", F.posexplode("prefixes").alias("tree", "prefix"))
    nodes = light.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("node_size")).filter("node_size > 1")
    met = light.join(nodes, ["tree", "prefix"]).join(reps.select("id", "size", "sig"), "id")
    pairs = _block_pairs(met, "node_size", NODE_BLOCK, ["tree", "prefix"])
    edges = pairs.select("tree", "prefix", "x", "y", "side", "id", "size", "sig").mapInPandas(
        lambda it: _node_edges(it, threshold, depth), "a long, b long")
    comps = connected_components(edges)
    comps = materialise(comps.unionByName(comps.select(F.col("component").alias("id"), "component").distinct()),
                        "ngram-candidates")
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("component_size"))
    wanted = materialise(comps.join(sizes, "component").join(reps.select("id", "key", "copies"), "id"),
                         "ngram-candidates")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _WordHashes()
        for b in batches:
            rows = []
            for row in b.itertuples(index=False):
                words = words_of(row.text)
                if blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=20).hexdigest() == row.key:
                    rows.append((row.id, row.component, row.component_size, row.copies, ngrams(words, n, memo).tobytes()))
            yield pd.DataFrame(rows, columns=["id", "component", "component_size", "copies", "grams"])

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(
        small_or_shuffled(wanted), "id")
    if _has_repeats(signed):
        texts = texts.dropDuplicates(["id", "key", "text"])
    grams = texts.select("id", "text", "key", "component", "component_size", "copies").mapInPandas(
        sets, "id long, component long, component_size long, copies long, grams binary")
    checked = _block_pairs(grams, "component_size", SET_BLOCK, ["component"]).select(
        "component", "x", "y", "side", "id", "copies", "grams").mapInPandas(
        lambda it: _verified(it, threshold), "id long, n long, other long")
    checked = materialise(checked, "ngram-links")
    links = checked.filter("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
    classes = connected_components(checked.filter("other is not null"), "id", "other")
    per_rep = (reps.select("id", "key", "copies").join(links, "id", "left").join(classes, "id", "left")
               .select("key", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                       F.coalesce("component", "id").alias("class_id")))
    linkable = members.filter("id is not null and key is not null").join(per_rep, "key").select(
        F.col("id").alias(id_col), "class_id", F.col("n_links").cast("long").alias("n_links"), "copies")
    alone = members.filter("id is null or key is null").select(
        F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(1).cast("long").alias("copies"))
    return linkable.unionByName(alone)


def _has_repeats(signed: DataFrame) -> bool:
    """Whether some (id, key) occurs in more than one row."""
    return not signed.groupBy("id", "key").count().filter("count > 1").isEmpty()
