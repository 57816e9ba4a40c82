"""Language identification with bit-sliced Bloom filters of character n-grams.

All languages share one Bloom filter whose positions hold one bit per language
(in as many 64-bit words as the languages need), so the AND of an n-gram's positions is the set of all languages
that hold it.  A text gives one trigram per letter (the letter and its two
neighbours; anything that is not a letter counts as a word boundary).  Per
language the trigrams of the text are counted, and the count is corrected for
the filter's false positives: with rate p, an expected ``n p`` of ``n``
foreign trigrams look known, so the corrected count is ``(c - n p) / (1 - p)``.
The largest corrected count decides.

Learning counts trigrams per language over all training texts (combined per
task, then summed by Spark).  A language holds a trigram if it makes up at
least ``min_share`` of its trigrams and at least ``ratio`` of the largest
share that any language gives it; ``min_share`` bounds the number of trigrams
per language, and the filter has a fixed number of positions.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
SLICE_CHARS = 1_000_000
FLUSH_GRAMS = 500_000
WORD = 64


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigram of every letter of the texts, as exact 63-bit keys, and the
    number of trigrams of each text."""
    lowered = [t.lower() for t in texts]
    joined = "\n" + "\n".join(lowered) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    is_letter = _letters()[codes]
    codes[~is_letter] = 0
    at = np.flatnonzero(is_letter)
    keys = (codes[at - 1] << np.uint64(42)) | (codes[at] << np.uint64(21)) | codes[at + 1]
    ends = np.cumsum([len(t) + 1 for t in lowered]) + 1
    return keys, np.diff(np.searchsorted(at, ends), prepend=0)


def positions(keys: np.ndarray, bits: int, hashes: int) -> list[np.ndarray]:
    """Filter positions of the keys: two mixed halves, combined linearly."""
    with np.errstate(over="ignore"):
        z = keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        a, b = z & np.uint64(0xFFFFFFFF), (z >> np.uint64(32)) | np.uint64(1)
        mask = np.uint64((1 << bits) - 1)
        return [((a + np.uint64(i) * b) & mask).astype(np.int64) for i in range(hashes)]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    a = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= SLICE_CHARS:
            yield a, i + 1
            a, chars = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


@dataclass
class Model:
    languages: list[str]        # bit order
    default: str                # the language with most training trigrams
    bits: int
    hashes: int
    words: np.ndarray           # language bits: a row per 64 languages, a word per position

    def rates(self) -> np.ndarray:
        """False-positive rate of each language: its fill to the power of the hashes."""
        fill = [float((self.words[k // WORD] >> np.uint64(k % WORD) & np.uint64(1)).mean()) for k in range(len(self.languages))]
        return np.array(fill) ** self.hashes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        rates = self.rates()
        whole = [t or "" for t in texts]
        for i, j in _slices(whole):
            keys, n = trigrams(whole[i:j])
            found = None
            for p in positions(keys, self.bits, self.hashes):
                found = self.words[:, p] if found is None else found & self.words[:, p]
            edges = np.concatenate([[0], np.cumsum(n)])
            corrected = np.zeros((j - i, len(self.languages)))
            for k, p in enumerate(rates):
                sums = np.concatenate([[0], np.cumsum((found[k // WORD] >> np.uint64(k % WORD)) & np.uint64(1))])
                count = sums[edges[1:]] - sums[edges[:-1]]
                corrected[:, k] = np.clip((count - n * p) / max(1 - p, 1e-9), 0, None)
            for r in range(j - i):
                if n[r] == 0 or not self.languages:
                    names.append(UNDETERMINED)
                elif not corrected[r].any():
                    names.append(self.default)
                else:
                    best = int(corrected[r].argmax())
                    names.append(self.languages[best])
                    scores[i + r] = min(1.0, corrected[r, best] / corrected[r].sum())
        return names, scores


def count_trigrams(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n) over all texts with a language, combined per task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def combined() -> pd.DataFrame:
            return pd.concat(held).groupby(["lang", "gram"], as_index=False)["n"].sum()

        for b in batches:
            for lang, part in b.groupby("lang"):
                texts = list(part["text"])
                for i, j in _slices(texts):
                    keys, _ = trigrams(texts[i:j])
                    grams, n = np.unique(keys.astype(np.int64), return_counts=True)
                    held.append(pd.DataFrame({"lang": lang, "gram": grams, "n": n}))
                    size += len(grams)
                if size > FLUSH_GRAMS:
                    held = [combined()]
                    size = len(held[0])
                    if size > FLUSH_GRAMS // 2:
                        yield held[0]
                        held, size = [], 0
        if held:
            yield combined()

    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    return rows.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, lang_col: str = "lang", text_col: str = "text", min_share: float = 2e-6,
        ratio: float = 0.1, bits: int = 20, hashes: int = 4) -> Model:
    """Learn the filters from all rows with a text and a language.

    Without such rows the model knows no language and every text is
    undetermined.  Any number of languages: each 64 take a word per position.
    """
    from tessera.llm.common import materialise
    counts = materialise(count_trigrams(df, lang_col, text_col), "trigrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    sizes = {r["lang"]: r["total"] for r in totals.collect()}           # a row per language
    languages = sorted(sizes)
    slices = -(-len(languages) // WORD)
    if not languages:
        return Model([], UNDETERMINED, bits, hashes, np.zeros((0, 1 << bits), dtype=np.uint64))
    known = df.sparkSession.createDataFrame([(name, k, sizes[name]) for k, name in enumerate(languages)],
                                            "lang string, k int, total long")
    shares = counts.join(F.broadcast(known), "lang").withColumn("share", F.col("n") / F.col("total"))
    kept = (shares.withColumn("top", F.max("share").over(Window.partitionBy("gram")))
            .filter((F.col("share") >= min_share) & (F.col("share") >= ratio * F.col("top")))
            .groupBy("gram", F.floor(F.col("k") / WORD).cast("int").alias("slice"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, k % {WORD})")).alias("mask")))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            where = positions(b["gram"].to_numpy().astype(np.uint64), bits, hashes)
            yield pd.DataFrame({"slice": np.tile(b["slice"].to_numpy(), hashes), "position": np.concatenate(where),
                                "mask": np.tile(b["mask"].to_numpy(), hashes)})

    filled = (kept.mapInPandas(place, "slice int, position long, mask long").groupBy("slice", "position")
              .agg(F.bit_or("mask").alias("mask"))).toPandas()          # at most 2 ** bits rows a slice
    words = np.zeros((slices, 1 << bits), dtype=np.uint64)
    words[filled["slice"].to_numpy(), filled["position"].to_numpy()] = filled["mask"].to_numpy().astype(np.uint64)
    return Model(languages, max(languages, key=lambda x: (sizes[x], x)), bits, hashes, words)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text.  A null text or one without
    a letter is ``und``; a text whose trigrams no language knows gets the
    default language with score 0; ties go to the first language by name."""
    kind = df.select(id_col).schema.simpleString()[7:-1].replace(":", " ")
    shared = df.sparkSession.sparkContext.broadcast(model)              # 2 ** bits words a slice

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names, scores = shared.value.predict(list(b[text_col]))
            yield pd.DataFrame({id_col: b[id_col].array, "lang_pred": names, "score": scores})

    return df.select(id_col, text_col).mapInPandas(run, f"{kind}, lang_pred string, score double")
