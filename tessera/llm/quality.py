"""Quality classifier: regularised quadratic discriminant analysis.

Each text is reduced to a few statistics (``FEATURES``), log-transformed so
that they are closer to normal.  A class is a Gaussian whose covariance is
shrunk first toward the pooled covariance and then toward a multiple of the
identity, so it stays positive definite for rare classes and constant
statistics.  The Cholesky factors are computed once at fitting; the score of a
text is the logistic of the difference of the two log densities (Mahalanobis
distances and log determinants) plus the log prior odds.

The statistics are computed in one pass without any exchange; the fit needs
per class only counts, sums and products, which Spark adds up over all
labelled rows before two short rows reach the driver.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Digits are no statistic: numbers and keys occur in good and bad texts alike.
FEATURES = ["log_words", "word_chars", "adjacent_repeats", "distinct_words", "upper_letters", "marks",
            "symbol_runs", "bare_tokens", "line_repeats"]
_RUN = re.compile(r"([^\w\s])\1+")


@lru_cache(1)
def _classes() -> np.ndarray:
    """0 other, 1 lower or caseless letter, 2 upper letter, 3 digit, 4 white space, 5 mark."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for i in range(0x30000):
        c = chr(i)
        out[i] = (2 if c.isupper() else 1) if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 5
    out[0x30000:] = 5
    return out


def text_statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; null counts as empty."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = np.bincount(_classes()[codes], minlength=6)
    words = text.split()
    k, chars, letters = len(words), max(len(text) - int(n[4]), 1), max(int(n[1] + n[2]), 1)
    lines = [x for x in text.split("\n") if x]
    # every share starts from a usual rate with the weight of a few words (or
    # letters, lines), so that one capital does not mark a text of three words
    share = lambda a, b, rate, weight: np.log((a + rate * weight) / (b + weight))
    bare = sum(1 for w in words if len(w) == 1 and not w.isalnum()) if n[5] else 0
    return [np.log(k + 10.0), share(chars, k, 6.0, 10), share(sum(map(eq, words, words[1:])), k, 0.01, 10),
            share(len(set(words)), k ** 0.8, 1.0, 10), share(int(n[2]), letters, 0.03, 60),
            share(int(n[5]), chars, 0.03, 120), share(len(_RUN.findall(text)) if n[5] else 0, k, 0.01, 30),
            share(bare, k, 0.01, 30), share(len(lines) - len(set(lines)), len(lines), 0.05, 5)]


@dataclass
class Model:
    """Class means, inverse Cholesky factors and log-density offsets; a
    ``constant`` score stands for training data without two classes."""
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: np.ndarray | None = None
    whiten: np.ndarray | None = None
    offsets: np.ndarray | None = None
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        density = [o - 0.5 * (((z - m) @ w.T) ** 2).sum(axis=1)
                   for m, w, o in zip(self.means, self.whiten, self.offsets)]
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one column per statistic) of every row."""
    kind = df.select(id_col).schema.simpleString()[7:-1].replace(":", " ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([text_statistics(t) for t in b[text_col]], columns=FEATURES)
            out.insert(0, id_col, b[id_col].array)
            yield out

    return df.select(id_col, text_col).mapInPandas(run, ", ".join([kind, *(f"{f} double" for f in FEATURES)]))


def fit(statistics: DataFrame, label_col: str, to_pooled: float = 0.2, to_identity: float = 0.02) -> Model:
    """Fit on every row of ``statistics`` whose label is 0 or 1 (others, null
    included, are left out).  With rows of one class only the score is that
    class for all texts; without rows it is 0.5."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = (statistics.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).alias("y")).agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)),
        *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs))).collect()
    if len(rows) < 2:
        return Model(constant=float(rows[0]["y"]) if rows else 0.5)
    n, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows:
        y = int(r["y"])
        n[y] = r["n"]
        sums[y] = [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            products[y, i, j] = products[y, j, i] = r[f"p{i}_{j}"]
    total = n.sum()
    centre = sums.sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diag(products.sum(axis=0)) / total - centre ** 2, 1e-6))
    means = (sums / n[:, None] - centre) / scale
    cov = np.stack([(products[y] / n[y] - np.outer(sums[y], sums[y]) / n[y] ** 2) / np.outer(scale, scale)
                    for y in (0, 1)])
    pooled = (n[:, None, None] * cov).sum(axis=0) / total
    whiten, offsets = [], []
    for y in (0, 1):
        s = (1 - to_pooled) * cov[y] + to_pooled * pooled
        s = (1 - to_identity) * s + to_identity * np.trace(s) / d * np.eye(d)
        lower = np.linalg.cholesky(s + 1e-9 * np.eye(d))
        whiten.append(np.linalg.inv(lower))
        offsets.append(np.log(n[y] / total) - np.log(np.diag(lower)).sum())
    return Model(centre, scale, means, np.stack(whiten), np.array(offsets))


def score_statistics(model: Model) -> Column:
    """The score of rows that hold the statistics."""
    @F.pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.column_stack([c.to_numpy() for c in cols])))
    return run(*FEATURES)


def score_text(model: Model, text: str | Column) -> Column:
    """The score of a text column, statistics included."""
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([text_statistics(t) for t in texts]).reshape(-1, len(FEATURES))))
    return run(text)
