"""Quality rules: a decision list learned by sequential covering.

Every text is reduced to counts (``with_counts``) and to the statistics made
of them (``FEATURES``); no step leaves the JVM.  ``learn`` covers the rarer
class of the labelled rows rule by rule.  A rule grows by the threshold that
gains most information on the rows that no earlier rule holds, is pruned back
to the prefix that does best on rows set aside, and stays if it is precise
enough there; the first rule that is not ends the list.  The list becomes one
ordered conditional SQL expression over the statistics, which Spark evaluates
for all documents without a further exchange.

Each growing step is one grouped count over the labelled rows (feature,
interval, label), so the driver sees counts only, at most ``2 * cuts + 1``
intervals per feature.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import once
from tessera.llm.common import materialise

BLANKS = " \\t-\\r"
SYMBOLS = "[#*$%&|<>]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stops"]
# the statistics that rules may test, as SQL over the counts
FEATURES = {
    "words": "n_words",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def with_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts) of every whole text, null as empty.

    Words are runs of anything but space and the controls from tab to carriage
    return.  A repeated word lies in a window of three words that occurs twice
    or more in its text: windows are sorted by a hash, neighbours of equal
    hash are compared word by word.  ``n_stops`` counts ``!`` and ``?``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = df.select(F.col(id_col), text.alias("t"))
    d = d.select(id_col, "t", once(F.array_remove(F.split("t", f"[{BLANKS}]+"), "")).alias("ws"),
                 once(F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]"))).alias("ls"))
    n = F.size("ws")
    word = lambda i, k: F.get("ws", i + k)
    windows = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(word(i, 0), word(i, 1), word(i, 2)).alias("h"), i.alias("i"))))).otherwise(F.expr("array()"))
    d = d.select(id_col, "ws", n.cast("long").alias("n_words"),
                 F.aggregate("ws", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
                 F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                 (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
                 F.size("ls").cast("long").alias("n_lines"), F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
                 F.regexp_count("t", F.lit("[!?]")).cast("long").alias("n_stops"), once(windows).alias("s"))

    def same(x: Column, j: Column) -> Column:
        y = F.get("s", j)
        words = [word(x["i"], k) == word(y["i"], k) for k in range(3)]
        return F.coalesce((x["h"] == y["h"]) & words[0] & words[1] & words[2], F.lit(False))

    found = F.transform(F.filter("s", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])
    d = d.select(id_col, *(c for c in COUNTS if c != "n_repeat_words"), once(F.sort_array(found)).alias("p"))
    covered = F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))),
                         lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    repeated = F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long")
    return d.withColumn("n_repeat_words", repeated).select(id_col, *COUNTS)


def with_features(counts: DataFrame) -> DataFrame:
    """``counts`` with the statistics as doubles."""
    return counts.select("*", *(F.expr(sql).cast("double").alias(name) for name, sql in FEATURES.items()))


@dataclass
class Rule:
    """A conjunction of ``feature > cut`` and ``feature <= cut``."""
    conditions: list[tuple[str, str, float]]
    verdict: bool
    covered: int = 0        # rows set aside that it holds, and the right ones among them
    right: int = 0

    def sql(self) -> str:
        """The conjunction; of several cuts one way on a statistic the tightest."""
        tight: dict[tuple[str, str], float] = {}
        for f, op, cut in self.conditions:
            old = tight.get((f, op), cut)
            tight[f, op] = max(old, cut) if op == ">" else min(old, cut)
        return " AND ".join(f"{f} {op} {cut!r}D" for (f, op), cut in tight.items())


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)
    default: bool = True

    def sql(self) -> str:
        """The ordered conditional expression."""
        if not self.rules:
            return str(self.default).lower()
        cases = " ".join(f"WHEN {r.sql()} THEN {str(r.verdict).lower()}" for r in self.rules)
        return f"CASE {cases} ELSE {str(self.default).lower()} END"

    def verdict(self) -> Column:
        return F.expr(self.sql())


def _holds(conditions: list[tuple[str, str, float]]) -> Column:
    out = F.lit(True)
    for f, op, cut in conditions:
        out = out & F.coalesce(F.col(f) > cut if op == ">" else F.col(f) <= cut, F.lit(False))
    return out


def _best_condition(rows: DataFrame, scope: Column, features: list[str], cuts: dict[str, list[float]], target: int,
                    min_cover: int):
    """The threshold with the largest information gain for ``target`` within
    ``scope``: (gain, condition), or None."""
    cells = [F.struct(F.lit(-1).alias("f"), F.lit(0).alias("b"))]
    cells += [F.struct(F.lit(i).alias("f"), F.col(f"bin_{i}").alias("b")) for i in range(len(features))]
    found = (rows.filter(scope & F.col("grow")).select(F.explode(F.array(*cells)).alias("c"), "y")
             .groupBy("c.f", "c.b", "y").count().collect())
    count = {(r["f"], r["b"], r["y"]): r["count"] for r in found}
    p0, n0 = count.get((-1, 0, target), 0), count.get((-1, 0, 1 - target), 0)
    if p0 < min_cover or not n0:
        return None
    best = None
    for i, f in enumerate(features):
        p_all = sum(c for (j, b, y), c in count.items() if j == i and b is not None and y == target)
        n_all = sum(c for (j, b, y), c in count.items() if j == i and b is not None and y != target)
        p_low = n_low = 0
        for b, cut in enumerate(cuts[f]):
            p_low += count.get((i, b, target), 0)
            n_low += count.get((i, b, 1 - target), 0)
            for op, p, n in (("<=", p_low, n_low), (">", p_all - p_low, n_all - n_low)):
                if p < min_cover or (p == p0 and n == n0):
                    continue
                gain = p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, (f, op, cut))
    return best


def learn(table: DataFrame, features: list[str], label_col: str, cuts: int = 32, max_conditions: int = 4,
          max_rules: int = 12, min_cover: int = 5, min_precision: float = 0.9, max_rows: int = 200_000) -> DecisionList:
    """A decision list for the verdict "label is 1".

    Rows with another label than 0 or 1, null included, are left out; a null
    statistic meets no condition.  Of more than ``max_rows`` labelled rows a
    share with about so many is used, chosen by a hash of the statistics.
    Candidate thresholds lie midway between neighbours among the least value
    and ``cuts`` quantiles of each class; a third of the rows, chosen by the same hash, is set aside for pruning.  Without rows of
    both classes there are no rules: the verdict is the only class, true
    without any rows."""
    y = F.col(label_col).cast("int")
    rows = table.filter(y.isin(0, 1)).select(*(F.col(f).cast("double").alias(f) for f in features), y.alias("y"))
    key = F.xxhash64(*features)
    rows = materialise(rows.withColumn("grow", F.pmod(key, F.lit(3)) != 0), "rule-rows")
    by_class = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    total = sum(by_class.values())
    if len(by_class) < 2:
        return DecisionList([], not by_class or 1 in by_class)
    if total > max_rows:
        share = max_rows / total
        rows = rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)))
    target = min(by_class, key=lambda c: (by_class[c], c))
    points = [(k + 1) / (cuts + 1) for k in range(cuts)] + [0.0]
    found = rows.groupBy("y").agg(*(F.percentile_approx(f, points, 100_000).alias(f) for f in features)).collect()
    seen = {f: sorted({v for r in found for v in r[f] or []}) for f in features}
    chosen = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in seen.items()}
    below = lambda f: F.size(F.filter(F.array(*map(F.lit, chosen[f])).cast("array<double>"), lambda c: c < F.col(f)))
    bins = [F.when(F.col(f).isNotNull(), below(f)).alias(f"bin_{i}") for i, f in enumerate(features)]
    rows = materialise(rows.select("*", *bins), "rule-bins")
    out = DecisionList([], target == 0)
    left = F.lit(True)
    while len(out.rules) < max_rules:
        conditions: list[tuple[str, str, float]] = []
        while len(conditions) < max_conditions:
            best = _best_condition(rows, left & _holds(conditions), features, chosen, target, min_cover)
            if best is None:
                break
            conditions.append(best[1])
        if not conditions:
            break
        # the prefix that does best on the rows set aside; the shortest of equals
        aside = rows.filter(left & ~F.col("grow")).agg(*(F.count_if(_holds(conditions[:k + 1]) & (F.col("y") == c)).alias(f"n{k}_{c}")
                                                         for k in range(len(conditions)) for c in (0, 1))).first()
        worth = lambda k: ((aside[f"n{k}_{target}"] - aside[f"n{k}_{1 - target}"])
                           / max(aside[f"n{k}_0"] + aside[f"n{k}_1"], 1))
        k = max(range(len(conditions)), key=lambda k: (worth(k), -k))
        right, covered = aside[f"n{k}_{target}"], aside[f"n{k}_0"] + aside[f"n{k}_1"]
        if not covered or right < min_precision * covered:
            break
        out.rules.append(Rule(conditions[:k + 1], target == 1, covered, right))
        left = left & ~_holds(conditions[:k + 1])
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          **learning) -> tuple[DataFrame, DecisionList]:
    """(id, counts, base_failed, kept) of every document, and the list learned
    from the documents that ``labels`` names and the base rule lets pass.  Kept is what neither the fixed
    base rule nor the list rejects.  Repeated rows are judged one by one, equal
    label rows count once, null ids have no label; other columns are ignored."""
    rows = materialise(with_counts(docs, id_col, text_col), "rule-counts")
    train = labels.select(F.col(id_col), F.col(label_col).alias("rule_label")).dropDuplicates()
    rows = with_features(rows).withColumn("base_failed", F.expr(BASE_FAILED))
    model = learn(rows.filter("NOT base_failed").join(train, id_col), list(FEATURES), "rule_label", **learning)
    out = rows.withColumn("kept", ~F.col("base_failed") & model.verdict())
    return out.select(id_col, *COUNTS[:5], "base_failed", "kept"), model
