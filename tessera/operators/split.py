"""Exact seeded splits (SP1, SP2, WN8) and split sizes (AG6).

Order: ``md5('<seed>:<id>')`` ascending (ties on the id text).  Sizes are
exact: ``int(n * r_train)`` train, ``int(n * r_valid)`` valid, rest test.

No global sort is needed.  Rows are hashed into 65,536 buckets by the first
four hex digits of the key (the key order is the bucket order), bucket counts
are one small aggregate, and only the (at most two) buckets that contain a cut
point are ranked inside; every other row's split follows from its bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed_values as FV
from tessera.session import bounded_rows
from tessera.sources.jsonl import share_of_total

_PREFIX = 4  # hex digits -> 65,536 buckets
MAX_BUCKET_ROWS = 500_000  # of the broadcast bucket table: four numbers and a stratum a row


def shuffle_key(id_cols: list[str], seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols])))


def split_exact(df: DataFrame, id_cols: list[str], ratios=FV.SPLIT_RATIOS, seed: int = FV.SPLIT_SEED,
                strata: str | None = None) -> DataFrame:
    """Add ``split`` in {'train','valid','test'}; per stratum when ``strata`` is set.

    The bucket table (at most 65,536 rows per stratum) is summed up in Spark:
    with it every bucket knows how many rows come before it.  It is broadcast
    while its row count is proven small; many strata make it a shuffle join.
    """
    if abs(sum(ratios) - 1.0) > 0.001:
        raise ValueError(f"split ratios {tuple(ratios)} do not add up to 1")
    group = F.struct(F.col(strata)) if strata else F.struct(F.lit(0).alias("all"))
    keyed = (df.withColumn("_k", shuffle_key(id_cols, seed))
               .withColumn("_id", F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols]))
               .withColumn("_b", F.conv(F.substring("_k", 1, _PREFIX), 16, 10).cast("int"))
               .withColumn("_g", group))
    w_all = Window.partitionBy("_g")
    w_before = w_all.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    table = (keyed.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_c"))
             .withColumn("_lo", F.coalesce(F.sum("_c").over(w_before), F.lit(0)))
             .withColumn("_n", F.sum("_c").over(w_all))
             .withColumn("_cut1", F.floor(F.col("_n") * F.lit(float(ratios[0]))))
             .withColumn("_cut2", F.col("_cut1") + F.floor(F.col("_n") * F.lit(float(ratios[1]))))
             .withColumn("_hi", F.col("_lo") + F.col("_c"))
             .withColumn("_whole", F.when(F.col("_hi") <= F.col("_cut1"), "train")
                         .when((F.col("_lo") >= F.col("_cut1")) & (F.col("_hi") <= F.col("_cut2")), "valid")
                         .when(F.col("_lo") >= F.col("_cut2"), "test")))
    table = table.select("_g", "_b", "_lo", "_cut1", "_cut2", "_whole")
    small = not strata or bounded_rows(table, MAX_BUCKET_ROWS) is not None
    placed = keyed.join(F.broadcast(table) if small else table, ["_g", "_b"])
    plain = placed.filter(F.col("_whole").isNotNull()).withColumn("split", F.col("_whole"))
    w = Window.partitionBy("_g", "_b").orderBy("_k", "_id")
    pos = F.col("_lo") + F.row_number().over(w) - 1
    cut = placed.filter(F.col("_whole").isNull()).withColumn(
        "split", F.when(pos < F.col("_cut1"), "train").when(pos < F.col("_cut2"), "valid").otherwise("test"))
    return plain.unionByName(cut).drop("_k", "_b", "_id", "_g", "_lo", "_cut1", "_cut2", "_whole")


def length_stratum(c: Column) -> Column:
    """Length class on a log2 scale (0..15): strata for SP2."""
    return F.least(F.floor(F.log2(F.length(c) + 1)), F.lit(15)).cast("int")


_DIGIT = 16  # bits of a key digit


def equal_strata(df: DataFrame, value: Column, id_cols: list[str], n: int = 10, seed: int = FV.SPLIT_SEED,
                 out: str = "stratum") -> DataFrame:
    """SP2: ``out`` = 1..n such that the strata follow the order of ``value``
    (null as 0; ties by the shuffle key, then the id text) and their sizes
    differ by at most one, as ``ntile(n)`` gives.

    No window over the table: the order key is read as digits of 16 bits (the
    value's, then the hash's), and each of the ``n - 1`` cuts is narrowed digit
    by digit.  A step is one grouped count over the rows that share a cut's
    digits so far, and its largest result at the driver is one row per cut.
    Only rows that agree with a cut in every digit are ranked among each other.
    """
    keyed = (df.withColumn("_v", F.coalesce(value.cast("long"), F.lit(0))).withColumn("_k", shuffle_key(id_cols, seed))
             .withColumn("_id", F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols])))
    span = keyed.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not span["n"]:
        return df.withColumn(out, F.lit(1))
    levels = -(-(span["hi"] - span["lo"]).bit_length() // _DIGIT)
    mask = (1 << _DIGIT) - 1
    for i in range(levels):
        keyed = keyed.withColumn(f"_d{i}", F.shiftright(F.col("_v") - span["lo"], _DIGIT * (levels - 1 - i)).bitwiseAND(mask).cast("int"))
    for i in range(4):
        keyed = keyed.withColumn(f"_d{levels + i}", F.conv(F.substring("_k", 4 * i + 1, 4), 16, 10).cast("int"))
    depth = levels + 4
    digits = [F.col(f"_d{i}") for i in range(depth)]

    def shares(prefix: tuple[int, ...]) -> Column:
        hit = F.lit(True)
        for d, x in zip(digits, prefix):
            hit = hit & (d == x)
        return hit

    small, larger = divmod(span["n"], n)
    ends = [small * j + min(j, larger) for j in range(1, n)]
    # per cut the digits so far and how many rows with these digits lie before it
    cuts = [((), e) for e in ends if e < span["n"]]
    for i in range(depth):
        # a cut with no row before it needs no more digits
        open_ = sorted({p for p, rest in cuts if rest and len(p) == i})
        if not open_:
            continue
        group = F.coalesce(*(F.when(shares(p), F.lit(j)) for j, p in enumerate(open_)))
        counts = keyed.select(group.alias("g"), digits[i].alias("d")).filter("g is not null").groupBy("g", "d").agg(
            F.count(F.lit(1)).alias("c"))
        w = Window.partitionBy("g").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
        wanted = [(open_.index(p), rest) for p, rest in cuts if rest and len(p) == i]
        hit = F.lit(False)
        for g, rest in wanted:
            hit = hit | ((F.col("g") == g) & (F.col("before") <= rest) & (F.col("before") + F.col("c") > rest))
        found = counts.filter(hit).collect()

        def narrowed(p: tuple[int, ...], rest: int) -> tuple[tuple[int, ...], int]:
            if not rest or len(p) != i:
                return p, rest
            r = next(r for r in found if open_[r["g"]] == p and r["before"] <= rest < r["before"] + r["c"])
            return (*p, r["d"]), rest - r["before"]

        cuts = [narrowed(*c) for c in cuts]
    ties = sorted({p for p, rest in cuts if rest})
    tie = F.coalesce(*(F.when(shares(p), F.lit(j)) for j, p in enumerate(ties))) if ties else F.lit(None)
    keyed = keyed.withColumn("_tie", tie.cast("int"))
    rank = F.row_number().over(Window.partitionBy("_tie").orderBy("_k", "_id")) - 1
    ranked = keyed.filter("_tie is null").withColumn("_rank", F.lit(0))
    if ties:
        ranked = ranked.unionByName(keyed.filter("_tie is not null").withColumn("_rank", rank))
    stratum = F.lit(1)
    for p, rest in cuts:
        key, border = F.struct(*digits[:len(p)]), F.struct(*(F.lit(x).alias(f"_d{i}") for i, x in enumerate(p)))
        after = (key >= border) if not rest else ((key > border) | (shares(p) & (F.col("_rank") >= rest)))
        stratum = stratum + after.cast("int")
    # a cut at the end of the table leaves the strata after it empty
    return ranked.withColumn(out, stratum.cast("int")).drop("_v", "_k", "_id", "_tie", "_rank", *(f"_d{i}" for i in range(depth)))


def split_sizes(df: DataFrame) -> DataFrame:
    """AG6: rows and percent per split (share of the one-row total)."""
    per = df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    return share_of_total(per, "n_rows", 6)
