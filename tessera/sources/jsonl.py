"""JSON-lines sources and sinks (SRC1-SRC6, SNK1, SNK4, SNK6, AG5, SO1).

Reads are schema-first (no inference) and PERMISSIVE: a malformed line is
kept as a row with ``_bad`` set, so it can be counted and dropped without a
second pass.  Writes go through the DataFrame writer (one atomic job commit
per output), so a lost executor only re-runs its tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import checkpoint_dir

BAD = "_bad"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a local temp dir)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tessera-scratch/{name}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """SRC1: line-wise JSON with the given schema; a malformed line keeps its
    text in ``_bad`` (fields NULL); blank lines are skipped.  Lines are parsed
    with ``from_json`` so the corrupt-record column can be used on its own."""
    st = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    if BAD not in st.fieldNames():
        st = T.StructType(st.fields + [T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).filter(F.trim(F.col("value")) != "")
    # partition folders (e.g. split=train) come back as columns and win over
    # a same-named field, which partitioned writers leave out of the lines
    part_cols = [c for c in lines.columns if c != "value"]
    st = T.StructType([f for f in st.fields if f.name not in part_cols])
    parsed = lines.select(*part_cols, F.from_json("value", st, {"mode": "PERMISSIVE",
                                                                "columnNameOfCorruptRecord": BAD}).alias("_r"))
    return parsed.select("_r.*", *part_cols)


# splits whose counts are broadcast: a file name and a few numbers each
MAX_SPLITS = 100_000


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: (file, line_no, line) of every line, blank ones included, numbered
    from 1 in each file.

    Lines are counted per file split, the counts are summed up over the splits
    of a file, and a line's number is its place in its split plus the lines of
    the splits before; no text is shuffled, however large a file is.  (The two
    passes plan the same splits, and ids count up inside a split.)"""
    from tessera.session import bounded_rows
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    counts = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    w = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits_path = scratch_path(spark, "line-splits")
    counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n").write.parquet(splits_path)
    splits = spark.read.parquet(splits_path)
    if bounded_rows(splits, MAX_SPLITS) is not None:
        splits = F.broadcast(splits)
    return lines.join(splits, ["file", "_block"]).select(
        "file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")


def first_lines(spark: SparkSession, path: str, n: int, schema: T.StructType | str | None = None) -> DataFrame:
    """SRC6: the first ``n`` lines of every file, bad ones included, with
    ``file`` and ``line_no``; with a ``schema`` parsed like ``read_jsonl``
    (a blank line has null fields and no error)."""
    lines = number_lines(spark, path).filter(F.col("line_no") <= n)
    if schema is None:
        return lines
    st = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    st = T.StructType([*[f for f in st.fields if f.name != BAD], T.StructField(BAD, T.StringType())])
    parsed = F.from_json(F.nullif(F.trim("line"), F.lit("")), st, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return lines.select("file", "line_no", parsed.alias("_r")).select("file", "line_no", "_r.*")


def parse_counts(df: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """(rows, bad_rows) of a PERMISSIVE read."""
    return df.groupBy(*(group_cols or [])).agg(F.count(F.lit(1)).alias("rows"), F.count(BAD).alias("bad_rows"))


def read_corpus_gz(spark: SparkSession, path: str, schema, n_partitions: int) -> DataFrame:
    """SRC2: gzip JSON lines (not splittable: one task per file) spread over
    ``n_partitions`` right after the scan."""
    return read_jsonl(spark, path, schema).repartition(n_partitions)


def read_jsonl_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """SRC3: raw lines of every matching file with file provenance."""
    df = spark.read.text(pattern)
    return df.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def keep_valid_instruction_rows(lines: DataFrame, keys=("instruction", "input", "output")) -> DataFrame:
    """SRC4: drop blank lines; keep lines that parse as a JSON object holding
    every key (a key with a null value still counts as present)."""
    s = F.trim(F.col("line"))
    ok = (s != "") & F.json_object_keys(s).isNotNull()
    for k in keys:
        ok = ok & F.array_contains(F.json_object_keys(s), k)
    return lines.filter(F.coalesce(ok, F.lit(False)))


def per_file_stats(valid: DataFrame, file_col: str = "file") -> DataFrame:
    """AG5: valid lines per file and share of all valid lines."""
    per = valid.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_lines"))
    return share_of_total(per, "n_lines", 1)


def share_of_total(per: DataFrame, count: str, decimals: int) -> DataFrame:
    """``pct``: the share of each row in the total, which is one row joined
    on a constant, so the rows stay where they are."""
    total = per.agg(F.sum(count).alias("_total")).withColumn("_one", F.lit(1))
    out = per.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return out.withColumn("pct", F.round(F.col(count) * 100.0 / F.col("_total"), decimals)).drop("_one", "_total")


def concat_splits(*dfs: DataFrame, columns=("question", "answer")) -> DataFrame:
    """SRC5 / SO1: stack inputs (no dedup), projecting the given columns."""
    out = dfs[0].select(*columns)
    for d in dfs[1:]:
        out = out.unionByName(d.select(*columns))
    return out


def limit_lines(df: DataFrame, order_cols: list[str], n: int) -> DataFrame:
    """TK9: the first ``n`` rows in a total order (``first_lines`` takes them
    by their place in a file); planned as TakeOrderedAndProject (per-task top-n, then a final merge)."""
    return df.orderBy(*order_cols).limit(n)


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    """SNK1/SNK2/SNK3/SNK4: JSON lines (UTF-8, no ASCII escaping)."""
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)
    return path


def validate_written(spark: SparkSession, path: str, schema, expected: DataFrame | int,
                     group_col: str | None = None) -> DataFrame:
    """SNK6: re-read; every line must parse and the count must equal the expected one."""
    back = read_jsonl(spark, path, schema)
    gcols = [group_col] if group_col else []
    got = parse_counts(back, gcols)
    if isinstance(expected, int):
        return got.withColumn("expected", F.lit(expected).cast("bigint")) \
                  .withColumn("ok", (F.col("bad_rows") == 0) & (F.col("rows") == F.col("expected")))
    exp = expected.groupBy(*gcols).agg(F.count(F.lit(1)).alias("expected"))
    if not gcols:  # two one-row aggregates: join on a constant key
        got, exp, gcols = got.withColumn("_k", F.lit(1)), exp.withColumn("_k", F.lit(1)), ["_k"]
    j = got.join(exp, gcols, "full_outer").drop("_k")
    return j.withColumn("ok", (F.coalesce("bad_rows", F.lit(0)) == 0) & (F.col("rows") == F.col("expected")))
