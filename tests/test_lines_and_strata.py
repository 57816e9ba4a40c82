"""Line numbers over file splits; equal strata against a plain ntile."""

from __future__ import annotations

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import split
from tessera.sources import jsonl


@pytest.mark.parametrize("size", ["128m", "2k"])
def test_lines_are_numbered_across_splits(spark, tmp_path, size):
    rng = random.Random(1)
    files = {f"f{k}.jsonl": [rng.choice(['{"a": %d}' % i, "", "{bad", "x" * rng.randrange(400), '{"a": 1, "é": "ü"}']) for i in range(n)]
             for k, n in enumerate((900, 1, 0, 300))}
    for name, lines in files.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = {(os.path.basename(r.file), r.line_no): r.line for r in jsonl.number_lines(spark, f"{tmp_path}/*.jsonl").collect()}
        first = jsonl.first_lines(spark, f"{tmp_path}/*.jsonl", 7, "a long").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(name, i): x for name, lines in files.items() for i, x in enumerate(lines, 1)}
    assert len(first) == 15
    for r in first:
        line = files[os.path.basename(r.file)][r.line_no - 1]
        assert (r._bad is not None) == (line.strip() != "" and not line.startswith('{"a"'))


def by_ntile(rows, n, seed=42):
    order = sorted(rows, key=lambda r: (r[1] or 0, hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), str(r[0])))
    small, larger = divmod(len(rows), n)
    sizes = [small + (j < larger) for j in range(n)]
    tiles = [j + 1 for j, s in enumerate(sizes) for _ in range(s)]
    return sorted(zip((r[0] for r in order), tiles))


@pytest.mark.parametrize("values", [
    lambda r: r.randrange(5), lambda r: 7, lambda r: r.choice([None, 0, -3, 2 ** 40, 2 ** 40 + 1]), lambda r: r.randrange(-10 ** 12, 10 ** 12),
    lambda r: r.choice([-(2 ** 62), 2 ** 61])])
def test_equal_strata(spark, values):
    rng = random.Random(2)
    for size, n in ((503, 10), (7, 10), (100, 3)):
        rows = [(i, values(rng)) for i in range(size)]
        df = spark.createDataFrame(rows, "id long, v long").repartition(3)
        got = split.equal_strata(df, F.col("v"), ["id"], n).collect()
        assert sorted((r.id, r.stratum) for r in got) == by_ntile(rows, n)


def test_strata_of_repeated_ids_and_nothing(spark):
    df = spark.createDataFrame([(1, 5)] * 40, "id long, v long")
    sizes = [r["count"] for r in split.equal_strata(df, F.col("v"), ["id"], 3).groupBy("stratum").count().orderBy("stratum").collect()]
    assert sizes == [14, 13, 13]
    assert split.equal_strata(df.limit(0), F.col("v"), ["id"]).columns == ["id", "v", "stratum"]
