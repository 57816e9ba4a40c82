"""WARC round trip: payloads that hold records, splits inside records."""

from __future__ import annotations

import base64
import hashlib

import pytest

from tessera.llm import warc
from tessera.llm.common import scratch

RECORD = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
SCHEMA = "page_id long, url string, html string"
PAGES = [(1, "u", "a" + RECORD + "tail"), (2, None, None), (3, "u\r\nX: y", ""), (4, "u", "x" + warc.MAGIC),
         (5, "u", warc.MAGIC + "Content-Length: 3\r\n\r\n"), (6, "u", "a" + RECORD + "tail"), (None, "u", "zz"),
         (7, "u", RECORD), (8, "u", RECORD * 40), (9, "u", "é" * 50 + warc.MAGIC * 2), (9, "u", "é" * 50 + warc.MAGIC * 2),
         (10, "u", warc.MAGIC[:-1]), (11, "u", "\r\n\r\n"), (12, "u", "W" * 3000 + warc.MAGIC * 40)]


def expected(pages):
    top = {}
    for i, _, h in pages:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        copies = sum((x[2] or "") == (h or "") for x in pages)
        revisit = copies > 1 and (h or "") in top and i != top[h or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                    "revisit" if revisit else "response", top[h or ""] if revisit else None, True))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["128m", "2k"])
def test_round_trip(spark, split):
    df = spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", "'x' as payload", "1 as block").coalesce(1)
    path = scratch(spark, "warc-test")
    warc.write_archive(df, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = warc.resolve(warc.read_records(spark, path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((tuple(r) for r in got), key=str) == expected(PAGES)


def test_small_payloads_are_not_deduplicated(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], SCHEMA)
    kinds = {r.page_id: r.record_type for r in warc.plan_records(df, min_dedup_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_table_and_foreign_files(spark):
    path = scratch(spark, "warc-test")
    warc.write_archive(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_records(spark, path).collect() == []
    other = scratch(spark, "warc-test")
    spark.createDataFrame([("no record at the start " + RECORD,)], "value string").write.text(other)
    assert warc.read_records(spark, other).collect() == []


SEPARATORS = [*map(chr, range(32)), *map(chr, range(0x7f, 0xa0)), "\u2028", "\u2029"]
FORGED = "Content-Length: 3\r\nWARC-Type: revisit"


def test_no_character_of_a_url_or_text_hides_a_record(spark):
    """Every control and separator before a header-like string, in URL and html."""
    pages = [(3 * i + k, f"http://a/{c}{FORGED}{c}b" if k else "http://a", f"x{c}{FORGED}{c}\r\n{c}" if k != 1 else "y" * i)
             for i, c in enumerate(SEPARATORS) for k in range(3)]
    path = scratch(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(pages, SCHEMA).coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        records = warc.read_records(spark, path)
        urls = {r.record_id: r.url for r in records.select("record_id", "url").collect()}
        got = warc.resolve(records).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((tuple(r) for r in got), key=str) == expected(pages)
    for i, u, _ in pages:
        assert urls[f"<urn:page:{i}>"] == "".join("".join(f"%{b:02X}" for b in c.encode()) if c in SEPARATORS else c for c in u)


def test_headers_of_foreign_archives(spark):
    """Line separators inside a header value, any case, an archive by another hand."""
    head = "warc-type: response\r\nWARC-Record-ID: <urn:page:5>\r\nWARC-Target-URI: http://a/\u2028content-length: 1\r\ncontent-length:  5 "
    path = scratch(spark, "warc-test")
    spark.createDataFrame([(f"{warc.MAGIC}{head}\r\n\r\nhello\r\n\r\n" + RECORD,)], "value string").coalesce(1).write.option(
        "lineSep", "\r\n").text(path)
    got = sorted((r.start, r.payload_bytes) for r in warc.read_records(spark, path).collect())
    assert [g[1] for g in got] == [5, 5]
