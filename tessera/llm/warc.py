"""WARC writing, and reading by boundary-chain verification.

Writing is a plain text write whose line separator is the record trailer, so
an archive is a folder of ``part-*`` files made by the executors.

Reading does not trust the record magic.  Every split is cut at each magic
string; each cut gives a *candidate* record with its byte offset and the
offset of its successor (own offset + header + Content-Length + trailer).  A
payload may hold the magic, so candidates are verified as a chain: starting at
offset 0 of a file only the successor of a true record is a true record.
Candidates that simply follow each other are contracted to runs first; the
runs are then reached from the file start by pointer jumping (the pointers
double their reach every round), so the number of rounds is logarithmic in
the number of runs.  Candidates that are not reached are payload bytes of the
record around them, and are put back into it.

Only headers, lengths and digests are shuffled; payload bytes move only for
the records that hold a magic string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

MAGIC, CRLF, TRAILER = "WARC/1.0\r\n", "\r\n", "\r\n\r\n"
MAX_RECORDS_PER_FILE = 100_000
# a table of at most this many rows (two ids and a digest, under 200 bytes
# each) is broadcast; beyond it the join is a shuffle join
BROADCAST_ROWS = 100_000


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of ``data``: eight groups of five
    hex digits, four base32 characters each."""
    h = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def small_or_shuffled(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its row count is proven small."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def plan_records(pages: DataFrame, min_dedup_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type,
    refers_to): of pages with equal payloads of at least ``min_dedup_bytes``
    bytes the one with the largest page_id is the response, the others revisit
    it.  Null html is an empty payload; a null page_id is below every other;
    rows that repeat the largest page_id are responses as well.  Extra columns
    are ignored."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                     F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    p = p.withColumn("content_key", F.sha2(F.col("payload"), 256))
    groups = (p.groupBy("content_key").agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("top"),
                                           F.max(F.octet_length("payload")).alias("payload_bytes"))
              .filter((F.col("copies") > 1) & F.col("top").isNotNull()
                      & (F.col("payload_bytes") >= min_dedup_bytes)).select("content_key", "top"))
    groups = materialise(groups, "warc-copies")
    return (p.join(small_or_shuffled(groups), "content_key", "left")
            .withColumn("revisit", F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")))
            .select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
                    sha1_base32(F.col("payload")).alias("payload_digest"),
                    F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
                    F.when(F.col("revisit"), F.col("top")).alias("refers_to")))


def _page_uri(c: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))


# characters that some reader takes for the end of a line, and other controls
CONTROLS = r"[\x00-\x1f\x7f-\x9f\u2028\u2029]"


def _escaped(url: Column) -> Column:
    """``url`` with its control characters and line separators percent-encoded."""
    code = lambda c: F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "%$1")
    chars = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(CONTROLS), code(c)).otherwise(c))
    return F.when(url.rlike(CONTROLS), F.array_join(chars, "")).otherwise(url)


def write_archive(pages: DataFrame, path: str, min_dedup_bytes: int = 0,
                  max_records_per_file: int = MAX_RECORDS_PER_FILE) -> None:
    """One record per page row, in files of at most ``max_records_per_file``
    records under ``path``.  Control characters and line separators of a URL
    are percent-encoded; a null URL has no target header."""
    r = plan_records(pages, min_dedup_bytes)
    url = _escaped(F.col("url"))
    is_revisit = F.col("record_type") == "revisit"
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.col("record_type"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _page_uri(F.col("page_id")),
        F.coalesce(F.concat(F.lit(f"{CRLF}WARC-Target-URI: "), url), F.lit("")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(is_revisit, F.concat(F.lit(f"{CRLF}WARC-Refers-To: "), _page_uri(F.col("refers_to"))))
        .otherwise(F.lit(f"{CRLF}Content-Type: text/html; charset=utf-8")),
        F.lit(f"{CRLF}Content-Length: "),
        F.when(is_revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")),
        F.lit(TRAILER), F.when(is_revisit, F.lit("")).otherwise(F.col("payload")))
    (r.select(record.alias("value")).write.option("lineSep", TRAILER)
     .option("maxRecordsPerFile", max_records_per_file).text(path))


def _header(name: str) -> Column:
    """The first header of that name; only CRLF ends a header line."""
    return F.nullif(F.regexp_extract("head", rf"(?i)(?:\A|\r\n){name}:[ \t]*([^\r\n]*?)[ \t]*(?:\r\n|\z)", 1), F.lit(""))


def _cut(spark: SparkSession, path: str) -> DataFrame:
    """The text after each magic string, with its place: split by split, the
    order inside a split is the order of the ids."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("seq"), "value"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records: (file, block, start, next, headers, content_length,
    whole, computed_digest, value_key).  ``whole`` says that header, payload
    and trailer lie before the next magic; only then the digest is computed
    from the payload here."""
    rows = (_cut(spark, path)
            .withColumn("n", F.octet_length("value").cast("long"))
            .withColumn("head", F.when(F.instr("value", TRAILER) > 0, F.substring_index("value", TRAILER, 1)))
            .withColumn("head_bytes", F.octet_length("head").cast("long") + 4)
            .withColumn("content_length", _header("Content-Length").try_cast("long"))
            .withColumn("whole", F.coalesce(F.col("n") == F.col("head_bytes") + F.col("content_length") + 4,
                                            F.lit(False)))
            .withColumn("payload", F.expr("substring(cast(value as binary), int(head_bytes + 1), int(content_length))"))
            .select("file", "block", "seq", "n", "head_bytes", "content_length", "whole",
                    _header("WARC-Type").alias("record_type"), _header("WARC-Record-ID").alias("record_id"),
                    _header("WARC-Refers-To").alias("refers_to"), _header("WARC-Target-URI").alias("url"),
                    _header("WARC-Payload-Digest").alias("header_digest"),
                    F.when(F.col("whole"), sha1_base32(F.col("payload"))).alias("computed_digest"),
                    F.md5("value").alias("value_key")))
    rows = materialise(rows, "warc-cuts")
    # byte offsets: a prefix sum inside each split plus the sum of the splits before it
    step = F.col("n") + len(MAGIC)
    in_block = Window.partitionBy("file", "block").orderBy("seq")
    blocks = rows.groupBy("file", "block").agg(F.sum(step).alias("block_bytes"))
    before = blocks.select("file", "block", F.coalesce(
        F.sum("block_bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    start = (F.col("base") + F.sum(step).over(in_block) - step - len(MAGIC)).alias("start")
    placed = rows.join(before, ["file", "block"]).select("*", start).filter("start >= 0")
    return placed.withColumn("next", F.col("start") + len(MAGIC) + F.col("head_bytes")
                             + F.col("content_length") + len(TRAILER)).drop("base")


def verify_chain(cands: DataFrame) -> DataFrame:
    """The candidates with ``reached``: whether the chain of successors that
    starts at offset 0 of the file meets them."""
    arrows = cands.filter(F.col("next").isNotNull()).groupBy("file", F.col("next").alias("start")).agg(
        F.count(F.lit(1)).alias("arrows"))
    w = Window.partitionBy("file", "block").orderBy("start")
    linked = cands.join(arrows, ["file", "start"], "left").withColumn(
        "run_head", ~F.coalesce((F.lag("next").over(w) == F.col("start")) & (F.col("arrows") == 1), F.lit(False)))
    # a run starts at a head; its members follow each other, so it is reached as one
    runs = linked.withColumn("run", F.last(F.when(F.col("run_head"), F.col("start")), True).over(w))
    runs = materialise(runs, "warc-runs")
    jump = runs.groupBy("file", "run").agg(F.max_by("next", "start").alias("to"))
    heads = jump.select("file", F.col("run").alias("to"))
    jump = materialise(jump.join(heads, ["file", "to"], "left_semi"), "warc-jump")   # to a head, else an end
    reached = materialise(runs.filter("start = 0").select("file", "run").distinct(), "warc-reached")
    while True:
        met = materialise(reached.join(jump, ["file", "run"]).select("file", F.col("to").alias("run")), "warc-met")
        if met.isEmpty():
            break
        reached = materialise(reached.unionByName(met), "warc-reached")
        hop = jump.select("file", F.col("run").alias("to"), F.col("to").alias("far"))
        jump = materialise(jump.join(hop, ["file", "to"]).select("file", "run", F.col("far").alias("to")),
                           "warc-jump")
    return runs.join(reached.withColumn("reached", F.lit(True)), ["file", "run"], "left").withColumn(
        "reached", F.coalesce(F.col("reached"), F.lit(False))).drop("arrows", "run_head", "run")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The true records under ``path``: (file, start, record_type, record_id,
    refers_to, url, header_digest, payload_bytes, computed_digest, value_key).

    A file that does not begin with a record has none; a last record cut off
    before its end has null ``computed_digest``; an empty folder has no rows.
    """
    checked = materialise(verify_chain(candidates(spark, path)), "warc-checked")
    out = ["file", "start", "record_type", "record_id", "refers_to", "url", "header_digest",
           F.col("content_length").alias("payload_bytes"), "computed_digest", "value_key"]
    true = checked.filter("reached")
    odd = checked.filter(~F.col("reached") | ~F.col("whole"))
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    parts = odd.select("file", "start", "reached", "value_key").withColumn(
        "owner", F.last(F.when(F.col("reached"), F.col("start")), True).over(w)).filter("owner is not null")
    parts = materialise(parts, "warc-parts")
    if parts.isEmpty():
        return true.select(*out)
    keys = small_or_shuffled(parts.select("value_key").distinct())
    values = (_cut(spark, path).select(F.md5("value").alias("value_key"), "value")
              .join(keys, "value_key", "left_semi").dropDuplicates(["value_key"]))
    joined = (parts.join(values, "value_key").groupBy("file", F.col("owner").alias("start"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "value"))),
                                            lambda x: x["value"]), MAGIC).alias("text")))
    again = (true.filter(~F.col("whole")).drop("computed_digest").join(joined, ["file", "start"], "left")
             .withColumn("body", F.expr("substring(cast(text as binary), int(head_bytes + 1), int(content_length))"))
             .withColumn("computed_digest", F.when(F.octet_length("body") == F.col("content_length"),
                                                   sha1_base32(F.col("body")))))
    return true.filter("whole").select(*out).unionByName(again.select(*out))


def resolve(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to,
    verified): revisits take length and digest from the response they name;
    ``verified`` says that the digest computed from the payload is the one in
    the header."""
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    r = records.select(page("record_id").alias("page_id"), "record_type", page("refers_to").alias("refers_to"),
                       "payload_bytes", F.col("computed_digest").alias("payload_digest"),
                       F.regexp_replace("header_digest", "^sha1:", "").alias("stated"))
    responses = r.filter("record_type = 'response'")
    targets = responses.dropDuplicates(["page_id", "payload_digest"]).select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated"),
        F.col("payload_bytes").alias("target_bytes"), F.col("payload_digest").alias("target_digest"))
    revisits = r.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(
        targets, ["refers_to", "stated"], "left").select(
        "page_id", "record_type", "refers_to", F.col("target_bytes").alias("payload_bytes"),
        F.col("target_digest").alias("payload_digest"), "stated")
    both = responses.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest",
                            "stated").unionByName(revisits)
    return both.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                       F.coalesce(F.col("payload_digest") == F.col("stated"), F.lit(False)).alias("verified"))
