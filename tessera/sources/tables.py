"""Driver tables and the adapters that give them the shapes the operators use.

Each adapter is a plain projection / join over the given tables, so its work
grows with them; nothing is generated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as Spark reads it; jobs that need a partitioning state it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def qa_pairs(conversations: DataFrame) -> DataFrame:
    """Each user turn with the next assistant turn of the same conversation.

    Turns are dense ordinals inside a conversation, so the "next" row is an
    equi-join on (conv_id, turn + 1): it hashes on both columns and does not
    funnel a long conversation into one task the way a window would.
    """
    u = conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"))
    a = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"], "inner").select("conv_id", "turn", "question", "answer")


def search_documents(documents: DataFrame) -> DataFrame:
    """Documents as search rows: question '', content = text."""
    return documents.select(
        "doc_id",
        F.lit("").alias("question"),
        F.col("text").alias("content"),
        F.coalesce(F.col("source"), F.lit("unknown")).alias("source"),
        "lang",
    )


def bench_queries(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def query_variants(benchmark: DataFrame) -> DataFrame:
    """Benchmark texts grouped into requests of three variants."""
    return benchmark.select(
        F.floor(F.col("item_id") / 3).cast("bigint").alias("request_id"),
        (F.col("item_id") % 3).cast("int").alias("variant_idx"),
        F.col("text").alias("query"),
    )


def dense_points(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("point_id"), "embedding", "label")


def dense_queries(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def chat_log(conversations: DataFrame) -> DataFrame:
    """Conversations as a chat log: role -> is_request, turn -> order."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        "conv_id",
        "turn",
        "role",
        F.col("text").alias("message"),
        (F.col("role") == "user").alias("is_request"),
    )


def timed_accesses(events: DataFrame) -> DataFrame:
    """Timed chat accesses for sessionising: bot = event_type, user = user_id."""
    return events.select(
        "event_id",
        F.col("event_type").alias("bot_id"),
        F.col("user_id").cast("string").alias("user_id"),
        "ts",
    )


def metric_samples(events: DataFrame) -> DataFrame:
    return events.select("event_id", "ts", F.col("event_type").alias("series"), "value")


def penalty_cases(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One case per line item: value = order total, days late = ship - order - 30."""
    li = lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_shipdate")
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("o_custkey").alias("party"),
        F.col("o_totalprice").alias("contract_value"),
        (F.col("l_discount") * 10).alias("penalty_rate"),
        (F.datediff(F.col("l_shipdate"), F.col("o_orderdate")) - 30).alias("days_late"),
    )


def estates(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("estate_id"), F.col("o_totalprice").alias("total_value"))


def heirs(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("estate_id"),
        F.col("l_linenumber").alias("heir_idx"),
        F.concat(F.lit("heir-"), F.col("l_partkey").cast("string")).alias("name"),
        F.when(F.col("l_linenumber") == 1, "spouse").when(F.col("l_linenumber") <= 5, "child")
         .otherwise("parent").alias("relation"),
        (F.col("l_linenumber") > 4).alias("is_minor"),
    )


def persons(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("person_id"),
        (F.lit(1950) + F.col("c_custkey") % 70).cast("int").alias("birth_year"),
        F.col("c_mktsegment").alias("segment"),
    )


def business_names(customer: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("name_id"), F.col("c_name").alias("business_name"))


def predictions(conversations: DataFrame) -> DataFrame:
    """User/assistant pairs as (reference, prediction) with a loss column
    derived from the ids (the neural loss is an input, not computed here)."""
    qa = qa_pairs(conversations)
    return qa.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("question").alias("instruction_input"),
        F.col("answer").alias("reference"),
        F.col("question").alias("prediction"),
        (F.lit(0.5) + (F.col("conv_id") % 17) / 10.0 + (F.col("turn") % 5) / 20.0).alias("loss"),
    )
