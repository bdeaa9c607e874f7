"""The given tables as relations of the memory model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which reports look at the data.
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses from events: a session is a user; what is accessed follows from the kind of event and its k."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.when(F.col("event_type").isin("view", "click"), "file").when(F.col("event_type") == "purchase", "tool").when(F.col("event_type") == "error", "error").otherwise("semantic")
    path = F.concat(F.col("event_type"), F.lit("/"), (k % 20).cast("string"))
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("session_id"),
        kind.alias("type"),
        path.alias("path"),
        F.concat(kind, F.lit(":"), path).alias("vertex"),
        F.concat(F.col("event_type"), F.lit(" k"), k.cast("string")).alias("context"),
        F.col("ts").alias("at"),
        F.when(kind == "file", 1500).otherwise(500).cast("bigint").alias("token_cost"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits from orders: an order's parts are the files that it changes."""
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("file")).distinct()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderpriority").alias("message"))
    return files.join(orders, "commit")


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls from conversations: a turn is a call by its role with its text as result."""
    talks = table(spark, sf_dir, "conversations")
    return talks.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("role").alias("tool_name"), F.col("text").alias("tool_result"))
