"""Test tables as sessions, messages and tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(conversations: DataFrame) -> DataFrame:
    """``session_id, idx, role, content``."""
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), "role", F.coalesce("text", F.lit("")).alias("content"))


def event_log(events: DataFrame) -> DataFrame:
    """Events with their session: a user's three-day bucket. ``view`` is a user message, all else a tool call."""
    epoch = F.unix_timestamp(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("int")
    path = F.when(k % 2 == 0, F.concat(F.lit("src/f"), k, F.lit(".ts"))).otherwise(F.concat(F.lit("docs/f"), k, F.lit(".md")))
    return events.select(
        "event_id", "ts", epoch.alias("epoch"), "user_id", F.floor(epoch / 259200).cast("long").alias("bucket"), "event_type", F.col("value"), "props",
        F.when(F.col("event_type").isin("purchase", "signup"), path).alias("path"),
    )
