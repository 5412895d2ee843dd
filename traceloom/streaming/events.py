"""Structured Streaming over event files and session logs.

Files are written once and appear whole, as the sinks write them. State is bounded by the
watermark: rows later than it are dropped, which is the feature of a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parsing

EVENT = "schema_version string, event_id string, run_id string, ts timestamp, type string, agent_name string, attrs map<string,string>"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of the event files that ``session_logs.append_events`` writes."""
    return spark.readStream.schema(EVENT).json(folder)


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, type, agent_name, n`` a window; an event that comes twice in time counts once. Null times are left out."""
    seen = events.where("ts is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    counts = seen.groupBy(F.window("ts", width), "type", "agent_name").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "type", "agent_name", "n")


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``session_id, line_no, line`` of log files as they appear, read whole; the file's name is the session."""
    files = spark.readStream.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(folder)
    named = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1).alias("session_id"), "value")
    return named.select("session_id", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def session_activity(lines: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``session_id, start, end, users, assistants``: bouts of messages with no pause of ``gap`` between them."""
    said = parsing.messages(parsing.entries(lines)).select("session_id", "role", F.try_to_timestamp("ts").alias("at")).where("at is not null")
    bouts = said.withWatermark("at", late).groupBy("session_id", F.session_window("at", gap)).agg(
        F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"),
    )
    return bouts.select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "users", "assistants")


def write_stream(stream: DataFrame, folder: str, checkpoint: str, *, once: bool = True):
    """Appends what is final to Parquet files, exactly once by the checkpoint; ``once`` ends when the input is read."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
