"""Session summaries, selection of messages, and prompt blocks.

Messages are ``session_id, idx, role, content``; ``idx`` tells those of a session apart.
Null ids are a session of their own unless stated; empty tables give empty results; further
columns are not read.
"""

from __future__ import annotations

import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(messages: DataFrame) -> DataFrame:
    """Counts by role, the first user message and the last non-empty assistant message of each session.

    Null contents are skipped; of several messages with one ``idx`` any may come.
    """
    role = lambda r: F.col("role") == r
    return messages.groupBy("session_id").agg(
        F.count_if(role("user")).alias("user_messages"), F.count_if(role("assistant")).alias("assistant_messages"), F.count("*").alias("n_messages"),
        F.min_by("content", F.when(role("user"), F.col("idx"))).alias("first_user"),
        F.max_by("content", F.when(role("assistant") & (F.col("content") != ""), F.col("idx"))).alias("last_assistant"),
    )


def cap_last(messages: DataFrame, most: int = 1000) -> DataFrame:
    """The last ``most`` messages of each session, and how many were dropped.

    Messages with one ``idx`` follow each other by role, then text. Null ids are a session;
    an empty table gives none.
    """
    last = Window.partitionBy("session_id").orderBy(F.desc("idx"), F.desc("role"), F.desc("content"))
    sizes = messages.groupBy("session_id").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("dropped"))
    # the rank limit is pushed below the shuffle; a count over the same window would forbid that
    kept = messages.withColumn("r", F.row_number().over(last)).where(F.col("r") <= most).drop("r")
    return kept.join(sizes.withColumnRenamed("session_id", "_s"), F.col("session_id").eqNullSafe(F.col("_s"))).drop("_s")


def conversation_block(messages: DataFrame, most: int = 1000, chars: int = 500) -> DataFrame:
    """``role: text`` of the capped messages in order, with blank lines between. Null texts are left out."""
    line = F.concat(F.col("role"), F.lit(": "), F.substring("content", 1, chars))
    lines = cap_last(messages, most).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("l"))
    return lines.select("session_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("block"))


def last_outputs(calls: DataFrame, n: int = 3, chars: int = 200) -> DataFrame:
    """The last ``n`` non-empty outputs of each session, cut and joined. ``calls (session_id, ord, output)``.

    ``ord`` tells calls apart; those of one ``ord`` follow each other by output.
    """
    last = Window.partitionBy("session_id").orderBy(F.desc("ord"), F.desc("output"))
    some = calls.where("output <> ''").withColumn("r", F.row_number().over(last)).where(F.col("r") <= n)
    got = some.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.substring("output", 1, chars).alias("o")))).alias("l"))
    return got.select("session_id", F.array_join(F.transform("l", lambda x: x["o"]), " | ").alias("outputs"))


def first_seen(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Distinct values of each key in the order in which they were first seen; ties by value. Keys with nulls alone have no row."""
    first = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("o"))
    got = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", value))).alias("l"))
    return got.select(key, F.transform("l", lambda x: x[value]).alias("values"))


def attach_compat(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """Tool calls go to the first assistant message while none so far is older than it.

    ``messages (session_id, ts)`` of assistants with non-decreasing times; ``calls
    (session_id, ord, ts)``. A call that is older, or has no time, blocks those behind it: their
    ``msg_ts`` is null. Messages without a time take nothing.
    """
    first = messages.groupBy("session_id").agg(F.min("ts").alias("first_ts"))
    upto = Window.partitionBy("session_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    timed = calls.withColumn("low", F.min("ts").over(upto)).withColumn("blank", F.max(F.col("ts").isNull()).over(upto))
    both = timed.join(first, "session_id", "left")
    return both.select("session_id", "ord", F.when(~F.col("blank") & (F.col("low") >= F.col("first_ts")), F.col("first_ts")).alias("msg_ts"))


def attach_in_order(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """``session_id, ord, idx``: the assistant message that each attached call goes to, times in any order.

    ``messages (session_id, idx, ts)`` of assistants, ``calls (session_id, ord, ts)``. Messages
    take calls in order while the next one is not older; one that is waits for a later message
    that is not younger, and all behind it wait too. Calls that no message takes have no row.
    Null session ids take part in nothing. Sessions whose messages' times never decrease go
    the native way; the others are folded one by one.
    """
    order = Window.partitionBy("session_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    marked = messages.where("session_id is not null").withColumn("back", F.coalesce(F.col("ts") < F.max("ts").over(order), F.lit(False)))
    odd = marked.where("back").select("session_id").distinct()
    plain = messages.join(odd, "session_id", "left_anti")
    taken = attach_compat(plain.select("session_id", "ts"), calls.join(odd, "session_id", "left_anti")).where("msg_ts is not null")
    first = plain.where("ts is not null").groupBy("session_id").agg(F.min("idx").alias("idx"))
    native = taken.join(first, "session_id").select("session_id", "ord", "idx")

    def fold(key, said: pd.DataFrame, called: pd.DataFrame) -> pd.DataFrame:
        said, called = said.sort_values("idx"), called.sort_values("ord")
        waiting = list(zip(called["ord"], called["ts"], strict=True))
        out, at = [], 0
        for idx, ts in zip(said["idx"], said["ts"], strict=True):
            while at < len(waiting) and waiting[at][1] >= ts:  # never true where a time is missing
                out.append((key[0], waiting[at][0], idx))
                at += 1
        return pd.DataFrame(out, columns=["session_id", "ord", "idx"])

    kinds = dict(messages.dtypes) | {"ord": dict(calls.dtypes)["ord"]}
    # names of their own, for both may come of one table
    left = messages.join(odd, "session_id", "left_semi").select(F.col("session_id").alias("_m"), "idx", "ts")
    right = calls.join(odd, "session_id", "left_semi").select(F.col("session_id").alias("_c"), "ord", "ts")
    folded = left.groupBy("_m").cogroup(right.groupBy("_c")).applyInPandas(fold, f"session_id {kinds['session_id']}, ord {kinds['ord']}, idx {kinds['idx']}")
    return native.unionByName(folded)


def attach_asof(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """Each call with the last message not later than it: one sort of the union, no range join. Calls without a time have none."""
    m = messages.select("session_id", "ts", F.lit(None).cast("long").alias("ord"), F.col("ts").alias("m_ts"))
    c = calls.select("session_id", "ts", F.col("ord").cast("long"), F.lit(None).cast("timestamp_ntz").alias("m_ts"))
    w = Window.partitionBy("session_id").orderBy("ts", F.col("ord").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return m.unionByName(c).withColumn("msg_ts", F.last("m_ts", ignorenulls=True).over(w)).where("ord is not null").select("session_id", "ord", "msg_ts")
