"""Log lines to messages, tool calls and session rows.

Input is ``session_id, line_no, line``. A line that is no JSON object is skipped. Order is
that of ``line_no``: the first and last times are those first and last in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sessions import attach_in_order

_BLOCKS = "array<struct<type string, text string, name string, input string>>"
_ENTRY = ("type string, message struct<role string, content string, model string, usage struct<input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint,"
          " cache_creation_input_tokens bigint>>, timestamp string, sessionId string, cwd string, gitBranch string, uuid string, parentUuid string")  # fmt: skip


def _filled(c: Column) -> Column:
    """Null where the text is empty."""
    return F.nullif(c, F.lit(""))


def _is_array(c: Column) -> Column:
    return F.coalesce(F.ltrim(c).startswith("["), F.lit(False))


def entries(lines: DataFrame) -> DataFrame:
    """Parsed lines of the first kind of log, ``e``; ``raw_array`` tells whether the content is a list of blocks."""
    parsed = lines.where(F.ltrim("line").startswith("{")).withColumn("e", F.from_json("line", _ENTRY))
    kind = F.get_json_object("line", "$.message.content")
    return parsed.where("e is not null").withColumn("raw_array", _is_array(kind) & F.from_json(kind, _BLOCKS).isNotNull())


def messages(parsed: DataFrame) -> DataFrame:
    """``session_id, line_no, role, content, ts, blocks, input_tokens, output_tokens`` of user and assistant entries.

    A user's list of blocks counts with empty content; an assistant's text blocks are
    joined, and its plain string is empty.
    """
    e = F.col("e")
    blocks = F.when(F.col("raw_array"), F.from_json(e["message"]["content"], _BLOCKS))
    text = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")
    user = e["message"]["role"] == "user"
    rows = parsed.where(e["type"].isin("user", "assistant") & (e["type"] == e["message"]["role"]))
    usage = e["message"]["usage"]
    return rows.select(
        "session_id", "line_no", e["type"].alias("role"),
        F.when(user, F.when(F.col("raw_array"), "").otherwise(F.coalesce(e["message"]["content"], F.lit("")))).otherwise(F.coalesce(text, F.lit(""))).alias("content"),
        F.coalesce(e["timestamp"], F.lit("")).alias("ts"), F.when(~user, blocks).alias("blocks"), e["uuid"].alias("uuid"),
        F.coalesce(usage["input_tokens"], F.lit(0)).alias("input_tokens"), F.coalesce(usage["output_tokens"], F.lit(0)).alias("output_tokens"),
    )


def results(parsed: DataFrame) -> DataFrame:
    """The last non-empty tool result for each parent entry; what is no text is its JSON."""
    e = F.col("e")
    content = _filled(e["message"]["content"])
    rows = parsed.where((e["type"] == "tool_result") & content.isNotNull() & _filled(e["parentUuid"]).isNotNull())
    return rows.groupBy("session_id", e["parentUuid"].alias("uuid")).agg(F.max_by(content, F.col("line_no")).alias("output"))


def tool_calls(parsed: DataFrame) -> DataFrame:
    """``session_id, line_no, tool_idx, name, input, output``: each ``tool_use`` block, with its entry's result."""
    used = F.filter("blocks", lambda b: b["type"] == "tool_use")
    calls = messages(parsed).where("role = 'assistant'").select("session_id", "line_no", "uuid", F.posexplode(used).alias("tool_idx", "b"))
    out = calls.join(results(parsed), ["session_id", "uuid"], "left")
    return out.select("session_id", "line_no", "tool_idx", F.col("b.name").alias("name"), F.col("b.input").alias("input"), F.coalesce("output", F.lit("")).alias("output"))


def sessions(parsed: DataFrame) -> DataFrame:
    """One row a session: header, first and last time, counts, token sums, tools and files as first seen."""
    e, at = F.col("e"), F.col("line_no")

    def first(c: Column, last: bool = False) -> Column:
        return (F.max_by if last else F.min_by)(_filled(c), F.when(_filled(c).isNotNull(), at))

    head = parsed.groupBy("session_id").agg(
        F.coalesce(first(e["sessionId"]), F.lit("unknown")).alias("log_id"), F.coalesce(first(e["cwd"]), F.lit("unknown")).alias("project"), F.coalesce(first(e["gitBranch"]), F.lit("unknown")).alias("branch"),
        F.coalesce(first(e["timestamp"]), F.lit("")).alias("started_at"), F.coalesce(first(e["timestamp"], True), F.lit("")).alias("ended_at"),
    )
    said = messages(parsed).groupBy("session_id").agg(
        F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )
    calls = messages(parsed).select("session_id", "line_no", F.posexplode(F.filter("blocks", lambda b: b["type"] == "tool_use")).alias("k", "b"))
    file = _filled(F.get_json_object("b.input", "$.file_path"))
    calls = calls.select("session_id", F.struct("line_no", "k").alias("o"), F.col("b.name").alias("tool"), F.when(F.col("b.name").isin("Write", "Edit"), file).alias("file"))
    # a row for each distinct tool and file first, so that what is gathered is small
    seen = calls.select("session_id", "o", F.inline(F.array(F.struct(F.lit("tool").alias("kind"), F.col("tool").alias("v")), F.struct(F.lit("file").alias("kind"), F.col("file").alias("v")))))
    distinct = seen.groupBy("session_id", "kind", "v").agg(F.min("o").alias("o"), F.count("*").alias("n")).where("v is not null")
    row = F.struct("o", "v")
    tools = distinct.groupBy("session_id").agg(
        F.sum(F.when(F.col("kind") == "tool", F.col("n"))).alias("tool_calls"),
        *(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, row))), lambda x: x["v"]).alias(name) for k, name in (("tool", "unique_tools"), ("file", "files_modified"))),
    )
    none = F.array().cast("array<string>")
    both = head.join(said, "session_id", "left").join(tools, "session_id", "left")
    counts = ("user_messages", "assistant_messages", "input_tokens", "output_tokens", "tool_calls")
    return both.select("session_id", "log_id", "project", "branch", "started_at", "ended_at", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts),
                       *(F.coalesce(F.col(c), none).alias(c) for c in ("unique_tools", "files_modified")))


_CODEX = "timestamp string, type string, payload string"


def codex_entries(lines: DataFrame) -> DataFrame:
    """Parsed lines of the second kind of log: ``ts, type, payload`` (JSON text)."""
    rows = lines.where(F.ltrim("line").startswith("{")).withColumn("e", F.from_json("line", _CODEX)).where("e.type is not null")
    return rows.select("session_id", "line_no", F.coalesce("e.timestamp", F.lit("")).alias("ts"), F.col("e.type").alias("type"), F.col("e.payload").alias("payload"))


def _field(name: str) -> Column:
    return F.get_json_object("payload", f"$.{name}")


def codex_messages(parsed: DataFrame) -> DataFrame:
    """Response items other than calls and reasoning; an unknown role is the assistant's, empty ones of others go."""
    kept = parsed.where("type = 'response_item'").where(~F.coalesce(_field("type"), F.lit("")).isin("function_call", "web_search_call", "reasoning"))
    blocks = F.filter(F.from_json(_field("content"), _BLOCKS), lambda b: b["type"].isin("output_text", "input_text", "text"))
    text = F.coalesce(F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), ""), F.lit(""))
    role = F.when(_field("role").isin("user", "developer"), _field("role")).otherwise("assistant")
    return kept.select("session_id", "line_no", role.alias("role"), text.alias("content"), "ts").where("role = 'assistant' or content <> ''")


def codex_calls(parsed: DataFrame) -> DataFrame:
    """Calls with name and arguments; arguments that are no JSON become ``{"raw": ...}``."""
    kept = parsed.where("type = 'response_item'").where(_field("type").isin("function_call", "web_search_call"))
    given = F.coalesce(_field("arguments"), F.lit("{}"))
    sound = F.try_parse_json(given)
    args = F.when(sound.isNotNull(), given).otherwise(F.to_json(F.struct(given.alias("raw"))))
    return kept.select("session_id", F.col("line_no").alias("ord"), F.coalesce(_filled(_field("name")), _field("type")).alias("name"), args.alias("input"), "ts")


def codex_sessions(parsed: DataFrame) -> DataFrame:
    """The columns of ``sessions``: header of the first ``session_meta``, sums of the token counts, counts of messages and calls.

    The branch is unknown and no files are tracked in this kind of log.
    """
    meta, count = F.col("type") == "session_meta", (F.col("type") == "event_msg") & (_field("type") == "token_count")
    at = F.when(meta, F.col("line_no"))
    get = lambda k: F.coalesce(_field(k).cast("long"), F.lit(0))
    timed = F.when(F.col("ts") != "", F.col("line_no"))
    head = parsed.groupBy("session_id").agg(
        F.coalesce(F.min_by(_field("id"), at), F.lit("unknown")).alias("log_id"), F.coalesce(F.min_by(_field("cwd"), at), F.lit("unknown")).alias("project"), F.lit("unknown").alias("branch"),
        F.coalesce(F.min_by("ts", timed), F.lit("")).alias("started_at"), F.coalesce(F.max_by("ts", timed), F.lit("")).alias("ended_at"),
        F.coalesce(F.sum(F.when(count, get("input_tokens"))), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum(F.when(count, get("output_tokens"))), F.lit(0)).alias("output_tokens"),
    )
    said = codex_messages(parsed).groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"))
    names = codex_calls(parsed).groupBy("session_id", "name").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
    tools = names.groupBy("session_id").agg(F.sum("n").alias("tool_calls"), F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("t"))
    none = F.array().cast("array<string>")
    both = head.join(said, "session_id", "left").join(tools, "session_id", "left")
    return both.select(
        "session_id", "log_id", "project", "branch", "started_at", "ended_at", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("user_messages", "assistant_messages")), "input_tokens", "output_tokens",
        F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"), F.coalesce(F.transform("t", lambda x: x["name"]), none).alias("unique_tools"), none.alias("files_modified"),
    )


def codex_model(parsed: DataFrame) -> DataFrame:
    """``session_id, model`` of the first ``session_meta``."""
    at = F.when(F.col("type") == "session_meta", F.col("line_no"))
    return parsed.groupBy("session_id").agg(F.min_by(_field("model"), at).alias("model"))


def parse(lines: DataFrame, agent_col: str = "agent") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, messages and tool calls of ``lines (session_id, line_no, line)`` of both kinds, by the agent.

    Sessions are ``session_id, agent`` and the columns of ``sessions``; messages
    ``session_id, idx, role, content, ts``; calls ``session_id, idx, tool_idx, name, input,
    output``, ``idx`` being that of their message. Any agent but ``claude-code`` has logs of
    the second kind, whose calls go to messages by ``attach_in_order``; those that none takes
    are left out.
    """
    agents = lines.groupBy("session_id").agg(F.first(agent_col).alias("agent"))
    first = entries(lines.where(F.col(agent_col) == "claude-code"))
    second = codex_entries(lines.where(F.col(agent_col) != "claude-code"))
    rows = sessions(first).unionByName(codex_sessions(second)).join(agents, "session_id")
    said = codex_messages(second)
    every = messages(first).select("session_id", F.col("line_no").alias("idx"), "role", "content", "ts").unionByName(said.select("session_id", F.col("line_no").alias("idx"), "role", "content", "ts"))
    calls = tool_calls(first).select("session_id", F.col("line_no").alias("idx"), "tool_idx", "name", "input", "output")
    at = lambda c: F.try_to_timestamp(F.nullif(F.col(c), F.lit("")))
    spoken = said.where("role = 'assistant'").select("session_id", F.col("line_no").alias("idx"), at("ts").alias("ts"))
    called = codex_calls(second).withColumn("at", at("ts"))
    attached = attach_in_order(spoken, called.select("session_id", "ord", F.col("at").alias("ts")))
    more = called.join(attached, ["session_id", "ord"])
    more = more.select("session_id", "idx", F.col("ord").cast("int").alias("tool_idx"), "name", "input", F.lit("").alias("output"))
    return rows, every, calls.unionByName(more)
