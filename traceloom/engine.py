"""Commands as functions on tables: list, preview and distill sessions.

``distill`` is the whole way from parsed sessions to documents that may be written: gate,
prompt, reply, rendering, filter, name, comparison with what is there, and an outcome code.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import documents, mining, parsing, prompts, redaction, similarity
from .sources import reports, session_logs


def log_lines(spark: SparkSession, catalog: DataFrame) -> DataFrame:
    """``session_id, agent, line_no, line`` of a bounded catalogue's files; only those files are opened.

    Files of another size than a log may have are not read.
    """
    rows = session_logs.within(catalog).select("path", "session_id", "agent").collect()  # as many as the catalogue's limit
    if not rows:
        return spark.createDataFrame([], "session_id string, agent string, line_no int, line string")
    held = spark.createDataFrame([(_plain(r["path"]), r["session_id"], r["agent"]) for r in rows], "_p string, session_id string, agent string")
    text = spark.read.text([r["path"] for r in rows], wholetext=True)
    text = text.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("_p"), T.trim(F.col("value")).alias("v"))
    return text.join(F.broadcast(held), "_p").select("session_id", "agent", F.inline(session_logs.numbered(F.col("v"))))


def _plain(path: str) -> str:
    """A path as one reader or another writes it, alike."""
    return re.sub("^file:/+", "/", path)


def corpus_lines(spark: SparkSession, root: str, agent: str, low: int = session_logs.MINED_BYTES[0], high: int = session_logs.MINED_BYTES[1]) -> DataFrame:
    """``session_id, agent, line_no, line`` of all logs below a root with a size between the two, for mining; no links."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    some = text.where(F.col("_metadata.file_size").between(low, high)).select(path.alias("path"), T.trim(F.col("value")).alias("v")).where(session_logs.is_regular(root)(F.col("path")))
    return some.select(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("session_id"), F.lit(agent).alias("agent"), F.inline(session_logs.numbered(F.col("v"))))


def parse_sessions(spark: SparkSession, claude_root: str, codex_root: str, agent: str | None = None, limit: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, messages and calls (``parsing.parse``) of the last modified logs that are small enough."""
    return parsing.parse(log_lines(spark, session_logs.every_catalog(spark, claude_root, codex_root, agent, limit)))


def list_sessions(spark: SparkSession, claude_root: str, codex_root: str, agent: str | None = None, limit: int = 10) -> DataFrame:
    """``session_id, line`` of the last modified sessions."""
    return reports.session_lines(session_logs.every_catalog(spark, claude_root, codex_root, agent, limit))


def preview(sessions: DataFrame) -> DataFrame:
    """``session_id, text``: what each session did."""
    return reports.preview(sessions)


def distill(sessions: DataFrame, messages: DataFrame, calls: DataFrame, created: str, *, replies: DataFrame | None = None, existing: DataFrame | None = None, policy: str = "abort",
            forced: bool = False, threshold: str = "0.80", home: str = "") -> DataFrame:
    """``session_id, code, mode, file, document, violations, matches`` of each session.

    ``replies (session_id, provider, has_key, tool_input, judge_reply, judge_error, reply)`` are
    what the two models said to ``prompts.judge_prompt`` and ``prompts.distill_prompt``; without
    them every document is the offline one. ``existing (path, text)`` are the documents of the
    folder; None leaves the comparison out. A session without an outcome code of 0 or 9 has no
    document. ``code`` is that of ``prompts.outcome_code``.
    """
    base = prompts.template(sessions, messages, created, policy).withColumnRenamed("document", "template")
    rows = sessions.join(base, "session_id")
    found = F.size("matches") > 0
    if replies is None:
        rows = rows.withColumns({"mode": F.lit("template"), "document": F.col("template"), "distillable": F.lit(True), "aborted": F.lit(False), "secrets": found & F.col("template").isNull()})
    else:
        sent = prompts.scanned_prompt(prompts.distill_prompt(sessions, messages, calls, home=home), policy)
        sent = sent.select("session_id", "status", F.col("matches").alias("prompt_matches"))
        counts = sessions.select("session_id", F.size("files_modified").alias("files"), F.col("tool_calls").alias("tools"))
        asked = replies.join(counts, "session_id").withColumnsRenamed({"judge_reply": "_judge", "reply": "_reply"}).withColumnsRenamed({"_judge": "reply", "judge_error": "error"})
        verdicts = mining.local_signals(prompts.judged(asked)).select("session_id", "distillable", F.col("_reply").alias("reply"))
        rows = rows.join(verdicts, "session_id", "left").join(sent, "session_id")
        routed = prompts.distilled(rows.withColumns({"created": F.lit(created), "forced": F.lit(forced)}))
        rows = routed.withColumns({"aborted": (F.col("kind") == "abort"), "secrets": F.col("status") == "aborted", "matches": F.concat("matches", "prompt_matches")})
    rows = rows.withColumn("_text", T.truncate_document(F.col("document")))
    rows = documents.filter_output(rows, "_text")
    rows = rows.withColumns({"file": prompts.file_name_of(F.col("clean"), F.col("log_id")), "duplicate": F.lit(False)})
    if existing is not None:
        limit = similarity.parse_threshold(threshold)
        compared = similarity.gate(rows.select(F.col("session_id").alias("id"), F.col("clean").alias("text")), existing, limit)
        rows = rows.drop("duplicate").join(compared.select(F.col("id").alias("session_id"), "duplicate"), "session_id")
    code = prompts.outcome_code(secrets=F.col("secrets"), distillable=F.col("distillable"), aborted=F.col("aborted"), forced=F.lit(forced), duplicate=F.col("duplicate"))
    rows = rows.withColumn("code", code)
    document = F.when(F.col("code").isin(0, 9), F.col("clean"))
    return rows.select("session_id", "code", "mode", "file", document.alias("document"), "violations", "matches")


def observe_findings(scanned: DataFrame, name: str = "findings") -> tuple[DataFrame, object]:
    """``scanned`` (of ``redaction.scan``) with a metric of fields with findings and of all findings, known once it has run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return scanned.observe(seen, F.count_if(F.size("kinds") > 0).alias("fields"), F.coalesce(F.sum(F.size("kinds")), F.lit(0)).alias("findings")), seen


def summarize_findings(scanned: DataFrame) -> DataFrame:
    """``line``: each kind with the number of fields that hold it, the most frequent first."""
    return redaction.count_kinds(scanned).orderBy(F.desc("n"), "kind").select(F.concat(F.lit("  - "), F.col("kind"), F.lit(": "), F.col("n").cast("string")).alias("line"))
