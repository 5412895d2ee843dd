"""Reports as rows of text, native, and their files.

Each function gives ``ord, line``; ``write_text`` writes them in order. Rankings number all
rows by a range-partitioned sort, not in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def _say(*parts: Column | str) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``n`` from 1 on: places in partitions of a sorted table, and how many rows stand before each."""
    ordered = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = ordered.groupBy(part.alias("_p")).count().orderBy("_p").collect()  # one row a partition
    starts, at = {}, 0
    for r in sizes:
        starts[r["_p"]], at = at, at + r["count"]
    if not starts:
        return ordered.withColumn("n", F.lit(0).cast("long")).drop("_id")
    begin = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv))[part]
    return ordered.withColumn("n", begin + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id")


def _tail(path: Column, parts: int) -> Column:
    every = F.split(path, "/")
    return F.array_join(F.slice(every, F.greatest(F.size(every) - parts + 1, F.lit(1)), parts), "/")


def _lines(spark: SparkSession, texts: list[str], start: int = 0) -> DataFrame:
    return spark.createDataFrame([(float(start), i, t) for i, t in enumerate(texts)], "major double, minor int, line string")


# The tables' headings.
MINED_HEAD = ("| # | Tier | Score | Tools | Files | Dur (s) | Tokens | Project | Intent | Class |", "|---|:----:|------:|------:|------:|--------:|-------:|---------|--------|-------|")
LABELS_HEAD = ("| # | Label | Reason | Tools | Files | Dur | Tokens-in | Project | Intent |", "|---|-------|--------|------:|------:|----:|----------:|---------|--------|")
LEGEND = (
    "- **score**: heuristic (+3 files, +3 code-files, +2 tools 3-30, +2 in-Projects, +1 multi-turn, +1 tokens>1k, −3 zero-tools, −1 short, −2 marathon, −2 slash-only-intent)",
    "- **tier**: A = promising (code files, Projects dir, real intent), B = maybe, C = skip",
    "- Classification column is empty — edit this file in place adding `distillable` / `not` / `maybe` / `skip`.",
)


def mining_report(mined: DataFrame, title: str, subtitle: str, home: str = "") -> DataFrame:
    """The report of ``mining.score`` rows with ``path, project, branch, size_kb, first, last, unique_tools, files_modified, output_tokens``.

    By score, ties by path; ``first`` and ``last`` are the short messages.
    """
    c, short = F.col, lambda p: T.short_path(p, home) if home else p
    rows = _numbered(mined, F.desc("score"), "path")
    n = c("n").cast("string")
    project = F.coalesce(F.nullif(_tail(short(c("project")), 2), F.lit("")), F.lit("?"))
    table = _say("| ", n, " | ", c("tier"), " | ", c("score"), " | ", c("tools"), " | ", c("files"), " | ", c("duration"), " | ", c("tokens"), " | ", project, " | ", T.md_cell(T.short_message(c("first"), 80)), " |  |")
    some = F.transform(F.slice("files_modified", 1, 5), lambda f: _say("`", _tail(short(f), 3), "`"))
    quoted = lambda k: _say("> ", F.coalesce(F.nullif(F.replace(c(k), F.lit("\n"), F.lit(" ")), F.lit("")), F.lit("_(empty)_")))
    details = F.array(
        _say("### ", n, ". [", c("tier"), "] `", _tail(short(c("path")), 3), "`"), F.lit(""), _say("- **Score**: ", c("score"), " · **Reasons**: ", F.array_join("reasons", ", ")),
        _say("- **Project**: `", short(c("project")), "` · **Branch**: `", c("branch"), "`"),
        _say("- **Size**: ", c("size_kb"), " KB · **Duration**: ", c("duration"), "s · **Tool calls**: ", c("tools"), " (", F.array_join("unique_tools", ", "), ")"),
        _say("- **Files modified** (", c("files"), "): ", F.coalesce(F.nullif(F.array_join(some, ", "), F.lit("")), F.lit("(none)"))), _say("- **Tokens**: in ", c("tokens"), " / out ", c("output_tokens")),
        F.lit(""), F.lit("**Intent**:"), F.lit(""), quoted("first"), F.lit(""), F.lit("**Outcome hint** (last assistant message):"), F.lit(""), quoted("last"), F.lit(""),
        F.lit("**Classification**: _______"), F.lit(""), F.lit("---"), F.lit(""),
    )
    spark = mined.sparkSession
    head = _lines(spark, [f"# {title}", "", subtitle, "", "## Legend", "", *LEGEND, "", "## Summary table", "", *MINED_HEAD])
    between = _lines(spark, ["", "## Per-session detail", ""], 2)
    body = rows.select((F.lit(1.0)).alias("major"), F.col("n").cast("int").alias("minor"), table.alias("line"))
    told = rows.select((F.lit(2.0) + F.col("n")).alias("major"), F.posexplode(details).alias("minor", "line"))
    return head.unionByName(body).unionByName(between).unionByName(told)


def label_report(labelled: DataFrame, home: str = "") -> DataFrame:
    """The proposal of labels of ``mining.classify`` rows with ``project, candidate, score, path``: a table a label."""
    c, spark = F.col, labelled.sparkSession
    counts = {r[0]: r[1] for r in labelled.groupBy("label").count().collect()}  # three labels
    kinds = (("distillable", "Distillable (should produce skill)"), ("not", "Not-distillable (should abort)"), ("review", "Review (borderline)"))
    head = ["# Classification proposal — Tier A + B sessions", "", f"Auto-classified {sum(counts.values())} sessions.", ""]
    says = {"distillable": "expected to produce a skill", "not": "expected to abort", "review": "borderline — needs human call"}
    head += [f"- **{k}**: {counts.get(k, 0)} ({says[k]})" for k, _ in kinds] + ["", "Flip a row's label by editing it in place.", ""]
    out = _lines(spark, head)
    project = F.coalesce(F.nullif(_tail(T.short_path(c("project"), home) if home else c("project"), 2), F.lit("")), F.lit("?"))
    for i, (kind, title) in enumerate(kinds):
        rows = _numbered(labelled.where(c("label") == kind), F.col("candidate"), F.desc("score"), F.col("path"))
        line = _say("| ", c("n").cast("string"), " | ", c("label"), " | ", c("reason"), " | ", c("tools"), " | ", c("files"), " | ", c("duration"), "s | ", c("tokens"), " | ", project, " | ", T.md_cell(F.substring("intent", 1, 70)), " |")
        body = rows.select(F.lit(2.0 * i + 2).alias("major"), F.col("n").cast("int").alias("minor"), line.alias("line"))
        out = out.unionByName(_lines(spark, [f"## {title} ({counts.get(kind, 0)})", "", *LABELS_HEAD], 2 * i + 1)).unionByName(body).unionByName(_lines(spark, [""], 2 * i + 2).withColumn("major", F.lit(2.0 * i + 2.5)))
    return out


def confusion_report(metrics: DataFrame) -> DataFrame:
    """The judge's report, of the one row of ``mining.confusion``."""
    c = F.col
    total, right = c("tp") + c("fp") + c("tn") + c("fn"), c("tp") + c("tn")
    pct = lambda k: F.format_string("%.1f%%", c(k) * 100)
    lines = F.array(
        F.lit("# Judge Eval"), F.lit(""), _say("Fixtures: ", total, " (", c("tp") + c("fn"), " distillable, ", c("tn") + c("fp"), " not)"), F.lit(""), F.lit("## Confusion matrix"), F.lit(""),
        F.lit("|              | judged distillable | judged not |"), F.lit("|--------------|--------------------|------------|"), _say("| **distillable** | TP = ", c("tp"), " | FN = ", c("fn"), " |"),
        _say("| **not**         | FP = ", c("fp"), " | TN = ", c("tn"), " |"), F.lit(""), F.lit("## Metrics"), F.lit(""), _say("- **Accuracy**: ", pct("accuracy"), " (", right, "/", total, ")"),
        _say("- **Precision**: ", pct("precision"), " — when the judge says distillable, how often is it right"), _say("- **Recall**: ", pct("recall"), " — of the truly distillable sessions, how many does the judge catch"),
        _say("- **F1**: ", pct("f1")),
    )
    return metrics.select(F.lit(0.0).alias("major"), F.posexplode(lines).alias("minor", "line"))


def evaluation_report(metrics: DataFrame) -> DataFrame:
    """The metrics of an evaluation, of the one row of ``mining.evaluation``."""
    c = F.col
    lines = F.array(
        F.lit("## Metrics"), F.lit(""), _say("- **Pass rate:** ", c("passing"), "/", c("total"), " (", c("pass_pct"), "%)"),
        _say("- **Abort accuracy:** ", c("correct_aborts"), "/", c("expected_aborts"), " exploratory fixtures correctly aborted"), _say("- **Total aborts emitted:** ", c("aborts")),
        _say("- **Avg prompt size:** ", F.coalesce(c("avg_prompt_chars"), F.lit(0)), " chars"),
    )
    return metrics.select(F.lit(0.0).alias("major"), F.posexplode(lines).alias("minor", "line"))


def session_lines(sessions: DataFrame) -> DataFrame:
    """``session_id, line`` of a list of the catalogue: agent, date, size and the id's beginning."""
    size = F.lpad(F.format_string("%.1f", F.col("size_bytes") / 1024), 8, " ")
    line = _say("  ", F.rpad("agent", 12, " "), " ", F.date_format("modified_at", "yyyy-MM-dd"), "  ", size, "KB  ", F.substring("session_id", 1, 8), "...")
    return sessions.select("session_id", line.alias("line"))


def preview(sessions: DataFrame) -> DataFrame:
    """``session_id, text``: what a parsed session did, without control characters."""
    safe, c = T.terminal_safe, F.col
    listed = lambda k: F.array_join(F.transform(k, safe), ", ")
    text = _say(
        "Session: ", F.substring(safe(c("log_id")), 1, 8), "...\nAgent:   ", safe(c("agent")), "\nProject: ", safe(c("project")), "\nBranch:  ", safe(c("branch")), "\nMessages: ", c("user_messages"), " user, ",
        c("assistant_messages"), " assistant\nTools:   ", c("tool_calls"), " calls (", listed("unique_tools"), ")\nTokens:  ", c("input_tokens"), " in / ", c("output_tokens"), " out\nFiles:   ",
        F.coalesce(F.nullif(listed("files_modified"), F.lit("")), F.lit("none tracked")),
    )
    return sessions.select("session_id", text.alias("text"))


def mined_json(mined: DataFrame) -> DataFrame:
    """``value``: a session of ``mining_report``'s input as the JSON that ``session_logs.mined_sessions`` reads; no tier."""
    c = F.col
    session = F.struct(
        c("session_id").alias("sessionId"), "project", "branch", c("tools").alias("totalToolCalls"), c("files_modified").alias("filesModified"), F.struct(c("tokens").alias("input"), c("output_tokens").alias("output")).alias("totalTokens"),
        F.struct(c("users").alias("userMessages"), c("unique_tools").alias("uniqueTools")).alias("summary"),
    )
    row = F.struct(c("path").alias("filePath"), c("size_kb").alias("sizeKb"), "score", c("reasons").alias("scoreReasons"), c("first").alias("firstUserMessage"), c("last").alias("lastAssistantMessage"), c("duration").alias("durationSec"), session.alias("session"))
    return mined.select(F.to_json(row).alias("value"))


def write_text(lines: DataFrame, folder: str) -> None:
    """The lines in order as text files; their names sort like the lines."""
    lines.orderBy("major", "minor").select(F.coalesce("line", F.lit("")).alias("value")).write.mode("errorifexists").text(folder)
