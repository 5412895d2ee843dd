"""Scores, tiers and labels of sessions, and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import parsing

#: Boundaries are those of ASCII words, so that a final accented letter needs a letter behind it.
CONVERSATIONAL = (
    r"(?iu)(?<![A-Za-z0-9_])(qué opinás|que opinas|cómo va|como va|hablemos|contame|tenés acceso|entrevista|cómo invoco|luciana|juan compro|topo|cbd|florcita|hay otra terminal|otra terminal"
    r"|volví del gimnasio|volvi del gimnasio|cuanto debía|cuanto debia|ahí volví|ahi volvi|recordás|recordas|te acordás|te acordas|cómo quedamos|como quedamos|qué tengo para hacer|que tengo para hacer"
    r"|retomemos|como venimos|cómo venimos|charla|guardá|guarda en obsidian|cuales son las mejores|luciana constestó|constestó|cómo funcionás|como funcionas|porqué obsidian|new contributors)"
)
EXECUTION = r"(?iu)(?<![A-Za-z0-9_])((ejecut(á|a|ar) el plan|execute the plan|corré el plan)(?![A-Za-z0-9_])|ejecutá(?=[A-Za-z0-9_]))"


def sessions_of_logs(parsed: DataFrame) -> DataFrame:
    """One row a session of ``parsing.entries``, with what scores and labels need; those without messages go."""
    user = F.when(F.col("role") == "user", F.col("line_no"))
    first = parsing.messages(parsed).groupBy("session_id").agg(F.coalesce(F.min_by("content", user), F.lit("")).alias("first"))
    at = lambda k: F.unix_millis(F.try_to_timestamp(F.nullif(F.col(k), F.lit(""))))
    files = F.col("files_modified")
    return parsing.sessions(parsed).join(first, "session_id").select(
        "session_id", F.col("user_messages").alias("users"), F.col("tool_calls").alias("tools"), F.size(files).cast("long").alias("files"), T.has_code_file(files).alias("code"),
        T.has_code_file(files, config=True).alias("code_or_config"), F.coalesce(F.floor((at("ended_at") - at("started_at")) / 1000 + 0.5), F.lit(0)).cast("long").alias("duration"),
        F.col("input_tokens").alias("tokens"), F.contains("project", F.lit("/Projects/")).alias("in_projects"), T.slash_only(F.col("first")).alias("slash_only"),
        T.clean_intent(T.short_message(F.col("first"))).alias("intent"),
    )


def sessions_of_events(log: DataFrame) -> DataFrame:
    """One row a session of ``sources.tables.event_log``; durations in minutes stand for seconds."""
    tool = F.col("event_type") != "view"
    minutes = (F.max("epoch") - F.min("epoch")) / 60
    return log.groupBy("user_id", "bucket").agg(
        F.count_if(~tool).alias("users"), F.count_if(tool).alias("tools"), F.countDistinct("path").alias("files"),
        F.coalesce(F.max(F.col("path").endswith(".ts")), F.lit(False)).alias("code"), F.floor(minutes + 0.5).cast("long").alias("duration"), F.sum(F.floor("value")).cast("long").alias("tokens"),
    ).withColumns({"in_projects": F.col("user_id") % 2 == 0, "slash_only": F.col("user_id") % 5 == 0, "code_or_config": F.col("code"), "intent": F.lit("")})


def _rules() -> list[tuple[Column, int, Column]]:
    c = F.col
    say = lambda *x: F.concat(*(y if isinstance(y, Column) else F.lit(y) for y in x))
    # Rules in order, with their weights and reasons.
    return [
        (c("files") >= 1, 3, say("+3 files:", c("files"))), (c("code"), 3, say("+3 code-files")), ((c("tools") >= 3) & (c("tools") <= 30), 2, say("+2 tools-in-range:", c("tools"))),
        (c("in_projects"), 2, say("+2 in-Projects")), (c("users") >= 2, 1, say("+1 multi-turn:", c("users"))), (c("tokens") > 1000, 1, say("+1 tokens:", c("tokens"))),
        (c("tools") == 0, -3, say("-3 zero-tools")), (c("duration") < 60, -1, say("-1 short:", c("duration"), "s")), (c("tools") > 100, -2, say("-2 marathon:", c("tools"))), (c("slash_only"), -2, say("-2 slash-only-intent")),
    ]


def score(sessions: DataFrame) -> DataFrame:
    """Adds ``score``, ``reasons`` and ``tier``."""
    rules = _rules()
    total = sum((F.when(cond, n).otherwise(0) for cond, n, _ in rules), F.lit(0))
    reasons = F.array_compact(F.array(*(F.when(cond, text) for cond, _, text in rules)))
    sound = ~F.col("slash_only") & (F.col("tools") >= 3)
    tier = F.when(sound & F.col("code") & F.col("in_projects"), "A").when(sound & (F.col("files") >= 1), "B").otherwise("C")
    return sessions.withColumns({"score": total.cast("long"), "reasons": reasons, "tier": tier})


def classify(sessions: DataFrame) -> DataFrame:
    """Adds ``label`` and ``reason`` by ordered rules; a review's reason lists what is out of range."""
    c = F.col
    tools, files, duration = c("tools").between(4, 60), c("files").between(1, 15), c("duration").between(60, 3600)
    good = tools & files & duration & c("code_or_config")
    rules = [
        (c("tools") < 3, "not", "<3 tool calls"), (c("files") == 0, "not", "no files modified"), (c("duration") < 30, "not", "<30s duration"),
        ((F.length("intent") > 30) & c("intent").rlike(CONVERSATIONAL), "not", "conversational intent"), ((c("tools") > 200) & (c("duration") > 6 * 3600), "not", "marathon execution (>200 tools, >6h)"),
        (good & ~c("intent").rlike(EXECUTION), "distillable", "focused build/fix session"), (good, "distillable", "focused plan-execution session"),
    ]
    label, reason = (F.when(rules[0][0], rules[0][k]) for k in (1, 2))
    for cond, *texts in rules[1:]:
        label, reason = label.when(cond, texts[0]), reason.when(cond, texts[1])
    out = lambda name, unit="": F.concat(F.lit(f"{name}="), c({"dur": "duration"}.get(name, name)), F.lit(f"{unit} out-of-range"))
    review = F.array_join(F.array_compact(F.array(F.when(~tools, out("tools")), F.when(~files, out("files")), F.when(~duration, out("dur", "s")), F.when(~c("code_or_config"), "no-code-file"))), ", ")
    return sessions.withColumns({"label": label.otherwise("review"), "reason": reason.otherwise(review)})


def local_signals(judged: DataFrame) -> DataFrame:
    """Verdicts (``distillable, reason, confidence``) against what the session holds (``files, tools``).

    Nothing done overrules yes, with high confidence; much done is added to the reason of no.
    """
    c, say = F.col, lambda *x: F.concat(*(y if isinstance(y, Column) else F.lit(y) for y in x))
    nothing = c("distillable") & (c("files") == 0) & (c("tools") == 0)
    much = ~c("distillable") & (c("files") > 0) & (c("tools") > 5)
    reason = F.when(nothing, say("local signals contradict judge: 0 files modified and 0 tool calls (original: ", c("reason"), ")"))
    reason = reason.when(much, say(c("reason"), " (local signals suggest distillable: ", c("files"), " files modified, ", c("tools"), " tool calls — judge disagreed)"))
    return judged.withColumns({
        "distillable": c("distillable") & ~nothing, "reason": reason.otherwise(c("reason")), "confidence": F.when(nothing, "high").otherwise(c("confidence")),
    })


def candidates(scored: DataFrame) -> DataFrame:
    """Sessions worth a label: those with code in a project and at least 3 calls, then those of files and an intent.

    Unlike tier A, the first kind takes sessions of a slash command alone.
    """
    first = F.col("code") & F.col("in_projects") & (F.col("tools") >= 3)
    second = (F.col("files") >= 1) & (F.col("tools") >= 3) & ~F.col("slash_only")
    return scored.withColumn("candidate", F.when(first, 1).when(second, 2)).where("candidate is not null")


def fixture_check(rows: DataFrame) -> DataFrame:
    """Adds ``missing, unexpected, passes, details`` to ``expected_kind, must, must_not, kind, output``.

    ``kind`` is what came: skill, abort or error. A skill that was expected passes with all
    of ``must`` and none of ``must_not`` in it, whatever the case; an abort passes if one was expected.
    """
    has = lambda x: F.contains(F.lower("output"), F.lower(x))
    none = F.array().cast("array<string>")
    compared = (F.col("kind") == "skill") & (F.col("expected_kind") == "skill")
    missing = F.when(compared, F.filter(F.coalesce("must", none), lambda x: ~has(x))).otherwise(none)
    unexpected = F.when(compared, F.filter(F.coalesce("must_not", none), has)).otherwise(none)
    rows = rows.withColumns({"missing": missing, "unexpected": unexpected})
    passes = F.when(F.col("kind") == "abort", F.col("expected_kind") == "abort").otherwise(compared & (F.size("missing") == 0) & (F.size("unexpected") == 0))
    counts = F.concat(F.lit("missing="), F.size("missing"), F.lit(", unexpected="), F.size("unexpected"))
    details = F.when(compared, F.when(F.col("passes"), "All checks passed.").otherwise(counts)).when(F.col("kind") == "skill", "Expected abort but got a skill.")
    details = details.when(F.col("kind") == "abort", "Aborted").otherwise("Unexpected error")
    return rows.withColumn("passes", passes).withColumn("details", details)


def evaluation(results: DataFrame) -> DataFrame:
    """One row over ``expected_kind, kind, passes, prompt_chars``: passes, aborts and the mean prompt."""
    e, k = F.col("expected_kind"), F.col("kind")
    total = F.count("*")
    return results.agg(
        total.alias("total"), F.count_if("passes").alias("passing"), F.coalesce(F.floor(F.count_if("passes") / F.nullif(total, F.lit(0)) * 100 + 0.5), F.lit(0)).cast("long").alias("pass_pct"),
        F.count_if(e == "abort").alias("expected_aborts"), F.count_if((e == "abort") & (k == "abort")).alias("correct_aborts"), F.count_if(k == "abort").alias("aborts"),
        F.floor(F.avg("prompt_chars") + 0.5).cast("long").alias("avg_prompt_chars"),
    )


def confusion(rows: DataFrame) -> DataFrame:
    """One row: tp, fp, tn, fn and accuracy, precision, recall, F1 (0 where undefined) of ``expected, predicted``."""
    e, p = F.col("expected"), F.col("predicted")
    n = rows.agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(~e & ~p).alias("tn"), F.count_if(e & ~p).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col
    return n.withColumns({
        "accuracy": share(c("tp") + c("tn"), c("tp") + c("fp") + c("tn") + c("fn")), "precision": share(c("tp"), c("tp") + c("fp")),
        "recall": share(c("tp"), c("tp") + c("fn")), "f1": share(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
    })
