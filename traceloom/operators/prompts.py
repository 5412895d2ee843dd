"""Prompts, the offline document, and what comes of replies.

Tables as in ``parsing.parse``: sessions ``session_id, agent, project, unique_tools,
files_modified, tool_calls``; messages ``session_id, idx, role, content``; calls
``session_id, idx, tool_idx, name, input, output``, with ``idx`` of their message. A
session without messages or calls has empty blocks. Null ids are left out. Model calls are
outside: a reply is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tool_lines import UNBOUNDED, anonymize, tool_line
from . import redaction
from .documents import PROMPT_VERSION, TAGS, payload, render
from .sessions import cap_last, last_outputs

# The prompts' texts around what a session puts in.
DISTILL_HEAD = "You are a skill extraction engine. Extract the REUSABLE PATTERN from this AI agent session into a single JSON object.\n\n## Session\n"
DISTILL_BODY = """
---

## Your task

Output EXACTLY ONE valid JSON object. No prose before or after. No code fences.

### If the session is distillable, use this schema:

{
  "name": "kebab-case-descriptive-name",
  "description": "one sentence describing what this skill does, from the agent's perspective",
  "when_to_use": "1-3 sentences naming the TRIGGER situation. What signal in a future conversation should make the agent reach for this skill?",
  "steps": ["step 1", "step 2", "..."],
  "example": "one short narrative: User asked X → agent did Y → result Z",
  "key_decisions": ["non-obvious rule 1", "gotcha 2", "..."],
  "tags": ["tag1", "tag2"],
  "confidence": "high" | "medium" | "low",
  "why_this_worked": "one sentence naming the single key insight"
}

### If the session is NOT distillable, use this schema instead:

{"abort": "no_artifact" | "no_reusable_pattern", "reason": "<one short sentence>"}

---

## Hard rules

1. **No tool names in steps.** Describe WHAT was accomplished, not WHICH tool was invoked.
   - BAD: "Use Bash to run npm test"
   - GOOD: "Run the full test suite first to get the exact failure output"

2. **No absolute paths.** Use relative paths (src/foo.ts). Never `/Users/<name>/` or `/home/<name>/`.

3. **Only the causal chain.** If the session had abandoned attempts before the working fix, include ONLY the steps that led to the successful outcome. Discard dead ends.

4. **Abort protocol.** Emit `{"abort": "no_artifact", ...}` if the session produced no concrete artifact (no files modified, no successful commands, no resolved answer). Emit `{"abort": "no_reusable_pattern", ...}` if every step is generic ("read a file", "search the codebase") without a specific goal a future agent could recognize.

5. **Section caps.**
   - `steps`: max 8, each one single-line.
   - `key_decisions`: max 5 bullets.
   - `description`: ≤ 140 chars.
   - `when_to_use`: ≤ 3 sentences.

6. **Tags from this closed taxonomy ONLY (pick 2-4):**
   {TAGS}

---

## Example 1 — distillable session

Intent: "Tests broke after the auth refactor."
Actions: ran test suite → read failing test → read source → fixed import → re-ran.
Outcome: tests/auth.test.ts modified, full suite green.

Output:
{
  "name": "debug-failing-tests",
  "description": "Systematically debug and fix failing tests by reading errors and tracing to root cause",
  "when_to_use": "When tests fail after refactoring, dependency upgrades, or merges. Apply before guessing at fixes.",
  "steps": [
    "Run the full test suite first — don't guess failures from file names",
    "Read the failing test to see what it asserts",
    "Read the source under test to find where it diverges from the test's expectation",
    "Check git diff to narrow the time window of the break",
    "Fix the root cause, not the test — unless the test was wrong",
    "Re-run only the failing test to verify",
    "Run the full suite to catch regressions"
  ],
  "example": "Agent ran npm test, saw 3 failures in auth.test.ts expecting validateToken. Read source and found it was renamed to verifyToken during refactor. Fixed the import alias. Full suite green.",
  "key_decisions": [
    "Fix source over test when the test was correct before",
    "Always run full suite after, not just the broken test",
    "Narrow scope with git diff before reading widely"
  ],
  "tags": ["testing", "debugging", "refactor"],
  "confidence": "high",
  "why_this_worked": "Reading the source before touching the test surfaced the rename as the true root cause"
}

## Example 2 — non-distillable session

Intent: "What's in this repo? Never saw it."
Actions: ls, read README, read package.json, grep TODO.
Outcome: no files modified, agent summarized findings.

Output:
{"abort": "no_artifact", "reason": "Pure exploration with no concrete outcome — agent summarized but produced nothing reusable"}
""".replace("{TAGS}", ", ".join(TAGS))
JUDGE_HEAD = """You are a quality gate for skill extraction. Decide whether this agent session contains a REUSABLE PATTERN worth turning into a skill.

A session IS distillable when ALL of these hold:
1. It produced a concrete artifact (files modified, commands completed, or a specific answer to a posed question).
2. The pattern could plausibly be reused in a future session with different specifics.
3. Steps are not entirely generic tool usage — there is a goal you can name in one sentence.

A session is NOT distillable when:
- It was pure exploration with no outcome.
- The user abandoned the task or ended without success.
- Every action was generic ("read the file", "search the codebase") without a specific goal.

## Session

### Intent (first user message)
"""
JUDGE_TAIL = """

## Output

Emit EXACTLY this JSON object, nothing else, no prose, no code fences:

{"distillable": <true|false>, "reason": "<one short sentence>", "confidence": "<high|medium|low>"}"""
LEGACY_HEAD = "You are a skill extraction engine. Analyze this AI agent session and distill the successful pattern into a reusable skill.\n\n## Session Info\n"
LEGACY_TASK = """

## Your Task

Extract the reusable pattern from this session. Output a SKILL.md with this exact format:

```markdown
---
name: <kebab-case-name>
description: <one line description of what this skill does>
"""
LEGACY_TAIL = """
tags:
  - <tag1>
  - <tag2>
---

# <Skill Name>

## When to use
<1-3 sentences describing when an agent should use this skill>

## Steps
<Numbered list of concrete steps the agent should follow>

## Example
<Short example showing input and expected output>

## Key decisions
<Bullet list of important decisions or gotchas discovered during the session>
```

Rules:
- Be specific and actionable, not generic
- Include actual file paths, commands, or patterns from the session
- The skill should be usable by someone who never saw the original session
- Keep it under 100 lines"""
TEMPLATE_USE = """
## When to use
Template stub — this file captures the shape of the session but has no distilled pattern.
Re-run `{tool} distill --llm <session-id>` to generate an actionable skill.

## Steps
1. Re-run with `--llm` and a configured API key to distill a real pattern.

## Example
"""
TEMPLATE_END = """
## Key decisions
- (none — template mode does not extract decisions)

## Why this worked
(not captured — template mode)
"""


def _say(*parts: Column | str) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _or(c: Column, other: str) -> Column:
    """The text, or another where there is none."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(other))


def _files(home: str) -> Column:
    return F.array_join(F.transform("files_modified", lambda f: anonymize(f, F.col("project"), home)), ", ")


def _joined(rows: DataFrame, order: list[str], text: Column, glue: str, name: str) -> DataFrame:
    """One text a session of its rows in order."""
    got = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("_x")))).alias("_l"))
    return got.select("session_id", F.array_join(F.transform("_l", lambda x: x["_x"]), glue).alias(name))


def _ends(messages: DataFrame) -> DataFrame:
    """``session_id, intent, outcome``: the first user message, and the last of the assistant's that is not empty."""
    user, said = F.col("role") == "user", (F.col("role") == "assistant") & (F.col("content") != "")
    return messages.groupBy("session_id").agg(F.min_by("content", F.when(user, F.col("idx"))).alias("intent"), F.max_by("content", F.when(said, F.col("idx"))).alias("outcome"))


def distill_prompt(sessions: DataFrame, messages: DataFrame, calls: DataFrame, *, home: str = "", most: int = 1000) -> DataFrame:
    """``session_id, prompt, matches, dropped`` of each session.

    The last ``most`` messages and their calls are told. Every field is scanned for
    credentials whole and redacted, and only then cut; ``matches`` are ``location, kinds`` of
    the fields with findings, in order of their place.
    """
    capped = cap_last(messages, most)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("idx", "role", "content")) - 1
    capped = capped.withColumn("mi", place)
    roots = sessions.select("session_id", "project")
    told = calls.join(capped.groupBy("session_id", "idx").agg(F.min("mi").alias("mi")), ["session_id", "idx"]).join(roots, "session_id")
    told = told.withColumn("ti", F.row_number().over(Window.partitionBy("session_id", "mi").orderBy("tool_idx")) - 1)
    ends = roots.join(_ends(capped), "session_id", "left")
    nothing = F.lit(None).cast("string")

    def fields(rows: DataFrame, part: int, mi: Column, ti: Column, role: Column, location: Column, text: Column) -> DataFrame:
        return rows.select("session_id", F.lit(part).alias("part"), mi.cast("int").alias("mi"), ti.cast("int").alias("ti"), role.alias("role"), location.alias("location"), text.alias("text"))

    zero = F.lit(0)
    every = (
        fields(ends, 0, zero, zero, nothing, F.lit("intent"), F.coalesce("intent", F.lit("(no user message)")))
        .unionByName(fields(capped, 1, F.col("mi"), zero, F.col("role"), _say("message[", F.col("mi"), "]"), F.col("content")))
        .unionByName(fields(told, 2, F.col("mi"), F.col("ti"), nothing, _say("tool-call[", F.col("mi"), "][", F.col("ti"), "]"), tool_line(F.col("name"), F.col("input"), F.col("project"), home, UNBOUNDED)))
        .unionByName(fields(ends, 3, zero, zero, nothing, F.lit("outcome"), F.coalesce("outcome", F.lit("(no final assistant message)"))))
    )
    limits = F.element_at(F.array(*map(F.lit, (600, 500, 400, 400))), F.col("part") + 1)
    scanned = redaction.scan(every).select("session_id", "part", "mi", "ti", "role", "location", "kinds", F.substring(F.col("redacted"), F.lit(1), limits).alias("short"))
    one = F.struct("part", "mi", "ti", "role", "short", "location", "kinds")
    by = scanned.groupBy("session_id").agg(F.array_sort(F.collect_list(one)).alias("f"))
    of = lambda part, text: F.transform(F.filter("f", lambda x: x["part"] == part), text)
    short = lambda x: x["short"]
    by = by.select(
        "session_id", of(0, short)[0].alias("intent"), F.array_join(of(1, lambda x: _say(x["role"], ": ", x["short"])), "\n\n").alias("conversation"),
        F.array_join(of(2, lambda x: _say("- ", x["short"])), "\n").alias("actions"), of(3, short)[0].alias("outcome"),
        F.transform(F.filter("f", lambda x: F.size(x["kinds"]) > 0), lambda x: F.struct(x["location"].alias("location"), x["kinds"].alias("kinds"))).alias("matches"),
    )
    project = F.when(F.col("project").startswith("/"), T.file_base_name(F.col("project"))).otherwise(F.col("project"))
    prompt = _say(
        DISTILL_HEAD, "\n### Project\n", project, "\n\n### Intent (first user message)\n", F.col("intent"), "\n\n### Conversation\n", F.col("conversation"), "\n\n### Actions taken\n", _or(F.col("actions"), "(no tool calls)"),
        "\n\n### Outcome\n- Files modified: ", _or(_files(home), "(none)"), "\n- Tool calls: ", F.col("tool_calls"), "\n- Tools used: ", F.array_join("unique_tools", ", "),
        "\n- Final assistant message: ", F.col("outcome"), "\n", DISTILL_BODY,
    )
    dropped = capped.groupBy("session_id").agg(F.first("dropped").alias("dropped"))
    both = sessions.join(by, "session_id").join(dropped, "session_id", "left")
    return both.select("session_id", prompt.alias("prompt"), "matches", F.coalesce("dropped", F.lit(0)).alias("dropped"))


def judge_prompt(sessions: DataFrame, messages: DataFrame, calls: DataFrame, *, home: str = "") -> DataFrame:
    """``session_id, prompt`` for the quality gate; it has to go through ``scanned_prompt`` before it is sent."""
    ends = _ends(messages)
    bash = calls.where("name = 'Bash'").select("session_id", F.struct("idx", "tool_idx").alias("ord"), "output")
    both = sessions.join(ends, "session_id", "left").join(last_outputs(bash), "session_id", "left")
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 500)
    prompt = _say(
        JUDGE_HEAD, cut("intent"), "\n\n### Outcome signals\n- Files modified: ", _or(_files(home), "(none)"), "\n- Tool calls: ", F.col("tool_calls"), "\n- Tools used: ", F.array_join("unique_tools", ", "),
        "\n- Last 3 Bash outputs: ", _or(F.col("outputs"), "(none)"), "\n- Final assistant message: ", cut("outcome"), JUDGE_TAIL,
    )
    return both.select("session_id", prompt.alias("prompt"))


def legacy_prompt(sessions: DataFrame, messages: DataFrame, calls: DataFrame, created: str, *, most: int = 1000) -> DataFrame:
    """``session_id, prompt`` as the first version told a session: inputs as they are, nothing scanned."""
    capped = cap_last(messages, most)
    kept = calls.join(capped.select("session_id", "idx").distinct(), ["session_id", "idx"])
    line = F.substring(_say("- ", F.col("name"), ": ", F.col("input")), F.lit(1), F.length("name") + 204)
    tools = _joined(kept, ["idx", "tool_idx"], line, "\n", "tools")
    names = kept.groupBy("session_id", "idx").agg(F.array_sort(F.collect_list(F.struct("tool_idx", "name"))).alias("n"))
    used = F.when(F.size("n") > 0, _say("\n  [Tools: ", F.array_join(F.transform("n", lambda x: x["name"]), ", "), "]")).otherwise("")
    spoken = _joined(capped.join(names, ["session_id", "idx"], "left"), ["idx"], _say(F.col("role"), ": ", F.substring("content", 1, 500), used), "\n\n", "conversation")
    both = sessions.join(tools, "session_id", "left").join(spoken, "session_id", "left")
    empty = lambda c: F.coalesce(c, F.lit(""))
    prompt = _say(
        LEGACY_HEAD, "- Agent: ", F.col("agent"), "\n- Project: ", F.col("project"), "\n- Tool calls: ", F.col("tool_calls"), "\n- Tools used: ", F.array_join("unique_tools", ", "), "\n- Files modified: ",
        F.array_join("files_modified", ", "), "\n\n## Tool Calls\n", empty("tools"), "\n\n## Conversation\n", empty("conversation"), LEGACY_TASK, "source_session: ", F.col("log_id"),
        "\nsource_agent: ", F.col("agent"), f"\ncreated: {created}", LEGACY_TAIL,
    )
    return both.select("session_id", prompt.alias("prompt"))


def scanned_prompt(prompts: DataFrame, policy: str) -> DataFrame:
    """``prompts`` with ``status`` and ``sent``, what may leave: the whole prompt is scanned once more.

    Findings in fields (``matches``, if the column is there) count as findings of the prompt.
    """
    scanned = redaction.scan(prompts, "prompt")
    if "matches" in prompts.columns:
        inner = F.flatten(F.transform("matches", lambda m: m["kinds"]))
        scanned = scanned.withColumn("kinds", F.array_distinct(F.concat("kinds", inner)))
    return redaction.apply_policy(scanned, policy, "prompt").drop("redacted")


def template(sessions: DataFrame, messages: DataFrame, created: str, policy: str = "abort", *, tool: str = "traceloom") -> DataFrame:
    """``session_id, document, matches``: the offline document of each session.

    Project, files, first message (cut first) and tools are scanned by ``policy``; under
    ``abort`` a session with findings has no document. ``tool`` is the command that the text names.
    """
    first = messages.groupBy("session_id").agg(F.min_by("content", F.when(F.col("role") == "user", F.col("idx"))).alias("said"))
    rows = sessions.join(first, "session_id", "left")
    parts = [
        ("template:project", F.col("project")), ("template:files-modified", _or(F.array_join("files_modified", ", "), "none tracked")),
        ("template:first-user-message", F.substring(F.coalesce("said", F.lit("N/A")), 1, 200)), ("template:tools", F.array_join("unique_tools", ", ")),
    ]
    fields = rows.select("session_id", F.posexplode(F.array(*(F.struct(F.lit(name).alias("location"), c.alias("text")) for name, c in parts))).alias("i", "x")).select("session_id", "i", "x.*")
    sent = redaction.apply_policy(redaction.scan(fields), policy)
    by = sent.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("i", "location", "kinds", "sent", "status"))).alias("f"))
    get = lambda i: F.col("f")[i]["sent"]
    name = _say(T.project_slug(F.col("project")), "-", F.substring("log_id", 1, 8), "-stub")
    document = _say(
        "---\nname: ", name, "\ndescription: Template stub — session captured offline, re-run with --llm for a real skill\nsource_session: ", F.col("log_id"), "\nsource_agent: ", F.col("agent"),
        f"\ncreated: {created}\ndistill_prompt_version: {PROMPT_VERSION}-template\nconfidence: low\ntags:\n  - auto-extracted\n  - template-stub\n---\n\n# ", name, "\n", TEMPLATE_USE.replace("{tool}", tool),
        'Session started with: "', get(2), '"\nModified files: ', get(1), "\nTools used: ", get(3), "\nTotal tool calls: ", F.col("tool_calls"), "\n", TEMPLATE_END,
    )
    stopped = F.exists("f", lambda x: x["status"] == "aborted")
    found = F.transform(F.filter("f", lambda x: F.size(x["kinds"]) > 0), lambda x: F.struct(x["location"].alias("location"), x["kinds"].alias("kinds")))
    return rows.join(by, "session_id").select("session_id", F.when(~stopped, document).alias("document"), found.alias("matches"))


def judged(replies: DataFrame) -> DataFrame:
    """Adds ``distillable, reason, confidence`` to ``provider, has_key, tool_input, reply, error``.

    An unknown provider or a missing key leaves the gate open; a failed call, and a reply
    that says nothing readable, close it. ``tool_input`` (JSON) goes before ``reply`` (text).
    """
    from .documents import tool_verdict, verdict

    by_text = verdict(replies).withColumnsRenamed({"distillable": "_d", "reason": "_r", "confidence": "_c"})
    both = tool_verdict(by_text, "tool_input").withColumnsRenamed({"distillable": "_td", "reason": "_tr", "confidence": "_tc"})
    known, keyed = F.coalesce(F.col("provider").isin("anthropic", "openai"), F.lit(False)), F.coalesce("has_key", F.lit(False))
    # What is said where no verdict came.
    unknown, skipped = F.lit("unknown provider, judge skipped"), _say(F.upper("provider"), "_API_KEY not set, judge skipped")
    failed, by_tool = F.col("error").isNotNull(), F.col("tool_input").isNotNull()
    pick = lambda open_, closed, t, r: F.when(~known | ~keyed, open_).when(failed, closed).when(by_tool, t).otherwise(r)
    reason = F.when(~known, unknown).when(~keyed, skipped).when(failed, _say("judge call failed: ", F.col("error"))).when(by_tool, F.col("_tr")).otherwise(F.col("_r"))
    low = F.lit("low")
    out = {"distillable": pick(F.lit(True), F.lit(False), F.col("_td"), F.col("_d")), "reason": reason, "confidence": pick(low, low, F.col("_tc"), F.col("_c"))}
    return both.withColumns(out).drop("_d", "_r", "_c", "_td", "_tr", "_tc")


def distilled(rows: DataFrame, *, reply_col: str = "reply") -> DataFrame:
    """Adds ``kind, mode, document`` to ``session_id, agent, log_id, project, created, reply, template, forced``.

    ``kind`` is skill, abort or error as the reply has it. A skill is rendered (``mode`` llm);
    a failed or unreadable reply, and a forced abort, fall back to the ``template``; an abort
    has no document.
    """
    parsed = payload(rows, reply_col)
    fallback = _say(T.project_slug(F.col("project")), "-", F.substring("log_id", 1, 8))
    parsed = parsed.withColumn("name", F.when(F.col("name") == "untitled-skill", fallback).otherwise(F.col("name")))
    written = parsed.withColumn("_s", F.col("session_id")).withColumn("session_id", F.col("log_id")).withColumn("_d", render()).withColumn("session_id", F.col("_s"))
    forced = F.coalesce("forced", F.lit(False))
    stub = (F.col("kind") == "error") | ((F.col("kind") == "abort") & forced)
    mode = F.when(F.col("kind") == "skill", "llm").when(stub, "template")
    document = F.when(F.col("kind") == "skill", F.col("_d")).when(stub, F.col("template"))
    return written.select(*rows.columns, "kind", "abort", "reason", mode.alias("mode"), document.alias("document"))


def file_name_of(document: Column, session_id: Column) -> Column:
    """Name of a document's file without its ending: its ``name:``, else the session's id, made safe."""
    short = F.substring(session_id, 1, 8)
    raw = F.when(document.rlike(r"(?m)^name:\s*(.+)$"), T.trim(F.regexp_extract(document, r"(?m)^name:\s*(.+)$", 1))).otherwise(short)
    safe = T.file_name(raw, "")
    return F.when(safe == "", short).otherwise(safe)


def outcome_code(**flags: Column) -> Column:
    """Exit code of a run, 0 where nothing stops it; the first that holds in the order of the run.

    ``found, trusted, small, secrets, distillable, forced, aborted, bad_threshold, duplicate, inside,
    writable``, each a Boolean column; those left out do not stop a run.
    """
    get = lambda k, usual: F.coalesce(flags[k], F.lit(usual)) if k in flags else F.lit(usual)
    forced = get("forced", False)
    # What each code says.
    return (
        F.when(~get("found", True), 1).when(~get("trusted", True), 5).when(~get("small", True), 6).when(get("secrets", False), 2).when(~get("distillable", True) & ~forced, 7)
        .when(get("aborted", False) & ~forced, 8).when(get("bad_threshold", False), 2).when(get("duplicate", False), 9).when(~get("inside", True), 3).when(~get("writable", True), 4).otherwise(0)
    )
