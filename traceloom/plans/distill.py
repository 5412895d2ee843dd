"""Queries of prompts, documents, verdicts, mining and paths over sessions made of the test tables.

A conversation is a session; its assistant's turns call tools: a fourth writes a file, the
others run a command. A user's events are a log file of either kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tool_lines as L
from ..operators import documents as D
from ..operators import mining, parsing, prompts, similarity
from ..operators.sessions import first_seen
from ..sources import reports, tables
from ..sources.tables import table
from .catalogue import jaro_winkler_sql, query

HOME, CREATED = "/home/me", "2026-01-31"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _session_tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    said = tables.messages(table(spark, d, "conversations")).where("role in ('user', 'assistant')")
    root = F.concat(F.lit("/w/p"), F.col("session_id") % 3)
    wrote = F.col("idx") % 4 == 1
    path = F.when(F.col("idx") % 8 == 1, F.concat(root, F.lit("/src/f"), F.col("idx"), F.lit(".ts"))).otherwise(F.concat(F.lit(f"{HOME}/up/"), F.col("idx"), F.lit(".md")))
    calls = said.where("role = 'assistant'").select(
        "session_id", "idx", F.lit(0).alias("tool_idx"), F.when(wrote, "Write").otherwise("Bash").alias("name"),
        F.when(wrote, F.to_json(F.struct(path.alias("file_path"), F.concat(F.lit("a\n"), F.col("idx"), F.lit("\nb")).alias("content"))))
        .otherwise(F.to_json(F.struct(F.concat(F.lit("run "), F.col("idx")).alias("command")))).alias("input"),
        F.when(wrote, "").otherwise(F.concat(F.lit("out "), F.col("idx"))).alias("output"), F.when(wrote, path).alias("path"),
    )
    tools = first_seen(calls, "session_id", "idx", "name").withColumnRenamed("values", "unique_tools")
    files = first_seen(calls, "session_id", "idx", "path").withColumnRenamed("values", "files_modified")
    sizes = calls.groupBy("session_id").agg(F.count("*").alias("tool_calls"))
    rows = said.select("session_id").distinct().join(tools, "session_id", "left").join(files, "session_id", "left").join(sizes, "session_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.select(
        "session_id", F.lit("claude-code").alias("agent"), F.concat(F.lit("log"), F.col("session_id").cast("string"), F.lit("-0000")).alias("log_id"), root.alias("project"), F.lit("main").alias("branch"),
        F.coalesce("unique_tools", none).alias("unique_tools"), F.coalesce("files_modified", none).alias("files_modified"), F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"),
    )
    return rows, said, calls


_S = f"""WITH m AS (SELECT conv_id AS session_id, turn AS idx, role, coalesce(text, '') AS content FROM conversations WHERE role IN ('user', 'assistant')),
c AS (SELECT session_id, idx, idx % 4 = 1 AS wrote, '/w/p' || session_id % 3 AS root, CASE WHEN idx % 8 = 1 THEN '/w/p' || session_id % 3 || '/src/f' || idx || '.ts' ELSE '{HOME}/up/' || idx || '.md' END AS path,
  CASE WHEN idx % 8 = 1 THEN 'src/f' || idx || '.ts' ELSE '~/up/' || idx || '.md' END AS short FROM m WHERE role = 'assistant'),
t AS (SELECT session_id, CASE WHEN wrote THEN 'Write' ELSE 'Bash' END AS name, min(idx) AS o FROM c GROUP BY 1, 2),
s AS (SELECT session_id, '/w/p' || session_id % 3 AS project, 'p' || session_id % 3 AS base, 'log' || session_id || '-0000' AS log_id, (SELECT string_agg(name, ', ' ORDER BY o) FROM t WHERE t.session_id = x.session_id) AS tools,
  (SELECT string_agg(path, ', ' ORDER BY idx) FROM c WHERE c.session_id = x.session_id AND wrote) AS files, (SELECT string_agg(short, ', ' ORDER BY idx) FROM c WHERE c.session_id = x.session_id AND wrote) AS shorts,
  (SELECT count(*) FROM c WHERE c.session_id = x.session_id) AS n, (SELECT string_agg('out ' || idx, ' | ' ORDER BY idx) FROM (SELECT * FROM c WHERE c.session_id = x.session_id AND NOT wrote ORDER BY idx DESC LIMIT 3)) AS outs
  FROM (SELECT DISTINCT session_id FROM m) x),
e AS (SELECT session_id, arg_min(content, idx) FILTER (role = 'user') AS intent, arg_max(content, idx) FILTER (role = 'assistant' AND content <> '') AS outcome,
  string_agg(role || ': ' || content[1:500], chr(10) || chr(10) ORDER BY idx) AS conversation FROM m GROUP BY 1),
a AS (SELECT session_id, string_agg('- ' || CASE WHEN wrote THEN 'Write ' || short || ' (' || length(idx::VARCHAR) + 4 || 'b): a · ' || idx ELSE 'Bash: run ' || idx END, chr(10) ORDER BY idx) AS actions,
  string_agg(('- ' || CASE WHEN wrote THEN 'Write: {{"file_path":"' || path || '","content":"a\\n' || idx || '\\nb"}}' ELSE 'Bash: {{"command":"run ' || idx || '"}}' END)[1:204 + CASE WHEN wrote THEN 5 ELSE 4 END], chr(10) ORDER BY idx) AS legacy
  FROM c GROUP BY 1)"""
_DISTILL = f"""{_q(prompts.DISTILL_HEAD)} || '
### Project
' || base || '

### Intent (first user message)
' || coalesce(intent, '(no user message)')[1:600] || '

### Conversation
' || conversation || '

### Actions taken
' || coalesce(actions, '(no tool calls)') || '

### Outcome
- Files modified: ' || coalesce(shorts, '(none)') || '
- Tool calls: ' || n || '
- Tools used: ' || coalesce(tools, '') || '
- Final assistant message: ' || coalesce(outcome, '(no final assistant message)')[1:400] || chr(10) || {_q(prompts.DISTILL_BODY)}"""
_LEGACY = f"""{_q(prompts.LEGACY_HEAD)} || '- Agent: claude-code
- Project: ' || project || '
- Tool calls: ' || n || '
- Tools used: ' || coalesce(tools, '') || '
- Files modified: ' || coalesce(files, '') || '

## Tool Calls
' || coalesce(legacy, '') || '

## Conversation
' || spoken || {_q(prompts.LEGACY_TASK)} || 'source_session: ' || log_id || '
source_agent: claude-code
created: {CREATED}' || {_q(prompts.LEGACY_TAIL)}"""
_SPOKEN = """, w AS (SELECT session_id, string_agg(role || ': ' || content[1:500] || CASE WHEN role = 'assistant' THEN chr(10) || '  [Tools: ' || CASE WHEN idx % 4 = 1 THEN 'Write' ELSE 'Bash' END || ']' ELSE '' END, chr(10) || chr(10) ORDER BY idx) AS spoken FROM m GROUP BY 1)"""
_FROM = " FROM s JOIN e USING (session_id) LEFT JOIN a USING (session_id)"


@query(_S + f" SELECT session_id, {_DISTILL} AS prompt, 0 AS n_matches, 0::BIGINT AS dropped{_FROM}")
def distill_prompts(spark, d):
    got = prompts.distill_prompt(*_session_tables(spark, d), home=HOME)
    return got.select("session_id", "prompt", F.size("matches").alias("n_matches"), "dropped")


@query(_S + f""" SELECT session_id, {_q(prompts.JUDGE_HEAD)} || coalesce(intent, '')[1:500] || '

### Outcome signals
- Files modified: ' || coalesce(shorts, '(none)') || '
- Tool calls: ' || n || '
- Tools used: ' || coalesce(tools, '') || '
- Last 3 Bash outputs: ' || coalesce(outs, '(none)') || '
- Final assistant message: ' || coalesce(outcome, '')[1:500] || {_q(prompts.JUDGE_TAIL)} AS prompt{_FROM}""")
def judge_prompts(spark, d):
    return prompts.judge_prompt(*_session_tables(spark, d), home=HOME)


@query(_S + _SPOKEN + f" SELECT session_id, {_LEGACY} AS prompt{_FROM} JOIN w USING (session_id)")
def legacy_prompts(spark, d):
    return prompts.legacy_prompt(*_session_tables(spark, d), CREATED)


@query(_S + " SELECT session_id, actions AS tools FROM a")
def tool_summaries(spark, d):
    rows, _, calls = _session_tables(spark, d)
    return L.summary(calls.join(rows.select("session_id", "project"), "session_id"), F.col("project"), HOME)


def _metrics_sql(text: str) -> str:
    n = lambda p: f"len(regexp_extract_all({text}, {_q(p)}))"
    has = lambda p: f"regexp_matches({text}, {_q(p)})"
    return f"""length({text})::INT AS chars, len(string_split({text}, chr(10)))::INT AS lines, {n('/(?:Users|home)/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+')}::INT AS path_leaks, ({n('BAD:[[:space:]]*"Use ')} + {n('GOOD:')})::INT AS hints,
{has('(?i)Example[[:space:]]+1' + chr(92) + 'b')} AND {has('(?i)Example[[:space:]]+2' + chr(92) + 'b')} AS few_shot, {has('(?i)"abort":[[:space:]]*"no_artifact"')} OR {has('(?i)abort protocol')} AS abort_protocol,
{has('(?i)closed taxonomy')} AS taxonomy, {has('(?i)EXACTLY ONE valid JSON')} AS json_schema, {has('(?i)causal chain|discard dead ends')} AS causal_chain"""


@query("SELECT doc_id, " + _metrics_sql("coalesce(text, '')") + " FROM documents")
def prompt_metrics(spark, d):
    got = D.prompt_metrics(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", *(v.alias(k) for k, v in got.items()))


@query(_S + _SPOKEN + f""", p AS (SELECT session_id, 'current' AS version, {_DISTILL} AS prompt{_FROM} UNION ALL SELECT session_id, 'legacy', {_LEGACY}{_FROM} JOIN w USING (session_id)),
x AS (SELECT session_id, version, {_metrics_sql('prompt')} FROM p)
SELECT version, sum(chars)::BIGINT AS chars, sum(lines)::BIGINT AS lines, sum(path_leaks)::BIGINT AS path_leaks, sum(hints)::BIGINT AS hints, arg_max(few_shot, session_id) AS few_shot,
arg_max(abort_protocol, session_id) AS abort_protocol, arg_max(taxonomy, session_id) AS taxonomy, arg_max(json_schema, session_id) AS json_schema, arg_max(causal_chain, session_id) AS causal_chain FROM x GROUP BY 1""")
def prompt_comparison(spark, d):
    made = _session_tables(spark, d)
    both = prompts.distill_prompt(*made, home=HOME).select("session_id", F.lit("current").alias("version"), "prompt")
    both = both.unionByName(prompts.legacy_prompt(*made, CREATED).select("session_id", F.lit("legacy").alias("version"), "prompt"))
    return D.sum_metrics(both.select("version", "session_id", *(v.alias(k) for k, v in D.prompt_metrics(F.col("prompt")).items())), "version", "session_id")


@query(_S + f""" SELECT session_id, '---
name: ' || base || '-' || log_id[1:8] || '-stub
description: Template stub — session captured offline, re-run with --llm for a real skill
source_session: ' || log_id || '
source_agent: claude-code
created: {CREATED}
distill_prompt_version: {D.PROMPT_VERSION}-template
confidence: low
tags:
  - auto-extracted
  - template-stub
---

# ' || base || '-' || log_id[1:8] || '-stub
' || {_q(prompts.TEMPLATE_USE.replace("{tool}", "traceloom"))} || 'Session started with: "' || coalesce(intent, 'N/A')[1:200] || '"
Modified files: ' || coalesce(files, 'none tracked') || '
Tools used: ' || coalesce(tools, '') || '
Total tool calls: ' || n || chr(10) || {_q(prompts.TEMPLATE_END)} AS document{_FROM}""")
def template_documents(spark, d):
    rows, said, _ = _session_tables(spark, d)
    return prompts.template(rows, said, CREATED, "redact").select("session_id", "document")


def _replies(spark, d) -> DataFrame:
    body = F.to_json(F.struct(
        F.concat(F.lit("fix page "), F.col("page_id").cast("string")).alias("name"), F.concat(F.lit("Look  at "), F.col("url")).alias("description"), F.lit("it breaks ").alias("when_to_use"),
        F.array(F.lit(" look "), F.lit(""), F.col("url")).alias("steps"), F.array(F.lit("CI"), F.lit("other"), F.lit("next js")).alias("tags"), F.lit("high").alias("confidence"),
    ))
    p = F.col("page_id")
    reply = F.when(p % 4 == 0, F.lit('no {"abort": "no_artifact", "reason": "x}"}')).when(p % 4 == 1, F.concat(F.lit("Here: "), body, F.lit(" }"))).when(p % 4 == 2, "{ broken")
    return table(spark, d, "pages").select(
        "page_id", p.alias("session_id"), F.lit("codex").alias("agent"), F.concat(F.lit("s"), p.cast("string")).alias("log_id"), F.lit("/w/My App").alias("project"), F.lit(CREATED).alias("created"),
        reply.alias("reply"), F.lit("stub").alias("template"), (p % 8 == 0).alias("forced"),
    )


_DOC = f"""'---
name: fix-page-' || page_id || '
description: Look at ' || url || '
source_session: s' || page_id || '
source_agent: codex
created: {CREATED}
distill_prompt_version: {D.PROMPT_VERSION}
confidence: high
tags:
  - ci
  - next-js
---

# Fix Page ' || page_id || '

## When to use
it breaks

## Steps
1. look
2. ' || url || '

## Example
(no example captured)

## Key decisions
- (none captured)

## Why this worked
(not captured)
'"""
_ROUTED = f"""SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'abort' WHEN 1 THEN 'skill' ELSE 'error' END AS kind, CASE WHEN page_id % 4 = 1 THEN 'llm' WHEN page_id % 4 > 1 OR page_id % 8 = 0 THEN 'template' END AS mode,
CASE WHEN page_id % 4 = 1 THEN {_DOC} WHEN page_id % 4 > 1 OR page_id % 8 = 0 THEN 'stub' END AS document FROM pages"""


@query(f"SELECT page_id, kind, mode, document FROM ({_ROUTED})")
def distilled_documents(spark, d):
    return prompts.distilled(_replies(spark, d)).select("page_id", "kind", "mode", "document")


@query(f"""SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'fix-page-' || page_id ELSE ('s' || page_id)[1:8] END AS file,
CASE WHEN page_id % 11 = 0 THEN 1 WHEN page_id % 13 = 0 THEN 2 WHEN page_id % 4 = 0 AND page_id % 8 <> 0 THEN 8 WHEN page_id % 17 = 0 THEN 9 WHEN page_id % 19 = 0 THEN 4 ELSE 0 END AS code FROM ({_ROUTED})""")
def outcomes(spark, d):
    rows = prompts.distilled(_replies(spark, d))
    p = F.col("page_id")
    code = prompts.outcome_code(found=p % 11 != 0, secrets=p % 13 == 0, aborted=F.col("kind") == "abort", forced=F.col("forced"), duplicate=p % 17 == 0, writable=p % 19 != 0)
    return rows.select("page_id", prompts.file_name_of(F.coalesce("document", F.lit("")), F.col("log_id")).alias("file"), code.alias("code"))


@query("""WITH r AS (SELECT page_id, page_id % 5 AS k, page_id % 3 = 0 AS by_tool, page_id % 7 AS tools, page_id % 2 AS files FROM pages),
j AS (SELECT *, CASE WHEN k = 4 THEN true WHEN k = 3 THEN false ELSE k = 0 END AS yes, CASE WHEN k = 4 THEN 'unknown provider, judge skipped' WHEN k = 3 THEN 'judge call failed: time' WHEN k = 2 AND by_tool THEN 'judge tool returned non-object input'
  WHEN k = 2 THEN 'judge output unparseable, refusing to distill' WHEN k = 1 THEN 'no reason given' ELSE 'fine }' END AS why, CASE WHEN k = 0 THEN 'medium' ELSE 'low' END AS sure FROM r)
SELECT page_id, yes AND NOT (files = 0 AND tools = 0) AS distillable, CASE WHEN yes AND files = 0 AND tools = 0 THEN 'local signals contradict judge: 0 files modified and 0 tool calls (original: ' || why || ')'
  WHEN NOT yes AND files > 0 AND tools > 5 THEN why || ' (local signals suggest distillable: ' || files || ' files modified, ' || tools || ' tool calls — judge disagreed)' ELSE why END AS reason,
CASE WHEN yes AND files = 0 AND tools = 0 THEN 'high' ELSE sure END AS confidence FROM j""")
def judge_verdicts(spark, d):
    p, k = F.col("page_id"), F.col("page_id") % 5
    said = F.when(k == 0, '{"distillable": true, "reason": "fine }", "confidence": "medium"}').when(k == 1, '{"distillable": "true", "reason": 5, "confidence": "sure"}').when(k == 2, "[1]")
    rows = table(spark, d, "pages").select(
        "page_id", F.when(k == 4, "other").otherwise("anthropic").alias("provider"), F.lit(True).alias("has_key"), F.when(p % 3 == 0, said).alias("tool_input"), F.concat(F.lit("Well, "), said).alias("reply"),
        F.when(k == 3, "time").alias("error"), (p % 7).alias("tools"), (p % 2).alias("files"),
    )
    return mining.local_signals(prompts.judged(rows)).select("page_id", "distillable", "reason", "confidence")


_FIXTURE = """WITH f AS (SELECT doc_id, doc_id % 3 = 0 AS abort_expected, CASE doc_id % 5 WHEN 0 THEN 'abort' WHEN 1 THEN 'error' ELSE 'skill' END AS kind, lower(coalesce(text, '')) AS t, n_chars FROM documents),
g AS (SELECT *, kind = 'skill' AND NOT abort_expected AS both_, (CASE WHEN contains(t, 'the') THEN 0 ELSE 1 END + CASE WHEN contains(t, 'and') THEN 0 ELSE 1 END) AS missing, CASE WHEN contains(t, 'token') THEN 1 ELSE 0 END AS unexpected FROM f),
h AS (SELECT doc_id, CASE WHEN abort_expected THEN 'abort' ELSE 'skill' END AS expected_kind, kind, CASE WHEN both_ THEN missing ELSE 0 END AS missing, CASE WHEN both_ THEN unexpected ELSE 0 END AS unexpected,
  CASE WHEN kind = 'abort' THEN abort_expected ELSE both_ AND missing = 0 AND unexpected = 0 END AS passes, n_chars FROM g)"""


def _fixtures(spark, d) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        "doc_id", F.when(i % 3 == 0, "abort").otherwise("skill").alias("expected_kind"), F.when(i % 5 == 0, "abort").when(i % 5 == 1, "error").otherwise("skill").alias("kind"),
        F.array(F.lit("THE"), F.lit("And")).alias("must"), F.array(F.lit("Token")).alias("must_not"), F.coalesce("text", F.lit("")).alias("output"), F.col("n_chars").alias("prompt_chars"),
    )
    return mining.fixture_check(rows)


@query(_FIXTURE + " SELECT doc_id, missing::INT AS missing, unexpected::INT AS unexpected, passes FROM h")
def fixture_results(spark, d):
    return _fixtures(spark, d).select("doc_id", F.size("missing").alias("missing"), F.size("unexpected").alias("unexpected"), "passes")


@query(_FIXTURE + """ SELECT count(*) AS total, count(*) FILTER (passes) AS passing, floor(count(*) FILTER (passes) / count(*) * 100 + 0.5)::BIGINT AS pass_pct, count(*) FILTER (expected_kind = 'abort') AS expected_aborts,
count(*) FILTER (expected_kind = 'abort' AND kind = 'abort') AS correct_aborts, count(*) FILTER (kind = 'abort') AS aborts, floor(avg(n_chars) + 0.5)::BIGINT AS avg_prompt_chars FROM h""")
def evaluation_metrics(spark, d):
    return mining.evaluation(_fixtures(spark, d))


# Paths of each shape, with what becomes of them: below a root, above it, in the home folder.
_PATHS = [
    ("'/w/p/src/' || k || '.ts'", "'src/' || k || '.ts'"), ("'/w/p/../x/s' || k", "'s' || k"), ("'/w/p/a/./b/../c' || k", "'a/c' || k"), ("'/w/pq/' || k", "k"), ("'/w/p'", "'p'"), ("'/w/p/'", "'p'"), ("'../../up/' || k || '.env'", "k || '.env'"),
    ("'a/../b' || k", "'b' || k"), ("'./src/' || k", "'src/' || k"), ("'/home/me/z/' || k", "'~/z/' || k"), ("'/home/me'", "'~'"), ("'/home/meg/' || k", "k"), ("'..'", "'..'"), ("'/w/p/..hid/' || k", "k"), ("''", "''"), ("'/etc/' || k || '//'", "k"),
]


@query("SELECT event_id, " + "CASE event_id % " + str(len(_PATHS)) + " " + " ".join(f"WHEN {i} THEN {want}" for i, (_, want) in enumerate(_PATHS)) + " END AS short FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)")
def anonymize_paths(spark, d):
    made = F.expr("CASE event_id % " + str(len(_PATHS)) + " " + " ".join(f"WHEN {i} THEN {given}" for i, (given, _) in enumerate(_PATHS)) + " END")
    rows = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).select("event_id", made.alias("path"))
    return rows.select("event_id", L.anonymize(F.col("path"), "/w/p", HOME).alias("short"))


@query("""SELECT event_id, user_id > 50 OR (user_id = 50 AND event_id % 7 > 3) AS newer, CASE WHEN user_id % 10 = 0 THEN CASE WHEN event_id % 3 = 0 THEN '—' ELSE '+∞' END
ELSE CASE WHEN p >= 0 THEN '+' ELSE '' END || p || '%' END AS change FROM (SELECT *, floor((event_id % 3 - user_id % 10) / nullif(user_id % 10, 0) * 100 + 0.5)::BIGINT AS p FROM events)""")
def versions_and_changes(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    latest = F.concat(F.lit("1."), u.cast("string"), F.lit("."), (e % 7).cast("string"), F.lit("-beta"))
    return table(spark, d, "events").select("event_id", T.is_newer(latest, F.lit("1.50.3")).alias("newer"), T.percent_change(u % 10, e % 3).alias("change"))


# The first user's message by kind: commands alone, talk, a plan to execute, work.
_SAID = [("user_id % 5 = 0", "<command-name>/run</command-name> <!-- x -->"), ("user_id % 7 = 0", "retomemos la charla de ayer sobre este proyecto"), ("user_id % 3 = 0", "please <b>execute the plan</b>  for the service now")]
_WORK = "please look at <i>this</i> module again"


def _log_lines(spark, d) -> DataFrame:
    """Lines of one log a user: views are the user's messages, other events calls, results come for commands."""
    k, at = F.get_json_object("props", "$.k"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    said = F.lit(_WORK)
    for cond, text in reversed(_SAID):
        said = F.when(F.expr(cond), text).otherwise(said)
    project = F.when(F.col("user_id") % 2 == 0, "/w/Projects/p").otherwise("/w/p")
    user = F.to_json(F.struct(F.lit("user").alias("type"), at.alias("timestamp"), project.alias("cwd"), F.struct(F.lit("user").alias("role"), said.alias("content")).alias("message")))
    wrote = F.col("event_type").isin("purchase", "signup")
    path = F.concat(F.lit("src/f"), k, F.when(k.cast("int") % 2 == 0, ".ts").when(k.cast("int") % 3 == 0, ".yaml").otherwise(".md"))
    given = F.when(wrote, F.to_json(F.struct(path.alias("file_path")))).otherwise(F.to_json(F.struct(k.alias("command"))))
    block = F.concat(F.lit('[{"type":"text","text":"ok"},{"type":"tool_use","name":"'), F.when(wrote, "Edit").otherwise("Bash"), F.lit('","input":'), given, F.lit("}]"))
    call = F.concat(F.lit('{"type":"assistant","uuid":"u'), F.col("event_id"), F.lit('","timestamp":"'), at, F.lit('","cwd":"'), project, F.lit('","message":{"role":"assistant","usage":{"input_tokens":20,"output_tokens":1},"content":'), block, F.lit("}}"))
    content = F.when(k.cast("int") % 2 == 0, F.concat(F.lit('"out '), k, F.lit('"'))).otherwise(F.concat(F.lit('[{"n": '), k, F.lit("}]")))
    result = F.concat(F.lit('{"type":"tool_result","parentUuid":"u'), F.col("event_id"), F.lit('","message":{"content":'), content, F.lit("}}"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", "event_type", F.when(F.col("event_type") == "view", user).otherwise(call).alias("a"), F.when(F.col("event_type") == "click", result).alias("b"))
    lines = F.filter(F.array(F.struct((F.col("event_id") * 2).alias("line_no"), F.col("a").alias("line")), F.struct((F.col("event_id") * 2 + 1).alias("line_no"), F.col("b").alias("line"))), lambda x: x["line"].isNotNull())
    return rows.select("session_id", F.inline(lines))


@query("""SELECT user_id AS session_id, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'Edit' ELSE 'Bash' END AS name,
CASE WHEN event_type <> 'click' THEN '' WHEN k % 2 = 0 THEN 'out ' || k ELSE '[{"n":' || k || '}]' END AS output FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) WHERE event_type <> 'view'""")
def log_tool_outputs(spark, d):
    calls = parsing.tool_calls(parsing.entries(_log_lines(spark, d)))
    return calls.select("session_id", F.expr("line_no div 2").alias("event_id"), "name", "output")


_MINED = f"""WITH v AS (SELECT *, json_extract_string(props, '$.k')::INT AS k, CAST(floor(epoch(ts)) AS BIGINT) AS ep FROM events),
f AS (SELECT *, CASE WHEN event_type IN ('purchase', 'signup') THEN 'src/f' || k || CASE WHEN k % 2 = 0 THEN '.ts' WHEN k % 3 = 0 THEN '.yaml' ELSE '.md' END END AS path FROM v),
g AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS users, count(*) FILTER (event_type <> 'view') AS tools, count(DISTINCT path) AS files, coalesce(bool_or(path LIKE '%.ts'), false) AS code,
  coalesce(bool_or(path LIKE '%.ts' OR path LIKE '%.yaml'), false) AS code_or_config, arg_max(ep, event_id) - arg_min(ep, event_id) AS duration, 20 * count(*) FILTER (event_type <> 'view') AS tokens, user_id % 2 = 0 AS in_projects,
  CASE WHEN count(*) FILTER (event_type = 'view') = 0 THEN '' {' '.join(f"WHEN {c} THEN {_q(t)}" for c, t in _SAID)} ELSE {_q(_WORK)} END AS said FROM f GROUP BY user_id),
h AS (SELECT *, length(trim(regexp_replace(said, '<command-name>.*?</command-name>', '', 'g'))) < 20 AS slash_only,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(said, '<command-name>.*?</command-name>', '', 'g'), '<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'), ' +', ' ', 'g')) AS intent FROM g),
r AS (SELECT *, list_filter([CASE WHEN files >= 1 THEN {{'n': 3, 'w': '+3 files:' || files}} END, CASE WHEN code THEN {{'n': 3, 'w': '+3 code-files'}} END, CASE WHEN tools BETWEEN 3 AND 30 THEN {{'n': 2, 'w': '+2 tools-in-range:' || tools}} END,
  CASE WHEN in_projects THEN {{'n': 2, 'w': '+2 in-Projects'}} END, CASE WHEN users >= 2 THEN {{'n': 1, 'w': '+1 multi-turn:' || users}} END, CASE WHEN tokens > 1000 THEN {{'n': 1, 'w': '+1 tokens:' || tokens}} END,
  CASE WHEN tools = 0 THEN {{'n': -3, 'w': '-3 zero-tools'}} END, CASE WHEN duration < 60 THEN {{'n': -1, 'w': '-1 short:' || duration || 's'}} END, CASE WHEN tools > 100 THEN {{'n': -2, 'w': '-2 marathon:' || tools}} END,
  CASE WHEN slash_only THEN {{'n': -2, 'w': '-2 slash-only-intent'}} END], lambda x: x IS NOT NULL) AS fired FROM h),
x AS (SELECT *, coalesce(list_sum(list_transform(fired, lambda x: x.n)), 0)::BIGINT AS score, array_to_string(list_transform(fired, lambda x: x.w), ', ') AS reasons,
  CASE WHEN code AND in_projects AND NOT slash_only AND tools >= 3 THEN 'A' WHEN files >= 1 AND tools >= 3 AND NOT slash_only THEN 'B' ELSE 'C' END AS tier,
  CASE WHEN tools < 3 THEN '<3 tool calls' WHEN files = 0 THEN 'no files modified' WHEN duration < 30 THEN '<30s duration' WHEN length(intent) > 30 AND intent LIKE '%retomemos%' THEN 'conversational intent'
    WHEN tools > 200 AND duration > 21600 THEN 'marathon execution (>200 tools, >6h)'
    WHEN tools BETWEEN 4 AND 60 AND files BETWEEN 1 AND 15 AND duration BETWEEN 60 AND 3600 AND code_or_config THEN CASE WHEN intent LIKE '%execute the plan%' THEN 'focused plan-execution session' ELSE 'focused build/fix session' END END AS why,
  array_to_string(list_filter([CASE WHEN NOT tools BETWEEN 4 AND 60 THEN 'tools=' || tools || ' out-of-range' END, CASE WHEN NOT files BETWEEN 1 AND 15 THEN 'files=' || files || ' out-of-range' END,
    CASE WHEN NOT duration BETWEEN 60 AND 3600 THEN 'dur=' || duration || 's out-of-range' END, CASE WHEN NOT code_or_config THEN 'no-code-file' END], lambda x: x IS NOT NULL), ', ') AS odd FROM r),
y AS (SELECT *, coalesce(why, odd) AS reason, CASE WHEN why IS NULL THEN 'review' WHEN why LIKE 'focused%' THEN 'distillable' ELSE 'not' END AS label, CASE WHEN code AND in_projects AND tools >= 3 THEN 1 WHEN files >= 1 AND tools >= 3 AND NOT slash_only THEN 2 END AS candidate FROM x)"""


def _mined(spark, d) -> DataFrame:
    return mining.classify(mining.score(mining.sessions_of_logs(parsing.entries(_log_lines(spark, d)))))


@query(_MINED + " SELECT user_id AS session_id, score, reasons, tier, label, reason, intent FROM y")
def mined_logs(spark, d):
    return _mined(spark, d).select("session_id", "score", F.array_join("reasons", ", ").alias("reasons"), "tier", "label", "reason", "intent")


@query(_MINED + " SELECT user_id AS session_id, candidate::INT AS candidate, label FROM y WHERE candidate IS NOT NULL")
def mined_candidates(spark, d):
    return mining.candidates(_mined(spark, d)).select("session_id", "candidate", "label")


def _codex_lines(spark, d) -> DataFrame:
    """Lines of one log of the second kind a user, odd ones without a header."""
    at, k = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.get_json_object("props", "$.k")
    e, event = F.col("event_type"), lambda kind, payload: F.concat(F.lit('{"type":"' + kind + '","timestamp":"'), at, F.lit('","payload":'), payload, F.lit("}"))
    meta = event("session_meta", F.concat(F.lit('{"id":"c'), F.col("user_id"), F.lit('","cwd":"/w/c","model":"m1"}')))
    tokens = event("event_msg", F.concat(F.lit('{"type":"token_count","input_tokens":'), k, F.lit(',"output_tokens":2,"info":{"input_tokens":999}}')))
    user = event("response_item", F.concat(F.lit('{"type":"message","role":"user","content":[{"type":"input_text","text":"do '), k, F.lit('"},{"type":"image","text":"no"}]}')))
    call = event("response_item", F.concat(F.lit('{"type":"function_call","name":"shell","arguments":"'), F.when(k.cast("int") % 2 == 0, '{\\"a\\":1}').otherwise("broken"), F.lit('"}')))
    other = event("response_item", F.lit('{"type":"function_call_output","output":"x"}'))
    line = F.when((e == "signup") & (F.col("user_id") % 2 == 0), meta).when(e == "purchase", tokens).when(e == "view", user).when(e == "click", call).otherwise(other)
    return table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("line_no"), line.alias("line"))


@query("""WITH e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k, event_type = 'signup' AND user_id % 2 = 0 AS meta FROM events)
SELECT user_id AS session_id, CASE WHEN bool_or(meta) THEN 'c' || user_id ELSE 'unknown' END AS log_id, CASE WHEN bool_or(meta) THEN '/w/c' ELSE 'unknown' END AS project, strftime(arg_min(ts, event_id), '%Y-%m-%d %H:%M:%S') AS started_at,
strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS ended_at, count(*) FILTER (event_type = 'view') AS user_messages, count(*) FILTER (event_type = 'error' OR (event_type = 'signup' AND NOT meta)) AS assistant_messages,
coalesce(sum(k) FILTER (event_type = 'purchase'), 0)::BIGINT AS input_tokens, 2 * count(*) FILTER (event_type = 'purchase') AS output_tokens, count(*) FILTER (event_type = 'click') AS tool_calls,
CASE WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'shell' ELSE '' END AS tools, CASE WHEN bool_or(meta) THEN 'm1' ELSE '' END AS model FROM e GROUP BY user_id""")
def codex_sessions(spark, d):
    parsed = parsing.codex_entries(_codex_lines(spark, d))
    rows = parsing.codex_sessions(parsed).join(parsing.codex_model(parsed), "session_id")
    counts = ("user_messages", "assistant_messages", "input_tokens", "output_tokens", "tool_calls")
    return rows.select("session_id", "log_id", "project", "started_at", "ended_at", *counts, F.array_join("unique_tools", ",").alias("tools"), F.coalesce("model", F.lit("")).alias("model"))


@query("""WITH e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) SELECT user_id AS session_id, event_id AS ord, CASE WHEN event_type = 'click' THEN 'call' WHEN event_type = 'view' THEN 'user' ELSE 'assistant' END AS kind,
CASE WHEN event_type = 'click' THEN CASE WHEN k % 2 = 0 THEN '{"a":1}' ELSE '{"raw":"broken"}' END WHEN event_type = 'view' THEN 'do ' || k ELSE '' END AS body FROM e
WHERE event_type IN ('click', 'view', 'error') OR (event_type = 'signup' AND user_id % 2 = 1)""")
def codex_items(spark, d):
    parsed = parsing.codex_entries(_codex_lines(spark, d))
    said = parsing.codex_messages(parsed).select("session_id", F.col("line_no").alias("ord"), F.col("role").alias("kind"), F.col("content").alias("body"))
    return said.unionByName(parsing.codex_calls(parsed).select("session_id", "ord", F.lit("call").alias("kind"), F.col("input").alias("body")))


@query("""SELECT user_id AS session_id, CASE WHEN user_id % 2 = 0 THEN 'claude-code' ELSE 'codex' END AS agent, count(*) FILTER (event_type = 'view') AS user_messages,
CASE WHEN user_id % 2 = 0 THEN count(*) FILTER (event_type <> 'view') ELSE count(*) FILTER (event_type IN ('error', 'signup')) END AS assistant_messages,
CASE WHEN user_id % 2 = 0 THEN count(*) FILTER (event_type <> 'view') ELSE count(*) FILTER (event_type = 'click') END AS tool_calls FROM events GROUP BY user_id""")
def parse_both(spark, d):
    agent = F.when(F.col("session_id") % 2 == 0, "claude-code").otherwise("codex").alias("agent")
    lines = _log_lines(spark, d).where("session_id % 2 = 0").unionByName(_codex_lines(spark, d).where("session_id % 2 = 1"))
    return parsing.parse(lines.select("*", agent))[0].select("session_id", "agent", "user_messages", "assistant_messages", "tool_calls")


@query("""SELECT user_id AS session_id, '  ' || rpad('codex', 12, ' ') || ' ' || strftime(max(ts), '%Y-%m-%d') || '  ' || lpad(printf('%.1f', floor(count(*) * 100 / 1024.0 * 10 + 0.5) / 10), 8, ' ') || 'KB  ' || ('session-' || user_id)[1:8] || '...' AS line FROM events GROUP BY user_id""")
def session_lines(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("modified_at"), (F.count("*") * 100).alias("size_bytes"))
    named = rows.select(F.col("user_id"), F.concat(F.lit("session-"), F.col("user_id")).alias("session_id"), F.lit("codex").alias("agent"), "modified_at", "size_bytes")
    return reports.session_lines(named).select(F.substring("session_id", 9, 99).cast("long").alias("session_id"), "line")


@query(_S + """ SELECT session_id, 'Session: ' || log_id[1:8] || '...' || chr(10) || 'Agent:   claude-code' || chr(10) || 'Project: ' || project || chr(10) || 'Branch:  main' || chr(10) || 'Messages: ' || (SELECT count(*) FROM m WHERE m.session_id = s.session_id AND role = 'user')
|| ' user, ' || (SELECT count(*) FROM m WHERE m.session_id = s.session_id AND role = 'assistant') || ' assistant' || chr(10) || 'Tools:   ' || n || ' calls (' || coalesce(tools, '') || ')' || chr(10) || 'Tokens:  3 in / 4 out' || chr(10) || 'Files:   ' || coalesce(files, 'none tracked') AS text FROM s""")
def previews(spark, d):
    rows, said, _ = _session_tables(spark, d)
    counts = said.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"))
    return reports.preview(rows.join(counts, "session_id").select("*", F.lit(3).alias("input_tokens"), F.lit(4).alias("output_tokens")))


@query(jaro_winkler_sql("SELECT page_id AS id, '/s/' || n_name || '.md' AS oid, lower(url) AS a, 'https://' || lower(n_name) || '.example/index' AS b FROM pages, nation WHERE url <> ''") + """,
hits AS (SELECT id, oid, row_number() OVER (PARTITION BY id ORDER BY s DESC, oid) AS r FROM sim WHERE s >= 0.7), g AS (SELECT id, count(*) AS n, string_agg(oid, ',' ORDER BY r) FILTER (r <= 3) AS top FROM hits GROUP BY id)
SELECT page_id AS id, coalesce(n, 0) AS n_similar, coalesce(n, 0) > 0 AS duplicate, coalesce(top, '') AS top FROM pages LEFT JOIN g ON g.id = page_id""")
def dedup_gate(spark, d):
    new = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("---\ndescription: "), F.col("url"), F.lit("\n---\n")).alias("text"))
    old = table(spark, d, "nation").select(F.concat(F.lit("/s/"), F.col("n_name"), F.lit(".md")).alias("path"), F.concat(F.lit("---\ndescription: https://"), F.lower("n_name"), F.lit(".example/index\n---\n")).alias("text"))
    got = similarity.gate(new, old, 0.7)
    return got.select("id", "n_similar", "duplicate", F.array_join(F.transform("top", lambda x: x["path"]), ",").alias("top"))


