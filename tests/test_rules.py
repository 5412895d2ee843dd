"""Operators against plain Python or stated results on odd rows: nulls, ties, empty tables."""

import os
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from traceloom import engine
from traceloom.functions import text as T
from traceloom.functions import tool_lines as L
from traceloom.operators import documents, mining, parsing, prompts, redaction, sessions, similarity
from traceloom.sources import reports, session_logs
from traceloom.streaming import event_counts, read_events, read_lines, session_activity, write_stream

DOCS = "/root/testdata/sf0.001/documents.parquet"


def values(spark, column, cases, kind="string"):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, c {kind}").select("i", column(F.col("c")).alias("v")).collect()
    return [r.v for r in sorted(rows)]


# --- paths and small functions


def test_paths(spark):
    cases = {
        "/r/../x/secret": "secret", "/r/a/../b": "b", "a/../b": "b", "../up/.env": ".env", "a/b": "a/b", "./a//b/": "a/b", "/r": "r", "/h/me/x": "~/x", "/h/me": "~", "/h/mean": "mean", "": "", "..": "..", "/r/..x": "..x", "/": "",
    }
    got = values(spark, lambda c: L.anonymize(c, "/r", "/h/me"), [*cases, None])
    assert got == [*cases.values(), None]
    assert values(spark, lambda c: L.anonymize(c, "unknown"), ["a/b/c", "/x/y"]) == ["c", "y"]
    assert values(spark, lambda c: T.is_inside(c, F.lit("/a/b")), ["/a/b", "/a/b/../b/c", "/a/bc", "/a/b/../c", "/"]) == [True, True, False, False, False]
    assert values(spark, lambda c: T.is_newer(c, F.lit("1.2.3")), ["1.2.4", "1.10.0", "1.2.3", "1.2.3-x", "0.9.9", "v2.0.0", None, "2.0.0-rc"]) == [True, True, False, False, False, False, False, True]
    pairs = spark.createDataFrame([(0, 0), (0, 3), (10, 15), (10, 5), (3, 3)], "a long, b long")
    assert [r[0] for r in pairs.select(T.percent_change(F.col("a"), F.col("b"))).collect()] == ["—", "+∞", "+50%", "-50%", "+0%"]


def test_threshold_of_a_user():
    for given, want in [("0.8", 0.8), (" 1 ", 1.0), ("1e-1", 0.1), ("0x1", 1.0), (".5", 0.5), ("5.e-1", 0.5), ("  ", 0.0), ("0", 0.0)]:
        assert similarity.parse_threshold(given) == want
    for bad in ("", "80%", "abc", "nan", "Infinity", "-0.1", "1.01", "0.8\x1b[2J", "1_0", "٣"):
        with pytest.raises(ValueError) as e:
            similarity.parse_threshold(bad)
        assert "\x1b" not in str(e.value) and "%" not in str(e.value)


# --- similarity, by the textbook


def plain_jaro_winkler(a, b):
    a, b = a.lower(), b.lower()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                mine.append(ch)
                break
    theirs = [ch for ch, u in zip(b, used) if u]
    m = len(mine)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(mine, theirs)) / 2
    j = (m / len(a) + m / len(b) + (m - t) / m) / 3
    if j < 0.7:
        return j
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return j + same * 0.1 * (1 - j)


def test_similar_names_by_the_textbook(spark):
    names = spark.read.parquet("/root/testdata/sf0.001/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("text"))
    rows = names.collect()
    for threshold in (0.7, 0.85):
        want = {(a.id, b.id): plain_jaro_winkler(a.text, b.text) for a in rows for b in rows if a.id != b.id}
        want = {k: v for k, v in want.items() if v >= threshold}
        got = {(r.id, r.other_id): r.similarity for r in similarity.similar(names, names, threshold).where("id <> other_id").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
        within = {(r.id, r.other_id): r.similarity for r in similarity.similar_within(names, threshold).collect()}
        assert within.keys() == want.keys() and all(abs(within[k] - want[k]) < 1e-12 for k in within)


def test_gate_by_the_textbook(spark):
    old = [("/s/b.md", "---\nname: x\ndescription: 'fix the failing build'\n---\nbody"), ("/s/a.md", "---\ndescription: fix the failing build\n---"), ("/s/c.md", "no front"), ("/s/d.md", "---\ndescription: \n---"), ("/s/e.md", "---\ndescription: write a new parser\n---")]
    new = [(1, "---\ndescription: Fix the failing builds\n---\n"), (2, "description: something else entirely"), (3, "none"), (4, None)]
    got = {r.id: r for r in similarity.gate(spark.createDataFrame(new, "id int, text string"), spark.createDataFrame(old, "path string, text string"), 0.8).collect()}
    score = plain_jaro_winkler("Fix the failing builds", "fix the failing build")
    assert [(t.path, round(t.similarity, 12)) for t in got[1].top] == [("/s/a.md", round(score, 12)), ("/s/b.md", round(score, 12))] and got[1].n_similar == 2 and got[1].duplicate
    assert not (got[2].duplicate or got[3].duplicate or got[4].duplicate)
    none = spark.createDataFrame([], "path string, text string")
    assert not similarity.gate(spark.createDataFrame(new, "id int, text string"), none).where("duplicate").count()
    assert values(spark, similarity.description, [t for _, t in old] + ["---\nx: 1\ndescription: \"q\"\n---", None]) == ["fix the failing build", "fix the failing build", None, None, "write a new parser", "q", None]


# --- credentials


def test_plain_credentials_of_documents(spark):
    rows = spark.read.parquet(DOCS).select("doc_id", "text")
    some = re.compile("|".join(f"(?:{p})" for _, p in redaction.PATTERNS))
    got = {r.doc_id: r for r in redaction.scan(rows).collect()}
    plain = [r for r in rows.collect() if not redaction.layers(r.text or "")]
    assert len(plain) > 100
    for r in plain:
        t = r.text or ""
        assert got[r.doc_id].kinds == [k for k, p in redaction.PATTERNS if re.search(p, t)]
        assert got[r.doc_id].redacted == some.sub(lambda m: f"[REDACTED:{m[0][:4]}...{m[0][-2:]}]", t)
    for policy, want in (("abort", "aborted"), ("redact", "redacted"), ("allow", "sent")):
        for r in redaction.apply_policy(redaction.scan(rows), policy).collect():
            hit = bool(r.kinds)
            assert r.status == (want if hit else "sent")
            assert r.sent == (None if hit and policy == "abort" else r.redacted if hit and policy == "redact" else r.text or "")
    n = {r.kind: r.n for r in redaction.count_kinds(redaction.scan(rows)).collect()}
    assert n == {k: sum(k in r.kinds for r in got.values()) for k in {k for r in got.values() for k in r.kinds}}
    lines = [r.line for r in engine.summarize_findings(redaction.scan(rows)).collect()]
    assert sorted(lines) == sorted(f"  - {k}: {v}" for k, v in n.items())
    seen_rows, seen = engine.observe_findings(redaction.scan(rows))
    seen_rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"fields": sum(bool(r.kinds) for r in got.values()), "findings": sum(len(r.kinds) for r in got.values())}


def test_folded_characters_are_those_of_the_normal_form():
    shown, plain, several = redaction._folds()
    for a, b in zip(shown, plain):
        assert redaction.normalize(a) == b
    assert all(redaction.normalize(c) == "" for c in shown[len(plain) :]) and all(len(redaction.normalize(c)) > 1 for c in several)
    assert len(plain) > 1000


def test_disguised_credentials(spark):
    key = "sk-ant-api03" + "A" * 24
    cases = [key, "ｓk-ant-api03" + "A" * 24, "s​k-ant-api03" + "A" * 24, "ѕk-ant-api03" + "A" * 24, "sk-ant-api03" + "A" * 12 + "́" + "A" * 12, "sk%2Dant-api03" + "A" * 24, "\\u0073k-ant-api03" + "A" * 24, "é à ü 漢字 ordinary", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, text string")
    got = {r.i: r for r in redaction.scan(rows).collect()}
    assert all("anthropic-api-key" in got[i].kinds and got[i].redacted != cases[i] for i in range(7))
    assert all(got[i].kinds == [] and got[i].redacted == (cases[i] or "") for i in (7, 8, 9))


# --- replies, documents


def test_filter_by_the_steps(spark):
    def settle(t, p):
        n = 0
        while True:
            t, k = re.subn(p, "", t)
            n += k
            if not k:
                return t, n

    cases = ["<!-<!-- x -->- y -->z", "a <!-- b --!> c", "<!--" * 50 + "x" + "-->" * 50, "--><!--", "plain", None, "", "<!<!<!------x------>", "x <!-- open", "-" * 30 + ">" * 30, "<!-" * 40 + "<!-- -->" + "- -->" * 40]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, text string")
    for r in documents.filter_output(rows).collect():
        t, a = settle(r.text or "", r"(?s)<!--.*?--!?>")
        t, b = settle(t, "<!--|--!?>")
        assert r.clean == t and r.violations == ([f"stripped {a + b} HTML comment(s)/delimiter(s)"] if a + b else [])


def test_verdicts(spark):
    rows = spark.createDataFrame([(1, 'x {"distillable": true, "reason": "a }", "confidence": "high"} y'), (2, '{"distillable": "true"}'), (3, "no json"), (4, None), (5, "{broken"), (6, '{"distillable": true, "confidence": 3}')], "i int, reply string")
    got = {r.i: (r.distillable, r.reason, r.confidence) for r in documents.verdict(rows).collect()}
    lost = (False, "judge output unparseable, refusing to distill", "low")
    assert got == {1: (True, "a }", "high"), 2: (False, "no reason given", "low"), 3: lost, 4: lost, 5: lost, 6: (True, "no reason given", "low")}
    tools = spark.createDataFrame([(1, '{"distillable": true, "reason": "r", "confidence": "medium"}'), (2, "[1]"), (3, "{"), (4, '"x"')], "i int, tool_input string")
    got = {r.i: (r.distillable, r.reason, r.confidence) for r in documents.tool_verdict(tools).collect()}
    assert got == {1: (True, "r", "medium"), 2: (False, "judge tool returned non-object input", "low"), 3: (False, "judge tool arguments not valid JSON", "low"), 4: (False, "judge tool returned non-object input", "low")}
    asked = spark.createDataFrame(
        [(1, "other", True, None, None, None), (2, "openai", False, None, None, None), (3, "anthropic", True, None, "x", "time"), (4, "anthropic", True, None, '{"distillable": true}', None), (5, "openai", True, "{", '{"distillable": true}', None)],
        "i int, provider string, has_key boolean, tool_input string, reply string, error string",
    )
    got = {r.i: (r.distillable, r.reason) for r in prompts.judged(asked).collect()}
    assert got == {1: (True, "unknown provider, judge skipped"), 2: (True, "OPENAI_API_KEY not set, judge skipped"), 3: (False, "judge call failed: time"), 4: (True, "no reason given"), 5: (False, "judge tool arguments not valid JSON")}


def test_outcome_codes(spark):
    names = ["found", "trusted", "small", "secrets", "distillable", "forced", "aborted", "bad_threshold", "duplicate", "inside", "writable"]
    fine = dict(found=True, trusted=True, small=True, secrets=False, distillable=True, forced=False, aborted=False, bad_threshold=False, duplicate=False, inside=True, writable=True)
    cases = [({}, 0), ({"found": False, "small": False}, 1), ({"trusted": False}, 5), ({"small": False, "secrets": True}, 6), ({"secrets": True, "distillable": False}, 2), ({"distillable": False, "duplicate": True}, 7), ({"distillable": False, "forced": True}, 0),
             ({"aborted": True, "duplicate": True}, 8), ({"bad_threshold": True, "duplicate": True}, 2), ({"duplicate": True, "writable": False}, 9), ({"inside": False}, 3), ({"writable": False}, 4), ({"found": None}, 0)]
    rows = spark.createDataFrame([(i, *(({**fine, **c})[n] for n in names)) for i, (c, _) in enumerate(cases)], "i int, " + ", ".join(f"{n} boolean" for n in names))
    assert [r.c for r in sorted(rows.select("i", prompts.outcome_code(**{n: F.col(n) for n in names}).alias("c")).collect())] == [c for _, c in cases]


def test_file_names_of_documents(spark):
    cases = ["---\nname: my-skill\n---", "name:   ../../.zshrc", "x\n name: no", "name: ###", "name:\n  next", "nothing"]
    got = values(spark, lambda c: prompts.file_name_of(c, F.lit("abcdefghij")), cases)
    assert got == ["my-skill", "zshrc", "abcdefgh", "abcdefgh", "next", "abcdefgh"]


# --- logs


LOG = [
    '{"type":"user","sessionId":"s1","cwd":"/w/p","gitBranch":"main","timestamp":"2026-01-01T10:00:00Z","message":{"role":"user","content":"do it"}}',
    '{"type":"assistant","uuid":"u1","timestamp":"2026-01-01T10:00:05Z","message":{"role":"assistant","usage":{"input_tokens":5,"output_tokens":2},"content":[{"type":"text","text":"a"},{"type":"tool_use","name":"Bash","input":{"command":"ls"}},{"type":"tool_use","name":"Write","input":{"file_path":"/w/p/x.ts"}}]}}',
    '{"type":"tool_result","parentUuid":"u1","message":{"content":"first"}}', '{"type":"tool_result","parentUuid":"u1","message":{"content":[{"n": 1}]}}', '{"type":"tool_result","parentUuid":"u1","message":{"content":""}}',
    '{"type":"tool_result","parentUuid":"","message":{"content":"lost"}}', "null", "{broken", "", '{"type":"user","message":{"role":"user","content":[{"type":"tool_result"}]},"timestamp":"2026-01-01T09:00:00Z"}',
]


def test_log_of_the_first_kind(spark):
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate(LOG)], "session_id string, line_no int, line string")
    parsed = parsing.entries(lines)
    assert [(r.name, r.output) for r in parsing.tool_calls(parsed).orderBy("tool_idx").collect()] == [("Bash", '[{"n":1}]'), ("Write", '[{"n":1}]')]
    row = parsing.sessions(parsed).first()
    assert (row.log_id, row.project, row.branch, row.started_at, row.ended_at, row.user_messages, row.assistant_messages, row.tool_calls, row.input_tokens, row.files_modified, row.unique_tools) == (
        "s1", "/w/p", "main", "2026-01-01T10:00:00Z", "2026-01-01T09:00:00Z", 2, 1, 2, 5, ["/w/p/x.ts"], ["Bash", "Write"])
    assert parsing.sessions(parsing.entries(lines.limit(0))).count() == 0


def test_log_of_the_second_kind(spark):
    made = [
        '{"type":"session_meta","timestamp":"2026-01-01 10:00:00","payload":{"id":"c1","cwd":"/w/c","model":"m"}}',
        '{"type":"response_item","timestamp":"2026-01-01 10:00:01","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"go"},{"type":"image","text":"no"}]}}',
        '{"type":"response_item","timestamp":"2026-01-01 10:00:02","payload":{"type":"message","role":"developer","content":[]}}',
        '{"type":"response_item","timestamp":"2026-01-01 10:00:03","payload":{"type":"message","role":"assistant","content":[{"type":"output_text","text":"yes"}]}}',
        '{"type":"response_item","timestamp":"2026-01-01 10:00:04","payload":{"type":"function_call","name":"shell","arguments":"{\\"a\\":1}"}}',
        '{"type":"response_item","timestamp":"2026-01-01 10:00:05","payload":{"type":"web_search_call"}}',
        '{"type":"response_item","timestamp":"2026-01-01 10:00:00","payload":{"type":"function_call","name":"late","arguments":"x"}}',
        '{"type":"response_item","timestamp":"2026-01-01 10:00:09","payload":{"type":"function_call","name":"blocked"}}',
        '{"type":"event_msg","payload":{"type":"token_count","input_tokens":7,"info":{"input_tokens":99}}}', '{"type":"event_msg"}', "null",
    ]
    lines = spark.createDataFrame([("b", i, t, "codex") for i, t in enumerate(made)] + [("a", i, t, "claude-code") for i, t in enumerate(LOG)], "session_id string, line_no int, line string, agent string")
    rows, said, calls = parsing.parse(lines)
    b = rows.where("session_id = 'b'").first()
    assert (b.agent, b.log_id, b.project, b.branch, b.started_at, b.user_messages, b.assistant_messages, b.tool_calls, b.input_tokens, b.output_tokens, b.unique_tools, b.files_modified) == (
        "codex", "c1", "/w/c", "unknown", "2026-01-01 10:00:00", 1, 1, 4, 7, 0, ["shell", "web_search_call", "late", "blocked"], [])
    assert [(r.role, r.content) for r in said.where("session_id = 'b'").orderBy("idx").collect()] == [("user", "go"), ("assistant", "yes")]
    assert [(r.name, r.input, r.idx) for r in calls.where("session_id = 'b'").orderBy("tool_idx").collect()] == [("shell", '{"a":1}', 3), ("web_search_call", "{}", 3)]
    assert rows.count() == 2 and parsing.codex_model(parsing.codex_entries(lines.where("agent = 'codex'"))).first().model == "m"


def test_messages_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([("a", 1, "user", "x"), ("a", 1, "assistant", "y"), ("a", 2, "user", "z"), (None, 1, "user", "n")], "session_id string, idx int, role string, content string")
    got = sorted((str(r.session_id), r.idx, r.content, r.dropped) for r in sessions.cap_last(rows, 2).collect())
    assert got == [("None", 1, "n", 0), ("a", 1, "x", 1), ("a", 2, "z", 1)]
    assert sessions.cap_last(rows.limit(0), 2).count() == 0


def test_calls_go_to_messages_in_order(spark):
    rnd = random.Random(4)
    start = datetime(2026, 1, 1)
    when = lambda sorted_, n: [None if rnd.random() < 0.1 else start + timedelta(seconds=t) for t in (sorted if sorted_ else list)([rnd.randint(0, 9) for _ in range(n)])]
    said, called, want = [], [], {}
    for k in range(300):
        m, c = when(k % 2, rnd.randint(0, 5)), when(False, rnd.randint(0, 6))
        said += [(k, i, t) for i, t in enumerate(m)]
        called += [(k, i, t) for i, t in enumerate(c)]
        at = 0
        for i, t in enumerate(m):
            while at < len(c) and t is not None and c[at] is not None and c[at] >= t:
                want[k, at] = i
                at += 1
    schema = "session_id int, {} int, ts timestamp"
    got = sessions.attach_in_order(spark.createDataFrame(said, schema.format("idx")), spark.createDataFrame(called, schema.format("ord")))
    assert {(r.session_id, r.ord): r.idx for r in got.collect()} == want and want


def session_of(spark, **more):
    base = dict(session_id=1, agent="claude-code", log_id="abcdefgh-1", project="/w/My App", branch="main", unique_tools=["Bash"], files_modified=["/w/My App/src/a.ts", "/etc/b"], tool_calls=2)
    row = {**base, **more}
    return spark.createDataFrame([tuple(row.values())], "session_id int, agent string, log_id string, project string, branch string, unique_tools array<string>, files_modified array<string>, tool_calls long")


def test_prompts_scan_before_they_cut(spark):
    key = "sk-ant-api03" + "A" * 40
    said = spark.createDataFrame([(1, 0, "user", "x" * 590 + key), (1, 1, "assistant", "m" * 490 + " " + key), (1, 2, "assistant", ""), (1, 3, "developer", "d")], "session_id int, idx int, role string, content string")
    calls = spark.createDataFrame([(1, 1, 0, "Bash", '{"command":"echo ' + "y" * 380 + key + '"}', "o" * 300), (1, 1, 1, "Bash", '{"command":"ls"}', ""), (1, 3, 0, "Read", '{"file_path":"/w/My App/../z"}', "n")], "session_id int, idx int, tool_idx int, name string, input string, output string")
    row = prompts.distill_prompt(session_of(spark), said, calls).first()
    assert "A" * 10 not in row.prompt and [m.location for m in row.matches] == ["intent", "message[0]", "message[1]", "tool-call[1][0]", "outcome"]
    assert "### Project\nMy App\n" in row.prompt and "- Files modified: src/a.ts, b\n" in row.prompt and "- Bash: ls\n- Read z\n" in row.prompt and "developer: d" in row.prompt
    sent = prompts.scanned_prompt(prompts.distill_prompt(session_of(spark), said, calls), "abort").first()
    assert sent.status == "aborted" and sent.sent is None and prompts.scanned_prompt(prompts.distill_prompt(session_of(spark), said, calls), "redact").first().status == "redacted"
    judge = prompts.judge_prompt(session_of(spark), said, calls).first().prompt
    assert "- Last 3 Bash outputs: " + "o" * 200 + "\n" in judge and "x" * 500 + "\n" in judge
    bare = prompts.distill_prompt(session_of(spark, files_modified=[], unique_tools=[], tool_calls=0), said.where("role = 'none'"), calls.limit(0)).first()
    assert "(no user message)" in bare.prompt and "(no tool calls)" in bare.prompt and "(none)" in bare.prompt and "(no final assistant message)" in bare.prompt and bare.dropped == 0
    capped = prompts.distill_prompt(session_of(spark), said, calls, most=2).first()
    assert "### Intent (first user message)\n(no user message)" in capped.prompt and "Bash" not in capped.prompt.split("### Actions")[1].split("### Outcome")[0] and capped.dropped == 2


def test_distill_from_end_to_end(spark):
    two = session_of(spark).unionByName(session_of(spark, session_id=2, log_id="second-22", project="p")).unionByName(session_of(spark, session_id=3, log_id="third", files_modified=[], tool_calls=0))
    said = spark.createDataFrame([(i, 0, "user", "fix the build" if i < 3 else "hi") for i in (1, 2, 3)], "session_id int, idx int, role string, content string")
    calls = spark.createDataFrame([], "session_id int, idx int, tool_idx int, name string, input string, output string")
    offline = {r.session_id: r for r in engine.distill(two, said, calls, "2026-01-31").collect()}
    assert {i: r.code for i, r in offline.items()} == {1: 0, 2: 0, 3: 0} and offline[1].file == "my-app-abcdefgh-stub" and "distill_prompt_version" not in offline[1].document
    assert any("unknown frontmatter" in v for v in offline[1].violations)
    good = '{"name":"fix-builds","description":"Fix builds","when_to_use":"w","steps":["s"]}'
    replies = spark.createDataFrame([(i, "anthropic", True, '{"distillable": true, "reason": "r", "confidence": "high"}', None, None, good if i != 2 else '{"abort":"no_artifact","reason":"n"}') for i in (1, 2, 3)],
                                    "session_id int, provider string, has_key boolean, tool_input string, judge_reply string, judge_error string, reply string")
    old = spark.createDataFrame([("/s/x.md", "---\ndescription: fix builds\n---")], "path string, text string")
    got = {r.session_id: (r.code, r.mode, r.file) for r in engine.distill(two, said, calls, "2026-01-31", replies=replies).collect()}
    assert got == {1: (0, "llm", "fix-builds"), 2: (8, None, None) if got[2][2] is None else (8, None, "second-2"), 3: (7, "llm", "fix-builds")}
    gated = {r.session_id: r.code for r in engine.distill(two, said, calls, "2026-01-31", replies=replies, existing=old).collect()}
    assert gated == {1: 9, 2: 8, 3: 7}
    forced = {r.session_id: (r.code, r.mode) for r in engine.distill(two, said, calls, "2026-01-31", replies=replies, forced=True).collect()}
    assert forced == {1: (0, "llm"), 2: (0, "template"), 3: (0, "llm")}


# --- files


def test_files_links_and_sinks(spark, tmp_path):
    root, other = tmp_path / "logs", tmp_path / "other"
    for d in (root / "p1", root / "p2", other):
        d.mkdir(parents=True)
    (root / "p1" / "one.jsonl").write_text("﻿ \n" + "\n".join(LOG) + "\n")
    (root / "p2" / "two.jsonl").write_text("\n".join(LOG[:2]))
    (root / "p1" / "skip.txt").write_text("x")
    (other / "far.jsonl").write_text("{}")
    os.symlink(other / "far.jsonl", root / "p1" / "link.jsonl")
    os.symlink(other, root / "p3")
    found = session_logs.catalog(spark, str(root), "claude-code")
    assert sorted(r.session_id for r in found.collect()) == ["one", "two"]
    both = session_logs.every_catalog(spark, str(root), str(tmp_path / "none"))
    assert both.count() == 2 and session_logs.lookup(both, "tw").first().session_id == "two"
    paths = spark.createDataFrame([(str(root / "p1" / "one.jsonl"),), (str(root / "p1" / "link.jsonl"),), (str(root / "p3" / "far.jsonl"),), (str(root / "p1"),), (str(root / "gone"),)], "path string")
    assert [r.trusted for r in session_logs.trusted(paths, str(root)).collect()] == [True, False, False, False, False]
    rows, said, calls = engine.parse_sessions(spark, str(root), str(tmp_path / "none"), "claude-code")
    assert sorted((r.session_id, r.tool_calls) for r in rows.collect()) == [("one", 2), ("two", 2)]
    assert engine.parse_sessions(spark, str(tmp_path / "none"), str(tmp_path / "none"))[0].count() == 0
    mined = engine.corpus_lines(spark, str(root), "claude-code", 1, 10**6)
    assert sorted(r.session_id for r in mined.select("session_id").distinct().collect()) == ["one", "two"] and engine.corpus_lines(spark, str(root), "claude-code").count() == 0
    assert [len(r.line) > 20 for r in engine.list_sessions(spark, str(root), str(tmp_path / "none"), "claude-code").collect()] == [True, True]
    assert engine.preview(rows).where("session_id = 'one'").first().text.startswith("Session: s1...\nAgent:   claude-code\nProject: /w/p\n")
    counts = session_logs.scan_counts(found, rows, 0, 10**6).first()
    assert tuple(counts) == (2, 0, 0, 2) and tuple(session_logs.scan_counts(found, rows.limit(0), 0, 10**6).first()) == (2, 0, 2, 0) and session_logs.scan_counts(found, rows).first().skipped_size == 2
    out = tmp_path / "skills"
    docs = spark.createDataFrame([("a", "x\r\n"), ("../up", "no"), ("b", None)], "name string, document string")
    assert sorted((r.name, r.code) for r in session_logs.write_documents(docs, str(out)).collect()) == [("../up", 3), ("a", 0), ("b", 0)]
    os.symlink(out / "a.md", out / "c.md")
    again = spark.createDataFrame([("a", "new"), ("c", "new")], "name string, document string")
    assert sorted((r.name, r.code) for r in session_logs.write_documents(again, str(out)).collect()) == [("a", 4), ("c", 4)]
    assert sorted((r.name, r.code) for r in session_logs.write_documents(again, str(out), force=True).collect()) == [("a", 0), ("c", 4)] and (out / "a.md").read_text() == "new"
    assert sorted(r.path.rsplit("/", 1)[1] for r in session_logs.documents(spark, str(out)).collect()) == ["a.md"]  # empty files are left out


def test_line_limits_count_utf16_units(spark):
    cases = ["a" * 10, "a" * 11, "😀" * 5, "😀" * 5 + "a", "é" * 10, "é" * 11]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", F.size(session_logs.numbered(F.col("c"), 10)).alias("n")).collect()
    assert [r.n for r in sorted(got)] == [1, 0, 1, 0, 1, 0]


def test_events_and_streams(spark, tmp_path, monkeypatch):
    made = spark.createDataFrame([("s1", "n", "/p/n.md", "codex", 5, 2, "llm", "2026-01-01T10:00:00Z"), ("s1", "n", "/p/n.md", "codex", 5, 2, "llm", "2026-01-01T10:00:00Z"), ("s2", "m", "/p/m.md", "codex", 5, 2, "template", "2026-01-01T14:30:00Z")],
                                 "session_id string, name string, path string, agent string, input_tokens long, output_tokens long, mode string, ts string")
    events = session_logs.created_events(made)
    row = events.first()
    assert row.type == "skill.created" and row.event_id.startswith("evt_") and row.attrs.skill_path == "/p/n.md" and row.attrs.token_cost_input == 5
    folder = str(tmp_path / "events")
    monkeypatch.setenv(session_logs.NO_EVENTS, "1")
    session_logs.append_events(events, folder)
    assert not os.path.exists(folder)
    monkeypatch.setenv(session_logs.NO_EVENTS, "true")
    session_logs.append_events(events, folder)
    write_stream(event_counts(read_events(spark, folder)), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    got = [(str(r.start), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [("2026-01-01 10:00:00", 1)]  # the second window is open until a later event comes
    logs = tmp_path / "logs"
    logs.mkdir()
    user = '{"type":"user","timestamp":"2026-01-01T%s:00Z","message":{"role":"user","content":"x"}}'
    (logs / "s.jsonl").write_text("\n".join(user % t for t in ("10:00", "10:20", "12:00", "15:30")))
    write_stream(session_activity(read_lines(spark, str(logs))), str(tmp_path / "bouts"), str(tmp_path / "c2")).awaitTermination()
    bouts = sorted((str(r.start), r.users) for r in spark.read.parquet(str(tmp_path / "bouts")).collect())
    assert bouts == [("2026-01-01 10:00:00", 2), ("2026-01-01 12:00:00", 1)]


# --- mining and reports


def test_reports(spark, tmp_path):
    logs = [("a", i, t) for i, t in enumerate(LOG)] + [("b", 0, LOG[0].replace("do it", "a | b"))]
    parsed = parsing.entries(spark.createDataFrame(logs, "session_id string, line_no int, line string"))
    scored = mining.score(mining.sessions_of_logs(parsed))
    got = {r.session_id: (r.score, r.reasons, r.tier) for r in scored.collect()}
    assert got["b"] == (-6, ["-3 zero-tools", "-1 short:0s", "-2 slash-only-intent"], "C")
    more = parsing.sessions(parsed).select("session_id", "project", "branch", "unique_tools", "files_modified", "output_tokens")
    rows = scored.join(more, "session_id").withColumns({"path": F.concat(F.lit("/h/me/l/"), F.col("session_id")), "size_kb": F.lit(3), "first": F.when(F.col("session_id") == "a", "x | y\nz").otherwise(""), "last": F.lit("done")})
    lines = [r.line for r in reports.mining_report(rows, "All", "two", "/h/me").orderBy("major", "minor").collect()]
    assert lines[0] == "# All" and "| 1 | C | 4 | 2 | 1 | -3600 | 5 | w/p | x \\| y z |  |" in lines and "### 2. [C] `~/l/b`" in lines and "> _(empty)_" in lines and lines.index("## Per-session detail") > lines.index("## Summary table")
    reports.write_text(reports.mining_report(rows, "All", "two"), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()][0] == "# All"
    text = "[" + ",".join(r.value for r in reports.mined_json(rows).collect()) + "]"
    (tmp_path / "m.json").write_text(text)
    back = {r.session_id: (r.tools, r.files, r.tokens, r.slash_only, r.intent) for r in session_logs.mined_sessions(spark, str(tmp_path / "m.json")).collect()}
    assert back == {"a": (2, 1, 5, True, "x | y z"), "b": (0, 0, 0, True, "")}
    labelled = mining.classify(rows).withColumn("candidate", F.lit(1))
    lines = [r.line for r in reports.label_report(labelled).orderBy("major", "minor").collect()]
    assert "- **not**: 2 (expected to abort)" in lines and "## Distillable (should produce skill) (0)" in lines and any(x.startswith("| 1 | not | <3 tool calls | 2 |") for x in lines)
    metrics = mining.confusion(spark.createDataFrame([(True, True), (True, False), (False, False), (False, False)], "expected boolean, predicted boolean"))
    lines = [r.line for r in reports.confusion_report(metrics).orderBy("minor").collect()]
    assert "Fixtures: 4 (2 distillable, 2 not)" in lines and "- **Accuracy**: 75.0% (3/4)" in lines and "- **F1**: 66.7%" in lines
    empty = mining.confusion(spark.createDataFrame([], "expected boolean, predicted boolean")).first()
    assert empty.accuracy == empty.f1 == 0.0


def test_fixture_checks(spark):
    rows = spark.createDataFrame([(1, "skill", ["A", "b"], ["Z"], "skill", "xaB", 10), (2, "skill", ["q"], None, "skill", "x", 11), (3, "abort", None, None, "skill", "x", 10), (4, "abort", None, None, "abort", None, 10), (5, "skill", ["a"], [], "abort", None, 10), (6, "skill", [], [], "error", None, 10)],
                                 "i int, expected_kind string, must array<string>, must_not array<string>, kind string, output string, prompt_chars int")
    got = {r.i: (r.passes, r.details, r.missing) for r in mining.fixture_check(rows).collect()}
    assert got == {1: (True, "All checks passed.", []), 2: (False, "missing=1, unexpected=0", ["q"]), 3: (False, "Expected abort but got a skill.", []), 4: (True, "Aborted", []), 5: (False, "Aborted", []), 6: (False, "Unexpected error", [])}
    m = mining.evaluation(mining.fixture_check(rows)).first()
    assert tuple(m) == (6, 2, 33, 2, 1, 2, 10)
    lines = [r.line for r in reports.evaluation_report(mining.evaluation(mining.fixture_check(rows))).orderBy("minor").collect()]
    assert lines[2] == "- **Pass rate:** 2/6 (33%)"
    assert mining.evaluation(mining.fixture_check(rows.limit(0))).first().total == 0
