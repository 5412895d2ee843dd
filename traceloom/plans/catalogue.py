"""Registered queries over the driver's tables, with the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mining, sessions
from ..sources.tables import event_log, messages, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def jaro_winkler_sql(pairs: str) -> str:
    """SQL up to a relation ``sim (id, oid, s)`` of ``pairs``, a query for ``id, oid, a, b`` with texts in lower case.

    Letter by letter of ``a`` the first free place of the same letter within the window of ``b`` is taken.
    """
    return f"""WITH RECURSIVE pairs AS ({pairs}),
steps AS (SELECT id, oid, a, b, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS w, 0::BIGINT AS i, []::BIGINT[] AS places, []::VARCHAR[] AS letters FROM pairs
  UNION ALL SELECT id, oid, a, b, w, i + 1, CASE WHEN j IS NULL THEN places ELSE list_append(places, j) END, CASE WHEN j IS NULL THEN letters ELSE list_append(letters, a[i + 1]) END
  FROM (SELECT *, list_filter(range(greatest(1, i + 1 - w), least(length(b), i + 1 + w) + 1), lambda j: b[j] = a[i + 1] AND NOT list_contains(places, j))[1] AS j FROM steps WHERE i < length(a))),
ends AS (SELECT *, len(places) AS m, len(list_filter(range(1, len(places) + 1), lambda k: letters[k] <> b[list_sort(places)[k]])) / 2 AS t, CASE WHEN a[1] <> b[1] THEN 0 WHEN a[2] <> b[2] THEN 1 WHEN a[3] <> b[3] THEN 2 WHEN a[4] <> b[4] THEN 3 ELSE 4 END AS same
  FROM steps WHERE i = length(a)),
jaro AS (SELECT id, oid, least(same, length(a), length(b)) AS same, CASE WHEN m = 0 THEN 0 ELSE (m / length(a) + m / length(b) + (m - t) / m) / 3 END AS j FROM ends),
sim AS (SELECT id, oid, CASE WHEN j < 0.7 THEN j ELSE j + 0.1 * same * (1 - j) END AS s FROM jaro)"""


M = "WITH m AS (SELECT conv_id AS session_id, turn AS idx, role, coalesce(text, '') AS content FROM conversations)"
LOG = """WITH k AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS ep, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
log AS (SELECT *, ep // 259200 AS bucket, CASE WHEN event_type IN ('purchase', 'signup') THEN CASE WHEN k % 2 = 0 THEN 'src/f' || k || '.ts' ELSE 'docs/f' || k || '.md' END END AS path FROM k),
s AS (SELECT user_id, bucket, count(*) FILTER (event_type = 'view') AS users, count(*) FILTER (event_type <> 'view') AS tools, count(DISTINCT path) AS files,
  coalesce(bool_or(path LIKE '%.ts'), false) AS code, CAST(floor((max(ep) - min(ep)) / 60.0 + 0.5) AS BIGINT) AS duration, CAST(sum(floor(value)) AS BIGINT) AS tokens,
  user_id % 2 = 0 AS in_projects, user_id % 5 = 0 AS slash_only FROM log GROUP BY user_id, bucket),
sc AS (SELECT *, CAST((CASE WHEN files >= 1 THEN 3 ELSE 0 END) + (CASE WHEN code THEN 3 ELSE 0 END) + (CASE WHEN tools BETWEEN 3 AND 30 THEN 2 ELSE 0 END) + (CASE WHEN in_projects THEN 2 ELSE 0 END)
  + (CASE WHEN users >= 2 THEN 1 ELSE 0 END) + (CASE WHEN tokens > 1000 THEN 1 ELSE 0 END) - (CASE WHEN tools = 0 THEN 3 ELSE 0 END) - (CASE WHEN duration < 60 THEN 1 ELSE 0 END)
  - (CASE WHEN tools > 100 THEN 2 ELSE 0 END) - (CASE WHEN slash_only THEN 2 ELSE 0 END) AS BIGINT) AS score,
  CASE WHEN NOT slash_only AND tools >= 3 AND code AND in_projects THEN 'A' WHEN NOT slash_only AND tools >= 3 AND files >= 1 THEN 'B' ELSE 'C' END AS tier,
  CASE WHEN tools < 3 OR files = 0 OR duration < 30 OR (tools > 200 AND duration > 21600) THEN 'not'
    WHEN tools BETWEEN 4 AND 60 AND files BETWEEN 1 AND 15 AND duration BETWEEN 60 AND 3600 AND code THEN 'distillable' ELSE 'review' END AS label FROM s)"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    return event_log(table(spark, d, "events"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return mining.classify(mining.score(mining.sessions_of_events(_log(spark, d))))


@query(M + """SELECT session_id, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages, count(*) AS n_messages,
arg_min(content, idx) FILTER (role = 'user') AS first_user, arg_max(content, idx) FILTER (role = 'assistant' AND content <> '') AS last_assistant FROM m GROUP BY 1""")
def session_summary(spark, d):
    return sessions.summary(messages(table(spark, d, "conversations")))


@query(M + """, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) AS r, greatest(count(*) OVER (PARTITION BY session_id) - 3, 0) AS dropped FROM m)
SELECT session_id, idx, role, content, dropped FROM r WHERE r <= 3""")
def capped_messages(spark, d):
    return sessions.cap_last(messages(table(spark, d, "conversations")), 3)


@query(M + "SELECT session_id, string_agg(role || ': ' || content[1:500], chr(10) || chr(10) ORDER BY idx) AS block FROM m GROUP BY 1")
def conversation_block(spark, d):
    return sessions.conversation_block(messages(table(spark, d, "conversations")))


@query("""WITH c AS (SELECT user_id, event_type || ' ' || props AS output, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'view')
SELECT user_id AS session_id, string_agg(output[1:200], ' | ' ORDER BY r DESC) AS outputs FROM c WHERE r <= 3 GROUP BY 1""")
def last3_outputs(spark, d):
    calls = table(spark, d, "events").where("event_type <> 'view'")
    return sessions.last_outputs(calls.select(F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("ord"), F.concat_ws(" ", "event_type", "props").alias("output")))


@query(LOG + ", f AS (SELECT user_id, path, min(ep * 10000000 + event_id) AS o FROM log WHERE path IS NOT NULL GROUP BY 1, 2) SELECT user_id, string_agg(path, ',' ORDER BY o) AS files FROM f GROUP BY 1")
def files_modified(spark, d):
    log = _log(spark, d).withColumn("o", F.col("epoch") * 10000000 + F.col("event_id"))
    return sessions.first_seen(log, "user_id", "o", "path").select("user_id", F.array_join("values", ",").alias("files"))


def _codex(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), "ts", "event_type")
    return e.where("event_type = 'view'"), e.where("event_type = 'click'")


@query("""WITH a AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1),
c AS (SELECT user_id, event_id, min(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS low FROM events WHERE event_type = 'click')
SELECT c.user_id AS session_id, event_id AS ord, CASE WHEN low >= t THEN t END AS msg_ts FROM c LEFT JOIN a USING (user_id)""")
def codex_attach_compat(spark, d):
    m, c = _codex(spark, d)
    return sessions.attach_compat(m, c)


@query("""SELECT c.user_id AS session_id, c.event_id AS ord, a.ts AS msg_ts FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'view') a ON a.user_id = c.user_id AND a.ts <= c.ts""")
def codex_attach_asof(spark, d):
    m, c = _codex(spark, d)
    return sessions.attach_asof(m, c)


@query("SELECT user_id AS session_id, max(ts) AS modified FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def latest_sessions(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("modified")).orderBy(F.desc("modified"), "session_id").limit(20)


@query(LOG + "SELECT user_id, bucket, users, tools, files, duration, tokens, score, tier FROM sc")
def mine_score(spark, d):
    return _scored(spark, d).select("user_id", "bucket", "users", "tools", "files", "duration", "tokens", "score", "tier")


@query(LOG + "SELECT tier, count(*) AS n FROM sc GROUP BY 1")
def tier_counts(spark, d):
    return _scored(spark, d).groupBy("tier").agg(F.count("*").alias("n"))


@query(LOG + "SELECT user_id, bucket, label FROM sc")
def classify_label(spark, d):
    return _scored(spark, d).select("user_id", "bucket", "label")


@query(LOG + "SELECT label, count(*) AS n FROM sc WHERE (code AND in_projects AND tools >= 3) OR (files >= 1 AND tools >= 3 AND NOT slash_only) GROUP BY 1")
def candidate_labels(spark, d):
    return mining.candidates(_scored(spark, d)).groupBy("label").agg(F.count("*").alias("n"))


@query(LOG + """SELECT user_id, bucket, users > 0 AND NOT (files = 0 AND tools = 0) AS distillable, CASE WHEN users > 0 AND files = 0 AND tools = 0 THEN 'local signals contradict judge: 0 files modified and 0 tool calls (original: r)'
WHEN users = 0 AND files > 0 AND tools > 5 THEN 'r (local signals suggest distillable: ' || files || ' files modified, ' || tools || ' tool calls — judge disagreed)' ELSE 'r' END AS reason FROM sc""")
def local_signals(spark, d):
    judged = _scored(spark, d).withColumns({"distillable": F.col("users") > 0, "reason": F.lit("r"), "confidence": F.lit("low")})
    return mining.local_signals(judged).select("user_id", "bucket", "distillable", "reason")


@query("""WITH r AS (SELECT quality = 1 AS e, n_chars > 800 AS p FROM labels JOIN documents USING (doc_id)),
n AS (SELECT count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (NOT e AND NOT p) AS tn, count(*) FILTER (e AND NOT p) AS fn FROM r)
SELECT tp, fp, tn, fn, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall, (2 * tp)::DOUBLE / (2 * tp + fp + fn) AS f1 FROM n""")
def eval_confusion(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return mining.confusion(rows.select((F.col("quality") == 1).alias("expected"), (F.col("n_chars") > 800).alias("predicted")))


def _text_query(name: str, make, sql: str, alias: str, of: str = "documents", key: str = "doc_id", column: str = "text") -> None:
    def run(spark, d):
        return table(spark, d, of).select(key, make(F.col(column)).alias(alias))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {key}, {sql} AS {alias} FROM {of}"


_text_query("terminal_safe", T.terminal_safe, r"regexp_replace(text, '[\x00-\x1f\x7f-\x{9f}]', '', 'g')", "safe")
_SP = r"[\s\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_FM = rf"regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f-\x{{9f}}]', ' ', 'g'), '{_SP}+', ' ', 'g'), '^ | $', '', 'g')"
_text_query("frontmatter_value", T.frontmatter_value, _FM, "value")
_KEBAB = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_KEB = _KEBAB.format("text[1:256]")
_text_query("kebab_name", lambda c: T.kebab_name(c, "untitled"), f"CASE WHEN regexp_full_match({_KEB}, '[a-z][a-z0-9]*(-[a-z0-9]+)*') AND length({_KEB}) <= 64 THEN {_KEB} ELSE 'untitled' END", "name")
_text_query("titleize", lambda c: T.titleize(T.kebab_chars(c)), f"array_to_string(list_transform(string_split({_KEB}, '-'), lambda w: upper(w[1:1]) || w[2:]), ' ')", "title")
_FN = "regexp_replace(regexp_replace(text, '[^A-Za-z0-9_-]', '-', 'g')[1:100], '^[-.]+', '')"
_text_query("skill_filename", lambda c: T.file_name(c, "skill"), f"CASE WHEN {_FN} = '' THEN 'skill' ELSE {_FN} END", "file")
_CUT = r"CASE WHEN regexp_matches(text[1:100], '[ \n;,)]') THEN length(regexp_extract(text[1:100], '(?s)^(.*)[ \n;,)]', 1)) ELSE -1 END"
_text_query("smart_truncate", lambda c: T.smart_truncate(c, 100), rf"CASE WHEN length(text) <= 100 THEN text ELSE regexp_replace(text[1:(CASE WHEN {_CUT} > 60 THEN {_CUT} ELSE 100 END)], '{_SP}+$', '') || '…' END", "short")
_text_query("md_escape", T.md_cell, r"replace(replace(text, '\', '\\'), '|', '\|')", "cell")
_text_query("truncate_skill", lambda c: T.truncate_document(c, 1000), "CASE WHEN length(text) > 1000 THEN text[1:1000] || chr(10) || '... [TRUNCATED]' ELSE text END", "body")
_text_query("nested_fences", lambda c: T.flatten_fences(F.concat(F.lit("`````\n"), c, F.lit("\n````\n"))), "regexp_replace('`````' || chr(10) || text || chr(10) || '````' || chr(10), '(?m)^`{4,}', '```', 'g')", "body")
_text_query("bidi_strip", lambda c: T.strip_directional(F.concat(F.lit("‮"), c, F.lit("⁦"))), r"regexp_replace(chr(8238) || text || chr(8294), '[\x{202a}-\x{202e}\x{2066}-\x{2069}]', '', 'g')", "body")
_text_query("strip_comments", T.strip_comments, "regexp_replace(html, '(?s)<!--.*?--!?>', '', 'g')", "body", "pages", "page_id", "html")
_text_query("anonymize_url_path", lambda c: T.base_name(c), "string_split(url, '/')[-1]", "name", "pages", "page_id", "url")
_text_query("project_slug", T.project_slug, "regexp_replace(lower(string_split(url, '/')[-1]), '[^a-z0-9]+', '-', 'g')", "slug", "pages", "page_id", "url")
_text_query("fixture_checks", lambda c: T.contains_ci(c, "THE") & ~T.contains_ci(c, "token"), "contains(lower(text), 'the') AND NOT contains(lower(text), 'token')", "passed")


from . import distill, logs  # noqa: E402, F401  (they register their queries here)
