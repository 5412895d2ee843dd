"""Skill documents: payloads from model replies, rendering, the output filter, and prompt metrics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as T

# Tags that a document may carry, and keys of its front block.
TAGS = ("testing", "debugging", "api", "database", "security", "auth", "performance", "deployment", "refactor", "typescript", "react", "next-js", "supabase", "build", "tooling", "ci", "migrations", "observability")
KEYS = ("name", "description", "source_session", "source_agent", "created", "tags")
PROMPT_VERSION = "v2.2026-04-19"
_TOKENS = re.compile(r'"(?:\\.|[^"\\])*"|\\.|[{}]', re.S)


def first_object(reply: str | None) -> str | None:
    """The text from the first ``{`` to the brace that closes it, strings aside; None where none closes."""
    start = (reply or "").find("{")
    depth = 0
    for m in _TOKENS.finditer(reply, start) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0:
            return reply[start : m.end()]
    return None


def _first_objects(replies: pd.Series) -> pd.Series:
    return replies.map(first_object)


def _text(v: Column, key: str) -> Column:
    """A field where it is a JSON string, else null."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def _list(v: Column, key: str) -> Column:
    """Trimmed non-empty strings of a list field."""
    items = F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", T.trim(F.try_variant_get(x, "$", "string"))))
    return F.filter(texts, lambda x: x.isNotNull() & (x != ""))


def payload(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Adds ``kind`` (skill, abort or error) and the fields of the payload.

    Names that are no kebab case become ``untitled-skill``; steps are at most 8, decisions
    5, tags 4 of ``TAGS``; an unknown confidence is low.
    """
    v = F.try_parse_json(F.col("_json"))
    some = replies.withColumn("_json", pandas_udf(_first_objects, "string")(F.col(f"`{reply_col}`")))
    tags = F.array_distinct(F.filter(F.transform(_list(v, "tags"), T.tag), lambda t: t.isin(*TAGS)))
    fields = {
        "abort": F.when(_text(v, "abort").isin("no_artifact", "no_reusable_pattern"), _text(v, "abort")), "reason": F.coalesce(_text(v, "reason"), F.lit("")),
        "name": T.kebab_name(F.coalesce(_text(v, "name"), F.lit("")), "untitled-skill"), "description": T.frontmatter_value(F.coalesce(_text(v, "description"), F.lit(""))),
        "when_to_use": T.trim(F.coalesce(_text(v, "when_to_use"), F.lit(""))), "steps": F.slice(_list(v, "steps"), 1, 8), "example": T.trim(F.coalesce(_text(v, "example"), F.lit(""))),
        "key_decisions": F.slice(_list(v, "key_decisions"), 1, 5), "tags": F.slice(tags, 1, 4),
        "confidence": F.when(_text(v, "confidence").isin("high", "medium", "low"), _text(v, "confidence")).otherwise("low"), "why_this_worked": T.trim(F.coalesce(_text(v, "why_this_worked"), F.lit(""))),
    }
    sound = (F.col("description") != "") & (F.col("when_to_use") != "") & (F.size("steps") > 0)
    kind = F.when(F.col("abort").isNotNull(), "abort").when(F.coalesce(sound & F.col("_json").isNotNull(), F.lit(False)), "skill").otherwise("error")
    return some.withColumns(fields).withColumn("kind", kind).drop("_json")


def _judged(v: Column, broken: str) -> dict[str, Column]:
    """Verdict of a JSON value that should be an object; ``broken`` is the reason where it is none."""
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    yes = F.coalesce((F.schema_of_variant(F.try_variant_get(v, "$.distillable", "variant")) == "BOOLEAN") & F.try_variant_get(v, "$.distillable", "boolean"), F.lit(False))
    level = F.when(_text(v, "confidence").isin("high", "medium", "low"), _text(v, "confidence")).otherwise("low")
    return {
        "distillable": is_object & yes, "reason": F.when(is_object, F.coalesce(_text(v, "reason"), F.lit("no reason given"))).otherwise(broken),
        "confidence": F.when(is_object, level).otherwise("low"),
    }


def verdict(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Adds ``distillable`` (only where JSON says true), ``reason`` and ``confidence`` of a judge's reply in text; closed on failure."""
    rows = replies.withColumn("_json", pandas_udf(_first_objects, "string")(F.col(f"`{reply_col}`")))
    return rows.withColumns(_judged(F.try_parse_json(F.col("_json")), "judge output unparseable, refusing to distill")).drop("_json")


def tool_verdict(calls: DataFrame, input_col: str = "tool_input") -> DataFrame:
    """As ``verdict``, of the JSON that the judge gave to its tool: the whole of it, with nothing around."""
    v = F.try_parse_json(F.col(f"`{input_col}`"))
    broken = F.when(v.isNull(), "judge tool arguments not valid JSON").otherwise("judge tool returned non-object input")
    return calls.withColumns(_judged(v, broken))


def _bullets(items: Column, mark: str, empty: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit(mark), x)), "\n")).otherwise(F.lit(mark + empty))


def render() -> Column:
    """The document of a payload's columns with ``session_id, agent, created``."""
    c = F.col
    steps = F.array_join(F.transform("steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    front = [("name", c("name")), ("description", T.frontmatter_value(c("description"))), ("source_session", c("session_id")), ("source_agent", c("agent")), ("created", c("created")),
             ("distill_prompt_version", F.lit(PROMPT_VERSION)), ("confidence", c("confidence"))]
    body = [("When to use", c("when_to_use")), ("Steps", steps), ("Example", F.coalesce(F.nullif(c("example"), F.lit("")), F.lit("(no example captured)"))),
            ("Key decisions", _bullets(c("key_decisions"), "- ", "(none captured)")), ("Why this worked", F.coalesce(F.nullif(c("why_this_worked"), F.lit("")), F.lit("(not captured)")))]
    lines = [F.lit("---\n"), *(x for k, v in front for x in (F.lit(f"{k}: "), v, F.lit("\n"))), F.lit("tags:\n"), _bullets(c("tags"), "  - ", "auto-extracted"), F.lit("\n---\n\n# "), T.titleize(c("name")), F.lit("\n")]
    return F.concat(*lines, *(x for title, v in body for x in (F.lit(f"\n## {title}\n"), v, F.lit("\n"))))


_COMMENT, _MARK = r"(?s)<!--.*?--!?>", "<!--|--!?>"


def _settle(c: Column, pattern: str) -> Column:
    """``text, n``: the text without matches, removed again until none is left, and how many went.

    Each further pass takes an angle bracket at least, so that there are never more passes
    than brackets; after the first hardly a text has any match.
    """
    gone = lambda acc: F.struct(F.regexp_replace(acc["text"], pattern, "").alias("text"), (acc["n"] + F.regexp_count(acc["text"], F.lit(pattern))).cast("int").alias("n"))
    first = F.struct(F.regexp_replace(c, pattern, "").alias("text"), F.regexp_count(c, F.lit(pattern)).cast("int").alias("n"))
    left = F.when(first["text"].rlike(pattern), F.regexp_count(first["text"], F.lit("[<>]"))).otherwise(0)
    passes = F.slice(F.sequence(F.lit(0), left), 2, left)
    return F.aggregate(passes, first, lambda acc, _: F.when(acc["text"].rlike(pattern), gone(acc)).otherwise(acc))


def filter_output(docs: DataFrame, text_col: str = "text", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds ``clean`` and ``violations``: direction marks, comments, long fences and unknown keys of the front block go.

    All native. Null texts are empty.
    """
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.withColumns({"_n1": F.regexp_count(t, F.lit("[‪-‮⁦-⁩]")), "_t": T.strip_directional(t)})
    marked = F.col("_t").rlike(_MARK)
    rows = rows.withColumn("_c", F.when(marked, _settle(F.col("_t"), _COMMENT)))
    rows = rows.withColumn("_d", F.when(marked, _settle(F.col("_c.text"), _MARK)))
    rows = rows.withColumns({"_n2": F.coalesce(F.col("_c.n") + F.col("_d.n"), F.lit(0)), "_t": F.coalesce("_d.text", "_t")})
    rows = rows.withColumns({"_n3": F.regexp_count(F.col("_t"), F.lit("(?m)^`{4,}")), "_t": T.flatten_fences(F.col("_t"))})
    block = F.regexp_extract("_t", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    key = lambda line: F.regexp_extract(line, r"^([a-zA-Z_][a-zA-Z0-9_-]*)\s*:", 1)
    # a line without a key shares the fate of the key before it
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("gone"))

    def step(acc: Column, line: Column) -> Column:
        on = F.when(key(line) != "", key(line).isin(*keys)).otherwise(acc["on"])
        return F.struct(on.alias("on"), F.when(on, F.array_append(acc["kept"], line)).otherwise(acc["kept"]).alias("kept"),
                        F.when((key(line) != "") & ~on, F.array_append(acc["gone"], key(line))).otherwise(acc["gone"]).alias("gone"))

    rows = rows.withColumn("_f", F.when(block != "", F.aggregate(F.split(block, r"\r?\n"), start, step)))
    gone = F.array_distinct(F.coalesce("_f.gone", F.array().cast("array<string>")))
    whole = F.regexp_extract("_t", r"(?s)^---\r?\n.*?\r?\n---", 0)
    clean = F.concat(F.lit("---\n"), F.array_join("_f.kept", "\n"), F.lit("\n---"), F.substring(F.col("_t"), F.length(whole) + 1, F.length("_t")))
    say = lambda n, before, after: F.when(n > 0, F.concat(F.lit(before), n.cast("string"), F.lit(after)))
    violations = F.array_compact(F.array(
        say(F.col("_n1"), "stripped ", " Unicode directional-override char(s)"), say(F.col("_n2"), "stripped ", " HTML comment(s)/delimiter(s)"),
        say(F.col("_n3"), "normalized ", " nested code-fence line(s) (4+ backticks)"),
        F.when(F.size(gone) > 0, F.concat(F.lit("stripped unknown frontmatter key(s): "), F.array_join(gone, ", "))),
    ))
    return rows.withColumns({"clean": F.when(F.size(gone) > 0, clean).otherwise(F.col("_t")), "violations": violations}).drop("_t", "_c", "_d", "_f", "_n1", "_n2", "_n3")


def prompt_metrics(c: Column) -> dict[str, Column]:
    """Sizes, leaks of absolute paths, and which parts of a prompt are there."""
    has = lambda p: c.rlike(p)
    return {
        "chars": F.length(c), "lines": F.size(F.split(c, "\n")), "path_leaks": F.regexp_count(c, F.lit(r"/(?:Users|home)/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+")),
        "hints": F.regexp_count(c, F.lit('BAD:\\s*"Use ')) + F.regexp_count(c, F.lit(r"GOOD:")), "few_shot": has(r"(?i)Example\s+1\b") & has(r"(?i)Example\s+2\b"),
        "abort_protocol": has(r'(?i)"abort":\s*"no_artifact"|abort protocol'), "taxonomy": has("(?i)closed taxonomy"), "json_schema": has("(?i)EXACTLY ONE valid JSON"),
        "causal_chain": has("(?i)causal chain|discard dead ends"),
    }


def sum_metrics(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Metrics of each ``key``: sums of the sizes and counts, and the flags of its last row by ``order``."""
    counts, flags = ("chars", "lines", "path_leaks", "hints"), ("few_shot", "abort_protocol", "taxonomy", "json_schema", "causal_chain")
    return rows.groupBy(key).agg(*(F.sum(c).alias(c) for c in counts), *(F.max_by(c, order).alias(c) for c in flags))
