"""One line of text for a tool call, from its name and its JSON input; all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

UNBOUNDED = (1 << 31) - 1


def anonymize(path: Column, root: Column | str, home: str = "") -> Column:
    """Relative to ``root`` inside of it, ``~`` for ``home``, else the base name.

    ``.`` and ``..`` are resolved first, so that no path leads out. Relative paths are
    taken from ``root``; without an absolute root they become their base name.
    """
    root = F.lit(root) if isinstance(root, str) else root
    rooted, relative = F.coalesce(root.startswith("/"), F.lit(False)), ~path.startswith("/")
    parts, above = T.path_parts(F.when(relative, F.concat(root, F.lit("/"), path)).otherwise(path)), T.path_parts(root)
    rest = F.array_join(F.slice(parts, F.size(above) + 1, F.greatest(F.size(parts) - F.size(above), F.lit(0))), "/")
    inside = rooted & (F.size(parts) > F.size(above)) & (F.slice(parts, 1, F.size(above)) == above) & ~rest.startswith("..")
    out = F.when(path == "", path).when(inside, rest)
    if home:
        out = out.when((path == home) | path.startswith(home + "/"), F.concat(F.lit("~"), F.substring(path, len(home) + 1, UNBOUNDED)))
    return out.otherwise(T.file_base_name(path))


def tool_line(name: Column, input_json: Column, root: Column | str = "", home: str = "", most: int = 160) -> Column:
    """What the call does: path, command, pattern or the first text field, each at most ``most`` characters."""
    value = F.try_parse_json(input_json)

    def raw(k: str) -> Column:  # text fields alone
        v = F.try_variant_get(value, f"$.{k}", "variant")
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(value, f"$.{k}", "string"))

    def field(k: str) -> Column:
        return F.nullif(T.smart_truncate(raw(k), most), F.lit(""))

    def path(k: str) -> Column:
        return F.nullif(anonymize(raw(k), root, home), F.lit(""))

    def tail(before: str, c: Column, after: str = "") -> Column:
        return F.when(c.isNotNull(), F.concat(F.lit(before), c, F.lit(after))).otherwise("")

    def lead(label: Column | str, *rest: Column) -> Column:
        return F.trim(F.concat(F.lit(label) if isinstance(label, str) else label, *rest))

    file, body = path("file_path"), F.coalesce(raw("content"), F.lit(""))
    head = F.array_join(F.slice(F.split(body, "\n"), 1, 2), " · ")
    wrote = F.concat(F.lit("Write "), file, F.lit(" ("), F.length(body), F.lit("b): "), T.smart_truncate(head, 100))
    old, new = (F.concat(F.lit('"'), T.smart_truncate(F.coalesce(F.try_variant_get(value, f"$.{k}", "string"), F.lit("")), 60), F.lit('"')) for k in ("old_string", "new_string"))
    edited = F.concat(F.lit("Edit "), tail("", file, ": "), old, F.lit(" → "), new)
    sought = F.array_join(F.array_compact(F.array(*(F.concat(F.lit(k), v) for k, v in (("pattern=", field("pattern")), ("in=", path("path")), ("glob=", field("glob")))))), " ")
    fields = F.map_entries(F.from_json(input_json, "map<string,string>"))  # in the order of the text
    texts = F.filter(fields, lambda e: F.schema_of_variant(F.try_variant_get(value, F.concat(F.lit("$['"), e["key"], F.lit("']")), "variant")) == "STRING")
    first = F.get(texts, F.lit(0))
    return (
        F.when(name.isin("Read", "NotebookRead"), F.coalesce(F.concat(F.lit("Read "), file), name))
        .when(name == "Write", F.coalesce(wrote, name))
        .when(name.isin("Edit", "NotebookEdit"), edited)
        .when(name == "Bash", F.when(field("command").isNotNull(), F.concat(F.lit("Bash: "), field("command"), tail(" (", field("description"), ")"))).otherwise("Bash"))
        .when(name == "Grep", F.concat(F.lit("Grep "), F.when(sought == "", "(no-args)").otherwise(sought)))
        .when(name == "Glob", lead("Glob ", tail("", field("pattern")), tail(" in ", path("path"))))
        .when(name.isin("WebFetch", "WebSearch"), lead(name, F.lit(" "), tail("", F.coalesce(field("url"), field("query")))))
        .when(name.isin("Agent", "Task"), lead(name, F.lit(": "), tail("", F.coalesce(field("description"), field("subject")))))
        .when(name == "Skill", lead("Skill: ", tail("", field("skill")), tail(" (", field("args"), ")")))
        .otherwise(F.when(first.isNull(), name).otherwise(F.concat(name, F.lit(" "), first["key"], F.lit("="), T.smart_truncate(first["value"], most))))
    )


def summary(calls: DataFrame, root: Column | str = "", home: str = "") -> DataFrame:
    """``session_id, tools``: the lines of ``calls (session_id, idx, tool_idx, name, input)`` in order, one a row of text."""
    line = F.struct("idx", "tool_idx", F.concat(F.lit("- "), tool_line(F.col("name"), F.col("input"), root, home)).alias("line"))
    lines = calls.groupBy("session_id").agg(F.array_sort(F.collect_list(line)).alias("l"))
    return lines.select("session_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("tools"))
