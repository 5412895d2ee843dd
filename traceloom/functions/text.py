"""Scalar text functions, ``Column -> Column``, native but for ``clean_intent``. Lengths are code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

CONTROLS = r"[\x00-\x1f\x7f-\x9f]"
SPACE = r"[\s ﻿  -     　]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def terminal_safe(c: Column) -> Column:
    """Without control characters."""
    return F.regexp_replace(c, CONTROLS, "")


def frontmatter_value(c: Column) -> Column:
    """One line: controls become spaces, runs of white space one space, ends trimmed."""
    return trim(F.regexp_replace(F.regexp_replace(c, CONTROLS, " "), f"{SPACE}+", " "))


def kebab_chars(c: Column) -> Column:
    """The first 256 characters in lower case, with dashes between runs of ``[a-z0-9]``."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.substring(c, 1, 256)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_kebab(c: Column) -> Column:
    return c.rlike("^[a-z][a-z0-9]*(-[a-z0-9]+)*$") & (F.length(c) <= 64)


def kebab_name(c: Column, fallback: str) -> Column:
    """A kebab-case name, or ``fallback`` where there is none of at most 64 characters."""
    k = kebab_chars(c)
    return F.when(is_kebab(k), k).otherwise(fallback)


def file_name(c: Column, fallback: str) -> Column:
    """Safe base name of a file: other characters become dashes, at most 100, no leading dots or dashes."""
    s = F.regexp_replace(F.substring(F.regexp_replace(c, "[^A-Za-z0-9_-]", "-"), 1, 100), r"^[-.]+", "")
    return F.when(s == "", fallback).otherwise(s)


def tag(c: Column) -> Column:
    return F.regexp_replace(F.lower(trim(c)), r"[\s_]+", "-")


def titleize(c: Column) -> Column:
    """Words of a kebab name with capitals."""
    return F.array_join(F.transform(F.split(c, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def smart_truncate(c: Column, most: int) -> Column:
    """At most ``most`` characters and an ellipsis, cut at a separator past 60 % if there is one."""
    head = F.substring(c, 1, most)
    # place of the last separator, counted from 0
    cut = F.length(F.regexp_extract(head, r"(?s)^(.*)[ \n;,)]", 1))
    cut = F.when(head.rlike(r"[ \n;,)]"), cut).otherwise(-1)
    at = F.when(cut > most * 0.6, cut).otherwise(most)
    short = F.concat(F.regexp_replace(F.substring(c, F.lit(1), at), f"{SPACE}+$", ""), F.lit("…"))
    return F.when(F.length(c) <= most, c).otherwise(short)


def md_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def truncate_document(c: Column, most: int = 102_400) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("\n... [TRUNCATED]"))).otherwise(c)


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def file_base_name(c: Column) -> Column:
    """The last part of a path, whatever slashes end it; empty for the root."""
    return F.regexp_extract(c, "([^/]*)/*$", 1)


def path_parts(c: Column) -> Column:
    """Parts of an absolute path without ``.`` and empty ones; ``..`` takes the part before it away."""
    start = F.array().cast("array<string>")
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", up(acc)).otherwise(F.array_append(acc, x))
    return F.aggregate(F.split(c, "/"), start, step)


def is_inside(path: Column, folder: Column) -> Column:
    """Whether an absolute path is the folder or lies in it."""
    parts = path_parts(folder)
    return F.slice(path_parts(path), 1, F.size(parts)) == parts


def is_newer(latest: Column, current: Column) -> Column:
    """Whether one version is above the other by its three numbers; false where either has none."""
    def numbers(c: Column) -> Column:
        found = [F.regexp_extract(c, r"^(\d+)\.(\d+)\.(\d+)", i).cast("decimal(38,0)") for i in (1, 2, 3)]
        return F.when(c.rlike(r"^\d+\.\d+\.\d+"), F.struct(*(x.alias(f"v{i}") for i, x in enumerate(found))))

    return F.coalesce(numbers(latest) > numbers(current), F.lit(False))


def percent_change(a: Column, b: Column) -> Column:
    """Rounded change from a to b with its sign; from 0 there is none."""
    pct = F.floor((b - a) / F.nullif(a, F.lit(0)) * 100 + 0.5).cast("long")
    return F.when(a == 0, F.when(b == 0, "—").otherwise("+∞")).otherwise(F.concat(F.when(pct >= 0, "+").otherwise(""), pct.cast("string"), F.lit("%")))


def project_slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(base_name(c)), "[^a-z0-9]+", "-")


def short_path(c: Column, home: str) -> Column:
    """A path under ``home`` with ``~`` for it."""
    return F.when(c.startswith(home), F.concat(F.lit("~"), F.substring(c, len(home) + 1, 1 << 30))).otherwise(c)


def strip_comments(c: Column) -> Column:
    """Without comment blocks, one pass."""
    return F.regexp_replace(c, r"(?s)<!--.*?--!?>", "")


def strip_directional(c: Column) -> Column:
    return F.regexp_replace(c, "[‪-‮⁦-⁩]", "")


def flatten_fences(c: Column) -> Column:
    """Lines that begin with four or more backticks begin with three."""
    return F.regexp_replace(c, "(?m)^`{4,}", "```")


def contains_ci(c: Column, part: str) -> Column:
    return F.contains(F.lower(c), F.lit(part.lower()))


_TAGS = ("local-command-caveat", "local-command-stdout", "command-name", "command-message", "command-args", "system-reminder", "user-prompt-submit-hook")


def strip_boilerplate(c: Column) -> Column:
    """Without the blocks that commands, hooks and reminders put into a message, ends trimmed."""
    for tag in _TAGS:
        c = F.regexp_replace(c, f"(?s)<{tag}>.*?</{tag}>", "")
    return trim(c)


def one_line(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"{SPACE}+", " "))


def short_message(c: Column, most: int = 300) -> Column:
    """A message without boilerplate on one line, cut with an ellipsis."""
    line = one_line(strip_boilerplate(c))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def without_markup(s: str) -> str:
    """Comments, then lone delimiters of comments, then tags go, each until none is left."""
    for pattern in (r"<!--[\s\S]*?--!?>", r"<!--|--!?>", r"<[^>]*>"):
        n = 1
        while n:
            s, n = re.subn(pattern, "", s)
    return s


def clean_intent(c: Column) -> Column:
    """``without_markup`` on one line."""
    run = pandas_udf(lambda v: v.map(without_markup, na_action="ignore"), "string")
    return one_line(run(c))


_CODE = "ts|tsx|js|jsx|py|go|rs|sql|sh|rb|java|kt|swift|c|cpp|h"


def has_code_file(files: Column, config: bool = False) -> Column:
    """Whether one of the paths is of code; of code or ``config``."""
    ends = rf"\.({_CODE}{'|yaml|yml|json|toml' if config else ''})\z"
    return F.exists(files, lambda f: F.lower(f).rlike(ends))


def slash_only(c: Column) -> Column:
    """Whether a message says next to nothing besides its boilerplate."""
    return F.length(strip_boilerplate(c)) < 20
