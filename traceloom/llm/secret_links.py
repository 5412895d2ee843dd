r"""Secret scans with multipart credential linking (operator 4), DataFrame functions only.

Base findings are spans of one text: ``assign`` (a secret's name, a separator, a value),
``access`` (an access identifier) and ``hex`` (a long hexadecimal run). On their own,
other credential parts are too weak to report: a short user or client identifier, an
endpoint, or a random-looking value that no name announces. Parts that complement each
other are joined when their intervals lie within one scope, ``SCOPE`` code points:

====================  ============================================================
``id``                ``user|login|account|client_id|key_id`` ``= value``
``endpoint``          ``scheme://host`` or ``host|endpoint|server|url = value``
``value``             20 or more of ``[A-Za-z0-9+/_-]`` with a lower-case letter, an
                      upper-case letter and a digit
====================  ============================================================

A weak candidate is reported only where complementary parts co-occur in its scope: a
``value`` with an identifier (``id`` or ``access``); an ``id`` with a secret (``assign``,
``hex`` or a ``value``); an ``endpoint`` with both an identifier and a secret. Parts that
overlap each other are the same thing, and don't complement each other.

Positions come from ``split`` and ``regexp_extract_all`` by one regex: the lengths of the
pieces and of the matches between them add up to spans. Intervals are joined by bins of
one scope's length, so that a bin and its neighbours hold few parts, however long the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read

#: Code points between parts of one credential, at most.
SCOPE = 200

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a minimum length in the pattern drops the same matches as a later test.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
IDENT = r"""(?<![A-Za-z0-9_])(?i:user(?:name|_id)?|login|account(?:_id)?|client_id|(?:access_)?key_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)"""
ENDPOINT = r"""(?<![A-Za-z0-9_])(?:[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._:-]+|(?i:host(?:name)?|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"""
VALUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}"

#: Matches of one kind in a text that are placed together.
BLOCK = 128
#: Order among spans with one start.
KINDS = ("assign", "access", "hex", "id", "endpoint", "value")
BASE = KINDS[:3]


def spans(text: Column, pattern: str, kind: str, group: int = 0, at_least: int = 0) -> Column:
    """Spans ``(s, e, k)`` of leftmost non-overlapping matches whose ``group`` has ``at_least`` code points."""
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(F.transform(gaps, F.length).alias("g"), F.transform(hit, F.length).alias("m"), F.transform(value, F.length).alias("v"))
    kinds = F.lit(KINDS.index(kind))
    long = lambda x: x["g"] + F.coalesce(x["m"], F.lit(0))
    # blocks of BLOCK matches, and the place where each begins: an append copies no more than a block
    blocks = F.transform(F.sequence(F.lit(0), F.size(rows) - 1, F.lit(BLOCK)), lambda i: F.slice(rows, i + 1, F.lit(BLOCK)))
    begins = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, F.aggregate(b, F.element_at(acc, -1), lambda at, x: at + long(x))))
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<struct<s:int,e:int,k:int>>").alias("out"))

    def step(acc, x):
        s, e = acc["at"] + x["g"], acc["at"] + long(x)
        one = F.struct(s.alias("s"), e.alias("e"), kinds.alias("k"))
        kept = F.when(F.coalesce(x["v"], F.lit(-1)) >= at_least, F.array_append(acc["out"], one)).otherwise(acc["out"])
        return F.struct(e.alias("at"), kept.alias("out"))

    found = F.flatten(F.transform(blocks, lambda b, i: F.aggregate(b, start(F.get(begins, i)), step, lambda acc: acc["out"])))
    none = F.array().cast("array<struct<s:int,e:int,k:int>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row, doc_id, parts``: all spans of each input row, base and weak. Null text is empty."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    parts = F.concat(
        spans(text, ASSIGN, "assign", 2, 8), spans(text, ACCESS, "access"), spans(text, HEX, "hex"),
        spans(text, IDENT, "id", 1, 3), spans(text, ENDPOINT, "endpoint"), spans(text, VALUE, "value"),
    )
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    return rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", parts.alias("parts"))


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``_row, p``: weak parts with complements within ``scope``; from ``find_parts`` written out."""
    some = parts.where(F.exists("parts", lambda p: p["k"] >= len(BASE)) & (F.size("parts") > 1))
    each = some.select("_row", F.explode("parts").alias("p"))
    k = F.col("p.k")
    weak = each.where(k >= len(BASE)).withColumn("bin", F.floor(F.col("p.s") / scope))
    # a part stands in the bins of its ends' scopes; two intervals are near only if they meet in the weak part's bin
    wide = each.select("_row", F.col("p").alias("q"), F.explode(F.sequence(F.floor((F.col("p.s") - scope) / scope), F.floor((F.col("p.e") + scope) / scope))).alias("bin"))
    wide = wide.select("_row", "bin", "q", F.col("q.k").isin(1, 3).alias("ident"), F.col("q.k").isin(0, 2, 5).alias("secret")).where("ident or secret")
    apart = (F.col("q.s") >= F.col("p.e")) | (F.col("q.e") <= F.col("p.s"))
    near = (F.col("q.s") < F.col("p.e") + scope) & (F.col("q.e") + scope > F.col("p.s"))
    # a long part's own bin is its start's, so near parts behind it are looked for from each bin that it covers
    spread = weak.select("_row", "p", F.explode(F.sequence(F.floor(F.col("p.s") / scope), F.floor(F.col("p.e") / scope))).alias("bin"))
    met = spread.join(wide, ["_row", "bin"]).where(apart & near)
    by = met.groupBy("_row", "p").agg(F.max("ident").alias("ident"), F.max("secret").alias("secret"))
    k = F.col("p.k")
    return by.where(((k == 5) & F.col("ident")) | ((k == 3) & F.col("secret")) | ((k == 4) & F.col("ident") & F.col("secret"))).select("_row", "p")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: ``_row, doc_id, spans`` with ``spans array<struct<kind,start,end>>`` by start, then kind.

    Null text and text without findings give an empty array; repeated rows and null ids
    give a row each (rows are told apart by ``_row``); other columns are not read.
    """
    parts = materialize(find_parts(docs, id_col, text_col), "secret-parts")
    linked = link(parts, scope).groupBy("_row").agg(F.collect_list("p").alias("weak"))
    # the join is on rows with weak links only: few, and never the texts
    both = parts.join(linked, "_row", "left")
    base = F.filter("parts", lambda p: p["k"] < len(BASE))
    none = F.array().cast("array<struct<s:int,e:int,k:int>>")
    named = F.array(*(F.lit(x) for x in KINDS))
    every = F.array_sort(F.transform(F.concat(base, F.coalesce("weak", none)), lambda p: F.struct(p["s"].alias("s"), p["k"].alias("k"), p["e"].alias("e"))))
    out = F.transform(every, lambda p: F.struct(F.get(named, p["k"]).alias("kind"), p["s"].alias("start"), p["e"].alias("end")))
    return both.select("_row", "doc_id", out.alias("spans"))


def joined(col: Column) -> Column:
    return F.array_join(F.transform(col, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")


def redact(docs: DataFrame, *, text_col: str = "text", scope: int = SCOPE, marker: str = "[REDACTED:{}]") -> DataFrame:
    """``docs`` with each reported span of the text replaced by a marker naming its kind.

    Overlapping spans become one marker, of the first. Texts without findings, and null
    texts, stay as they are; all columns stay.
    """
    held = materialize(docs.select(F.monotonically_increasing_id().alias("_row_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_d")), "secret-docs")
    found = scan(held.select("_row_id", F.col("_d").getField(text_col).alias("_t")), id_col="_row_id", text_col="_t", scope=scope)
    found = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("_row_id"), "spans")
    both = held.join(found, "_row_id", "left")
    text = F.col("_d").getField(text_col)
    # spans by start, those that begin within an earlier one left out: where each begins and the text before it
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,s:int,kind:string>>").alias("out"))

    def step(acc, x):
        one = F.struct(acc["at"].alias("a"), x["start"].alias("s"), x["kind"].alias("kind"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.array_append(acc["out"], one)).alias("out"))

    both = both.withColumn("_m", F.aggregate("spans", start, step))
    before, after = marker.split("{}")
    pieces = F.transform("_m.out", lambda x: F.concat(F.substring(text, x["a"] + 1, x["s"] - x["a"]), F.lit(before), x["kind"], F.lit(after)))
    new = F.concat(F.array_join(pieces, ""), F.substring(text, F.col("_m.at") + 1, F.length(text)))
    clean = F.when(F.col("spans").isNull(), text).otherwise(new)
    return both.select(*(clean.alias(c) if c == text_col else F.col("_d").getField(c).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """Digests of the base spans and all spans of every whole text, with the number of each kind."""
    found = scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda p: p["kind"].isin(*BASE))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        count("id"), count("endpoint"), count("value"),
    )
