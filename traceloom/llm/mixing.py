"""Mixing sources to target weights by systematic sampling (operator 8).

Every source gets a target share of all words. Within a source each document has the
same expected number of copies, target / size of the source, at most ``max_copies``.
The running sum of expected copies plus one random offset crosses an integer once for
each copy that is emitted. Documents stand in the running sum from the largest to the
smallest, so what the mix takes of a source differs from its target by less than its
largest document.

No window ever holds a source: positions come from counts of (source, size, bucket)
cells, a running sum over a source's distinct sizes, one over a size's cells
of hashes, and a row number within one cell. Documents of one size are ordered by a hash of
id and text, so that reruns agree; rows with the same id and text are one document's copies,
and any of them may be taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, read

#: Documents of one source and size are dealt by the first so many hexadecimal digits of their hashes, to 4096 cells.
BUCKET_DIGITS = 3
#: Sources whose rates may be broadcast; beyond, the join is shuffled.
BROADCAST_SOURCES = 100_000
#: Sources, by code point with null last, weigh 1, 2, 3, repeating.
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], max_copies: float) -> list[float]:
    """Targets that share sum(sizes) by weight, none above ``max_copies`` times its size.

    The excess of those above is shared by weight among the others, until none is above.
    Sources of size 0 get 0. Works on one number a source, never on documents.
    """
    targets = [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n > 0]
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > max_copies * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = float(max_copies * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return targets


def _order(doc_id: Column, text: Column, seed: int) -> Column:
    """The place of a document among those of its source and size, in hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{int(seed)}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")))))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], max_copies: float, seed: int, carry: list[str]) -> DataFrame:
    spark = docs.sparkSession
    source = F.col(f"`{source_col}`")
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("_s"), word_count(F.col(f"`{text_col}`")).alias("size"),
        _order(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed).alias("_h"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)),
    )
    base = materialize(base.withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS)), "mix-sizes")
    cells = materialize(base.groupBy("_s", "size", "_b").agg(F.count("*").alias("_n")), "mix-cells")
    by_size = cells.groupBy("_s", "size").agg(F.sum("_n").alias("_n"))
    # one row a source: the list of sources, not of documents, comes to the driver
    totals = by_size.groupBy("_s").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")).collect()
    totals = sorted(totals, key=lambda r: (r[0] == "n", r[0].encode("utf-8", "surrogatepass")))
    targets = water_fill([r[1] for r in totals], [float(weights[i % len(weights)]) for i in range(len(totals))], max_copies)
    rows = [(r[0], int(r[1]), t, t / r[1] if r[1] else 0.0) for r, t in zip(totals, targets, strict=True)]
    rates = spark.createDataFrame(rows, "_s string, source_size long, target double, _rate double")

    larger = Window.partitionBy("_s").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    sizes_at = by_size.select("_s", "size", F.coalesce(F.sum("_n").over(larger), F.lit(0)).alias("_above"))
    earlier = Window.partitionBy("_s", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells_at = cells.select("_s", "size", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_within"))
    cells_at = cells_at.join(sizes_at, ["_s", "size"]).select("_s", "size", "_b", (F.col("_above") + F.col("_within")).alias("_from"))
    inside = Window.partitionBy("_s", "size", "_b").orderBy("_h", "doc_id")
    placed = base.withColumn("_r", F.row_number().over(inside)).join(cells_at, ["_s", "size", "_b"]).join(F.broadcast(rates) if len(rows) <= BROADCAST_SOURCES else rates, "_s")
    # one offset in [0, 1) a source, the same at every run
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{int(seed)}|"), F.col("_s"))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    k = F.col("_from") + F.col("_r")
    crossed = F.floor(k * F.col("_rate") + offset) - F.floor((k - 1) * F.col("_rate") + offset)
    return placed.withColumn("copies", F.when(F.col("size") > 0, F.least(crossed, F.lit(int(max_copies)))).otherwise(0).cast("long"))


def plan_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[float, ...] = WEIGHTS, max_copies: float = 3.0, seed: int = 17) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, copies, taken``.

    Null text or text without words has size 0 and is never taken. A null source is a
    source of its own, the last. Repeated rows are rows like others; ties of size are
    ordered by a hash of id and text. Other columns are not read, whatever their names.
    An empty table gives an empty result.
    """
    out = _plan(docs, id_col, text_col, source_col, weights, max_copies, seed, [])
    source = F.when(F.col("_s") != "n", F.substring("_s", 2, 2**31 - 1))
    return out.select("doc_id", source.alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, max_copies: float = 3.0, seed: int = 17) -> DataFrame:
    """The mixed documents themselves: every input row, with all its columns, as often as the plan says."""
    cols = docs.columns
    out = _plan(docs, id_col, text_col, source_col, weights, max_copies, seed, cols).where("copies > 0")
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def query(spark, sf_dir: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every document."""
    return plan_copies(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS s,
  md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT s, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY s = 'n', s) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY s),
f AS (SELECT 0 AS i, s, source_size, w, source_size = 0 AS closed, 0.0::DOUBLE AS target FROM t UNION ALL
  SELECT i + 1, s, source_size, w, closed OR share > 3.0 * source_size, CASE WHEN closed THEN target WHEN share > 3.0 * source_size THEN 3.0 * source_size ELSE share END FROM (
    SELECT *, CASE WHEN closed THEN 0 ELSE (sum(source_size) OVER () - sum(CASE WHEN closed THEN target ELSE 0 END) OVER ())::DOUBLE * w / sum(CASE WHEN closed THEN 0 ELSE w END) OVER () END AS share FROM f WHERE i < (SELECT count(*) FROM t))),
g AS (SELECT s, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, ('0x' || substr(md5('17|' || s), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS start FROM f WHERE i = (SELECT count(*) FROM t)),
k AS (SELECT doc_id, s, size, row_number() OVER (PARTITION BY s ORDER BY size DESC, h, doc_id) AS k FROM d),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN least(floor(k * rate + start) - floor((k - 1) * rate + start), 3) ELSE 0 END::BIGINT AS copies FROM k JOIN g USING (s))
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
