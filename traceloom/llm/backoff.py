"""Stupid-backoff language model scores, computed relationally (operator 5).

Counts of all n-grams up to ``order`` are gathered over the whole corpus; an n-gram of
two or more words counts as seen if the corpus has it at least ``min_count`` times. A
word's score is the relative frequency of the longest seen n-gram that ends in it, times
``alpha`` for each step down from the longest that its position allows; the first words
of a text have shorter histories, at no discount. A document's score is the sum of logs.
``min_count`` is 2: the scored documents are the corpus, so from 1 on each n-gram of
theirs would be seen, and no score would ever back off.

Relations, with n-grams as 64-bit hashes:

* batches: runs of whole documents of about ``BATCH_CHARS``, written once, compressed;
* exploded n-grams: for each order, the distinct n-grams and their counts in each batch,
  those of one hash partition packed in a row. So a third of all words being one word
  makes one entry a batch, and there are never more rows than entries;
* count tables: one group a hash partition, which sums the counts of its n-grams;
* joined back to the exploded n-grams of each batch: which of its n-grams are seen, and how
  often in all; with the batch's texts these are summed per document.

Orders go one after another, so that only one order's exploded n-grams are on disk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, planes, read, shuffle_partitions, slices, unplanes
from .hashing import chunks, hash_chunk, mix

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
BATCH_CHARS = 4_000_000
#: Characters of text for each hash partition, at most.
PARTITION_CHARS = 8_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts (A-Z in lower case), and each text's number of words."""
    parts = [hash_chunk(held) for _, _, held in chunks(texts, lower=True)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def grams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each word, and which words have n - 1 words before them in their text."""
    if n == 1:
        return hashes, np.ones(len(hashes), bool)
    out = np.zeros(len(hashes), np.uint64)
    for i in range(n):
        out[n - 1 :] += hashes[i : len(hashes) - n + 1 + i] * _ODD[i]
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    return mix(out + np.uint64(n)), np.arange(len(hashes)) - starts >= n - 1


def _place(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def _distinct(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes by partition and value, counts, where each partition starts, and each input's entry."""
    value, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    place = _place(value, parts)
    order = np.argsort(place, kind="stable")
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    cuts = np.searchsorted(place[order], np.arange(parts + 1))
    return value[order], count[order], cuts, at[inverse]


def _batches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``batch, texts``: compressed streams of record batches ``id, text``."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, size, held = TaskContext.get().partitionId(), 0, 0, []

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                for batch in held:
                    to.write_batch(batch)
            return pa.RecordBatch.from_arrays([pa.array([task << 33 | n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "texts"])

        for batch in slices(stream, 64):
            batch = batch.cast(schema)
            if held and size + batch.nbytes > BATCH_CHARS:
                yield out()
                n, size, held = n + 1, 0, []
            held.append(batch)
            size += batch.nbytes
        if held:
            yield out()

    return materialize(rows.mapInArrow(run, "batch long, texts binary"), "lm-batches")


def _words_of(texts: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """The ids of a batch, the word hashes of all its texts, and each text's number of words."""
    ids, parts = [], []
    for batch in pa.ipc.open_stream(texts):
        ids += batch.column(0).to_pylist()
        parts.append(words(batch.column(1).to_pylist()))
    return ids, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _exploded(n: int, parts: int):
    """Rows ``p, batch, grams, counts``: the distinct n-grams of a batch in a hash partition, by their steps from one to the next."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for i in range(b.num_rows):
                _, hashes, counts = _words_of(b.column(1)[i].as_py())
                h, ok = grams(hashes, counts, n)
                value, count, cuts, _ = _distinct(h[ok], parts)
                full = np.flatnonzero(np.diff(cuts))
                count = count.astype(np.uint32)
                for some in np.array_split(full, -(-len(full) // 64)) if len(full) else ():
                    yield pa.RecordBatch.from_arrays([
                        pa.array(some.astype(np.int32)), pa.array(np.full(len(some), b.column(0)[i].as_py(), np.int64)),
                        pa.array([planes(np.diff(value[cuts[p] : cuts[p + 1]], prepend=np.uint64(0))) for p in some], pa.binary()),
                        pa.array([planes(count[cuts[p] : cuts[p + 1]]) for p in some], pa.binary()),
                    ], names=["p", "batch", "grams", "counts"])

    return run


def _counted(n: int, least: int):
    """For each batch of a hash partition: which of its n-grams are seen, and the counts of those in all batches."""
    def run(table: pa.Table) -> pa.Table:
        raw = [np.cumsum(unplanes(b.as_py(), np.uint64)) for b in table.column("grams")]
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        value, inverse = np.unique(np.concatenate(raw), return_inverse=True)
        del raw
        own = np.concatenate([unplanes(b.as_py(), np.uint32) for b in table.column("counts")])
        total = np.bincount(inverse, own, len(value)).astype(np.int64)[inverse]
        seen = [total[a:b] >= least for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table({
            "p": table.column("p"), "batch": table.column("batch"), "n": pa.array(np.full(table.num_rows, n, np.int32)), "seen": pa.array([np.packbits(x).tobytes() for x in seen], pa.binary()),
            "totals": pa.array([planes(total[a:b][x]) for a, b, x in zip(cuts, cuts[1:], seen, strict=False)], pa.binary()),
        })

    return run


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """``doc_id, n_words, log_score, per_word`` of each input row, against counts of the whole table.

    Null and wordless texts: 0 words, 0 and a null mean. Repeated rows and null ids are
    rows like others, and count like others. Other columns are not read; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(F.col(f"`{text_col}`")))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-chars // PARTITION_CHARS))
    batches = _batches(docs, id_col, text_col)
    tables = []
    for n in range(1, order + 1):
        exploded = batches.mapInArrow(_exploded(n, parts), "p int, batch long, grams binary, counts binary")
        counted = exploded.groupBy("p").applyInArrow(_counted(n, min_count if n > 1 else 1), "p int, batch long, n int, seen binary, totals binary")
        tables.append(materialize(counted, "lm-counts"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, hashes, counts = _words_of(left.column("texts")[0].as_py())
        rows = {(n, p): i for i, (n, p) in enumerate(zip(right.column("n").to_pylist(), right.column("p").to_pylist(), strict=True))}
        where = np.repeat(np.arange(len(ids)), counts)
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
        most = np.minimum(place + 1, order)
        logs = np.zeros(len(hashes))
        from_total = np.ones(len(hashes), bool)  # scored by order 1, whose denominator is the size of the corpus
        below = None
        for n in range(1, order + 1):
            h, ok = grams(hashes, counts, n)
            value, _, cuts, at = _distinct(h[ok], parts)
            seen_count = np.zeros(len(value), np.int64)
            for p in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[p], cuts[p + 1]
                i = rows[n, int(p)]
                seen = np.unpackbits(np.frombuffer(right.column("seen")[i].as_py(), np.uint8), count=b - a).astype(bool)
                seen_count[a:b][seen] = unplanes(right.column("totals")[i].as_py(), np.int64)
            c = np.zeros(len(hashes), np.int64)
            c[ok] = seen_count[at]
            step = np.log(alpha) * (most - n)
            if n == 1:
                logs = np.log(np.maximum(c, 1)) + step
            else:
                history = np.concatenate([[0], below[:-1]])
                good = (c > 0) & (history > 0)
                logs[good] = np.log(c[good] / history[good]) + step[good]
                from_total[good] = False
            below = c
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(counts, pa.int64()), "uni": pa.array(np.bincount(where, from_total, len(ids)).astype(np.int64)),
            "log_score": pa.array(np.bincount(where, logs, len(ids)).astype(np.float64)),
        })

    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    summed = batches.groupBy("batch").cogroup(every.groupBy("batch")).applyInArrow(run, "doc_id long, n_words long, uni long, log_score double")
    summed = materialize(summed, "lm-scores")
    discard(batches, *tables)
    total = summed.agg(F.sum("n_words")).first()[0] or 0
    log = F.col("log_score") - F.col("uni") * F.lit(math.log(total) if total else 0.0)
    return summed.select("doc_id", "n_words", log.alias("log_score"), F.when(F.col("n_words") > 0, log / F.col("n_words")).alias("per_word"))


def query(spark, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, log_score, per_word`` of every document against the counts of all."""
    out = score(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("per_word", 6).alias("per_word"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE len(ws) > 0),
g AS (SELECT doc_id, i, w AS c, lag(w, 1) OVER p AS b, lag(w, 2) OVER p AS a FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
n1 AS (SELECT c, count(*) AS k FROM g GROUP BY 1),
n2 AS (SELECT b, c, count(*) AS k FROM g WHERE b IS NOT NULL GROUP BY 1, 2),
n3 AS (SELECT a, b, c, count(*) AS k FROM g WHERE a IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT g.doc_id, CASE
    WHEN n3.k >= 2 THEN ln(n3.k::DOUBLE / h2.k)
    WHEN n2.k >= 2 THEN ln(n2.k::DOUBLE / h1.k) + ln(0.4) * (least(g.i, 3) - 2)
    ELSE ln(n1.k::DOUBLE / (SELECT count(*) FROM g)) + ln(0.4) * (least(g.i, 3) - 1) END AS x
  FROM g JOIN n1 ON n1.c = g.c LEFT JOIN n2 ON n2.b = g.b AND n2.c = g.c LEFT JOIN n3 ON n3.a = g.a AND n3.b = g.b AND n3.c = g.c
  LEFT JOIN n1 h1 ON h1.c = g.b LEFT JOIN n2 h2 ON h2.b = g.a AND h2.c = g.b),
t AS (SELECT doc_id, count(*) AS n, sum(x) AS x FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(t.n, 0)::BIGINT AS n_words, round(coalesce(t.x, 0.0), 4) AS log_score, round(t.x / t.n, 6) AS per_word
FROM d LEFT JOIN t USING (doc_id)
"""
