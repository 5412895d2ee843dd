"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 2).

P(grade <= k) = sigmoid(threshold_k - s) with one score s for all grades: shared weights
over hashed lower-case words and their beginnings, plus hashed tokens for the shape of
the text (share of capitals, marks, digits, repeated words, ...). Thresholds are ordered
by construction. The score gives the expected grade, and the tail probability
P(grade >= top) selects documents.

The fit takes a bounded sample, ``SAMPLE_ROWS`` rated rows in expectation, by a hash of
the id; the weights are ``1 << BITS`` numbers, so what is broadcast is bounded. Scoring
covers every row and its whole text, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, release, slices
from .hashing import chunks, hash_chunk, mix

SAMPLE_ROWS = 12_000
BITS = 18
EPOCHS = 12
#: Documents whose P(grade >= the best grade) is at least this are kept.
KEEP = 0.7
_SHAPES = 8
#: Besides whole words, their first so many bytes are hashed: related words share weights.
PREFIXES = (4, 5)
#: Lower-cases A-Z and takes ASCII marks for spaces, so that a word is one word before any mark.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not (48 <= c <= 57 or 97 <= c <= 122) else c for c in range(256))


def _shape_tokens(data: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """One hashed token a text for each measure of its shape, in steps."""
    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        size = np.maximum(np.diff(bounds), 1)
        return np.diff(total[bounds]) / size

    letters = (data >= 65) & (data <= 90)
    small = (data >= 97) & (data <= 122) | (data >= 128)
    digits = (data >= 48) & (data <= 57)
    space = (data == 32) | (data >= 9) & (data <= 13)
    marks = ~(letters | small | digits | space)
    upto = np.concatenate([[0], np.cumsum(counts)])
    same = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 1:
        np.cumsum(hashes[1:] == hashes[:-1], out=same[1:-1])
        same[-1] = same[-2]
    first = np.minimum(upto[:-1], len(hashes))
    last = np.maximum(upto[1:] - 1, first)
    again = (same[last] - same[first]) / np.maximum(counts, 1)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(upto, upto[1:])]) / np.maximum(counts, 1)
    steps = [share(letters), share(marks), share(digits), share(space), again]
    out = [np.minimum((np.sqrt(x) * 12).astype(np.uint64), 11) for x in steps]
    size = np.log2(counts + 1).astype(np.uint64)
    out.append(np.minimum((distinct * 10).astype(np.uint64), 10) + np.uint64(16) * (size // 2))
    out.append(size)
    out.append(np.zeros(len(counts), np.uint64))
    return [mix(np.uint64((0xABCD00 + i) * 0x9E3779B97F4A7C15 % 2**64) + x) for i, x in enumerate(out)]


def features(texts: Sequence[str | None], bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs ``(from, to, text number, bucket, value)`` of the sparse rows of texts; null is empty."""
    mask = np.uint64((1 << bits) - 1)
    for a, b, held in chunks(texts, lower=False):
        low, counts, *starts = hash_chunk([x.translate(_PLAIN) for x in held], PREFIXES)
        rows = np.tile(np.repeat(np.arange(b - a), counts), 1 + len(starts))
        data = np.frombuffer(b"".join(held), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))])
        shapes = _shape_tokens(data, bounds, low, counts)
        bucket = np.concatenate([low, *starts]) & mask
        keys, times = np.unique(rows.astype(np.uint64) << np.uint64(bits) | bucket, return_counts=True)
        row, bucket = (keys >> np.uint64(bits)).astype(np.int64), (keys & mask).astype(np.int64)
        sizes = np.bincount(row, minlength=b - a)
        value = (1.0 + np.log(times)) / np.maximum(sizes, 1)[row] ** 0.25
        every = np.arange(b - a)
        yield (a, b, np.concatenate([row, *[every] * _SHAPES]), np.concatenate([bucket, *((x & mask).astype(np.int64) for x in shapes)]),
               np.concatenate([value, *[np.ones(b - a)] * _SHAPES]))


class CumulativeLink:
    """Weights and ordered thresholds over sparse rows."""

    def __init__(self, grades: Sequence[float], bits: int = BITS):
        self.grades = np.array(sorted(grades), float)
        self.w = np.zeros(1 << bits)
        self.theta = np.linspace(-1, 1, max(len(self.grades) - 1, 0)) if len(self.grades) > 2 else np.zeros(max(len(self.grades) - 1, 0))

    def cumulative(self, s: np.ndarray) -> np.ndarray:
        """P(grade <= k) for all k but the last, a row each."""
        return 1 / (1 + np.exp(-np.clip(self.theta[None, :] - s[:, None], -30, 30)))

    def fit(self, start: np.ndarray, bucket: np.ndarray, value: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 1.0, l2: float = 0.0) -> CumulativeLink:
        """Adagrad on minus the log likelihood; ``y`` are places in ``grades``, rows start at ``start``."""
        n, rng = len(y), np.random.default_rng(7)
        if len(self.grades) < 2 or not n:
            return self
        share = np.cumsum(np.bincount(y, minlength=len(self.grades)))[:-1] / n
        self.theta = np.maximum.accumulate(np.log((share + 1e-4) / (1 - share + 1e-4)) + 1e-3 * np.arange(len(share)))
        g2, t2 = np.full(len(self.w), 1e-2), np.full(len(self.theta), 1e-2)
        ends = np.append(start[1:], len(bucket))
        for epoch in range(epochs):
            for part in np.array_split(rng.permutation(n), max(1, n // 256)):
                lens = ends[part] - start[part]
                at = np.repeat(start[part] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
                row, b, v = np.repeat(np.arange(len(part)), lens), bucket[at], value[at]
                s = np.bincount(row, self.w[b] * v, len(part))
                c = np.hstack([np.zeros((len(part), 1)), self.cumulative(s), np.ones((len(part), 1))])
                k, i = y[part], np.arange(len(part))
                hi, lo = c[i, k + 1], c[i, k]
                ds = (lo + hi - 1) / len(part)  # of the log likelihood
                p = np.maximum(hi - lo, 1e-9)
                seen, inv = np.unique(b, return_inverse=True)
                grad = np.bincount(inv, ds[row] * v, len(seen)) - l2 * self.w[seen]
                g2[seen] += grad * grad
                self.w[seen] += rate / (1 + epoch / 4) * grad / np.sqrt(g2[seen])
                slope = c * (1 - c)
                dt = np.zeros(len(self.grades) + 1)
                np.add.at(dt, k + 1, slope[i, k + 1] / p / len(part))
                np.add.at(dt, k, -slope[i, k] / p / len(part))
                dt = dt[1:-1]
                t2 += dt * dt
                self.theta = np.maximum.accumulate(self.theta + 0.05 * dt / np.sqrt(t2) + 1e-9 * np.arange(len(self.theta)))
        return self

    def predict(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and P(grade >= the best)."""
        if len(self.grades) < 2:
            return np.full(len(s), self.grades[0] if len(self.grades) else np.nan), np.ones(len(s))
        c = np.hstack([np.zeros((len(s), 1)), self.cumulative(s), np.ones((len(s), 1))])
        return np.diff(c, axis=1) @ self.grades, 1 - c[:, -2]


def fit(rated: DataFrame, *, text_col: str = "text", grade_col: str = "grade", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, bits: int = BITS) -> CumulativeLink:
    """Fits a bounded sample of rated rows. Null grades are left out; null texts are empty."""
    rows = rated.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{grade_col}`").cast("double").alias("_grade")).where("_grade is not null")
    n = rows.count()
    u = F.pmod(F.xxhash64(F.col("_id"), F.lit("quality")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(u < F.lit(min(1.0, sample_rows / max(n, 1))))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, grades, ids = list(pdf["_text"]), pdf["_grade"].to_numpy(), list(pdf["_id"])
            for a, b, row, bucket, value in features(texts, bits):
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(b - a + 1))
                bucket, value = bucket[order].astype(np.int32), value[order].astype(np.float32)
                yield pd.DataFrame({"id": ids[a:b], "grade": grades[a:b], "b": [bucket[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], "v": [value[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]})

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        # in an order of its own, so that runs agree
        pdf = pdf.iloc[sorted(range(len(pdf)), key=lambda i: (pdf["id"].iloc[i] or "", pdf["b"].iloc[i]))]
        model = CumulativeLink(set(pdf["grade"]), bits)
        place = {g: i for i, g in enumerate(model.grades)}
        y = np.array([place[g] for g in pdf["grade"]], int)
        start = np.cumsum([0, *(len(x) // 4 for x in pdf["b"])])[:-1]
        bucket = np.frombuffer(b"".join(pdf["b"]), np.int32)
        value = np.frombuffer(b"".join(pdf["v"]), np.float32)
        del pdf
        model.fit(start, bucket, value, y)
        del bucket, value, start, y
        release()
        return pd.DataFrame({"w": [model.w.astype(np.float32).tobytes()], "theta": [model.theta.tobytes()], "grades": [model.grades.tobytes()]})

    rows = sample.withColumn("_id", F.col("_id").cast("string")).mapInPandas(sparse, "id string, grade double, b binary, v binary")
    # the sample is bounded, and so one task can fit it; the weights alone come to the driver
    got = rows.groupBy(F.lit("sample").alias("all")).applyInPandas(train, "w binary, theta binary, grades binary").first()
    if got is None:
        return CumulativeLink([], bits)
    model = CumulativeLink(np.frombuffer(got["grades"]), bits)
    model.w, model.theta = np.frombuffer(got["w"], np.float32).copy(), np.frombuffer(got["theta"]).copy()
    return model


def score(docs: DataFrame, model: CumulativeLink, *, text_col: str = "text", keep: Sequence[str] = ("doc_id",), threshold: float = KEEP) -> DataFrame:
    """``keep`` columns with ``expected_grade, p_best double, kept boolean``, one row per input row.

    Null and empty texts are scored by their shape alone. Repeated rows score alike;
    other columns are not read. Without any rated row, grades are null and all are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.w.astype(np.float32), model.theta, model.grades))
    carried = [f"_k{i}" for i in range(len(keep))]
    narrow = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, carried)), F.col(f"`{text_col}`").alias("_text"))
    bits = len(model.w).bit_length() - 1

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, theta, grades = shared.value
        link = CumulativeLink(grades, 1)
        link.theta = theta
        for batch in slices(batches):
            others = batch.select(list(range(batch.num_columns - 1)))
            for a, b, row, bucket, value in features(batch.column(batch.num_columns - 1).to_pylist(), bits):
                s = np.bincount(row, w[bucket] * value, b - a)
                grade, p = link.predict(s)
                part = others.slice(a, b - a)
                columns = [pa.array(grade, pa.float64(), from_pandas=True), pa.array(p), pa.array(p >= threshold)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "expected_grade", "p_best", "kept"])
        release()

    kinds = dict(narrow.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in carried), "expected_grade double, p_best double, kept boolean"])
    out = narrow.mapInArrow(run, schema)
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, carried)), "expected_grade", "p_best", "kept")


def grade(quality: Column, toxic: Column) -> Column:
    """Graded ratings of the labels: 0 poor, 1 sound but toxic, 2 sound and clean; null if either is null."""
    return F.when(quality.isNull() | toxic.isNull(), F.lit(None)).when(quality <= 0, 0).when(toxic > 0, 1).otherwise(2)


def fitted(spark, docs: DataFrame, sf_dir: str) -> CumulativeLink:
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("_l"), grade(F.col("quality"), F.col("toxic")).alias("grade")).where("grade is not null")
    # the sample is drawn from ids before any text is read; what is joined is bounded by it
    n = labels.count()
    u = F.pmod(F.xxhash64(F.col("_l"), F.lit("quality")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = F.broadcast(labels.where(u < F.lit(min(1.0, SAMPLE_ROWS / max(n, 1)))))
    return fit(docs.select("doc_id", "text").join(some, F.col("doc_id") == F.col("_l")), sample_rows=2 * SAMPLE_ROWS)


def query(spark, sf_dir: str) -> DataFrame:
    """``doc_id, expected_grade, p_best, kept`` of every document, by a model of the labels."""
    docs = read(spark, sf_dir, "documents")
    return score(docs, fitted(spark, docs, sf_dir))
