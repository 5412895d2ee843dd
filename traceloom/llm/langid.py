"""Language identification by word-first backoff (operator 10).

A word that the model knows is scored by its log frequency in each language. A word that
it does not know falls back to its character n-grams, the longest first: each position
takes the longest known n-gram that starts there.

The model is fitted on a bounded sample: ``SAMPLE_ROWS`` labelled rows a language at
most in expectation, taken by a hash of the id; it keeps ``MODEL_WORDS`` words and
``MODEL_GRAMS`` n-grams of each length, and so its size is bounded. Held-out rows,
crc32(id as text) mod 5 = 0, are never learnt from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, read
from .hashing import mix

SAMPLE_ROWS = 1200
MODEL_WORDS = 60_000
MODEL_GRAMS = 30_000
#: A word that the sample has less often is no word of the model; its n-grams count all the same.
LEAST_WORD = 2
LONGEST = 5
#: Words whose scores a task remembers, about, and their letters at most; with longer ones it forgets all after the run.
CACHE_WORDS, CACHE_LETTERS = 200_000, 200
#: Characters of texts that are scored together, about.
RUN_CHARS = 1 << 20
#: Letters of a long word that are scored together.
PIECE = 1 << 16

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return _LETTERS.findall(text.lower())


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS,
        model_words: int = MODEL_WORDS, model_grams: int = MODEL_GRAMS, least_word: int = LEAST_WORD) -> dict:
    """The model: languages, and tables of log frequencies a word and a gram of each length.

    Null texts and languages teach nothing; repeated rows and null ids are rows like others.
    A table without labelled rows gives a model without languages.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").alias("_lang"))
    rows = rows.where(F.col("_lang").isNotNull() & ~held_out(F.col("_id")))
    sizes = {r[0]: r[1] for r in rows.groupBy("_lang").count().collect()}  # one row a language
    share = F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, sample_rows / n)))) if sizes else None
    if share is None:
        return {"langs": [], "prior": np.zeros(0), "words": {}, "grams": {}}
    u = F.pmod(F.xxhash64(F.col("_id"), F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(F.col("_text").isNotNull() & (u < share[F.col("_lang")])).select("_lang", "_text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("_lang")["_text"]:
                c = Counter(w for t in texts for w in words_of(t))
                yield pd.DataFrame({"lang": lang, "word": list(c), "n": list(c.values())})

    counts = sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    own = [f"n{i}" for i in range(len(langs))]
    sums = [F.coalesce(F.sum(F.when(F.col("lang") == k, F.col("n"))), F.lit(0)).alias(c) for k, c in zip(langs, own, strict=True)]
    words = materialize(counts.groupBy("word").agg(*sums), "langid-words")
    every = sum((F.col(c) for c in own[1:]), F.col(own[0]))
    # n-grams of the sample's distinct words, with a space before and behind
    padded, k = F.concat(F.lit(" "), F.col("word"), F.lit(" ")), F.col("k")
    cut = words.select(padded.alias("p"), *own, F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("k")).where(F.length("p") >= k)
    cut = cut.select("k", *own, F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - k + 1), lambda i: F.substring(F.col("p"), i, k))).alias("g"))
    grams = materialize(cut.groupBy("k", "g").agg(*(F.sum(c).alias(c) for c in own)), "langid-grams")

    def logs(table: DataFrame, key: str, totals, most: int, least: int) -> dict[str, np.ndarray]:
        """Of the ``most`` frequent entries: they alone come to the driver."""
        total, size = np.array([totals[c] or 0 for c in own], float) + 1.0, totals["size"]
        top = table.where(every >= least).orderBy(F.desc(every), key).limit(most).collect()
        return {r[key]: np.log((np.array([r[c] for c in own], float) + 0.1) / (total + 0.1 * size)).astype(np.float32) for r in top}

    count_all = [F.count("*").alias("size"), *(F.sum(c).alias(c) for c in own)]
    by_length = {r["k"]: r for r in grams.groupBy("k").agg(*count_all).collect()}
    prior = np.log(np.array([sizes[x] for x in langs], float) / sum(sizes.values()))
    model = {
        "langs": langs, "prior": prior, "words": logs(words, "word", words.agg(*count_all).first(), model_words, least_word),
        "grams": {x: logs(grams.where(k == x), "g", by_length[x], model_grams, 1) for x in sorted(by_length)},
    }
    discard(words, grams)
    return model


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words, one after another, and where each ends."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))


def _gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` code points from each place on; there are fewer than places."""
    out = np.zeros(max(0, len(codes) - k + 1), np.uint64)
    for j in range(k):
        out += codes[j : j + len(out)] * _ODD[j]
    return mix(out + np.uint64(k))


class _Numbers(dict):
    """A number for each word, in the order of first use; ``new`` are those since it was emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Scorer:
    """Scores runs of texts; words' scores are rows of one table, which starts anew when it is full."""

    def __init__(self, model: dict):
        self.model = model
        n = len(model["langs"])
        rows, self.grams = [np.zeros((0, n), np.float32)], {}
        for k, table in sorted(model["grams"].items()):
            for g, v in table.items():
                self.grams[g] = len(self.grams)
                # shifted to a maximum of 0: only differences count; single characters say little
                rows.append(((v - v.max()) * (1.0 if k > 1 else 0.5))[None, :])
        self.gram_rows = np.concatenate(rows)
        self.by_length = []  # for each length, the longest first: hashes in order, and their rows
        for k, table in sorted(model["grams"].items(), reverse=True):
            codes, _ = _codes(list(table))
            hashes = _gram_hashes(codes, k)[:: k] if len(table) else np.zeros(0, np.uint64)
            order = np.argsort(hashes)
            self.by_length.append((k, hashes[order], np.fromiter(map(self.grams.__getitem__, table), np.int64, len(table))[order]))
        self.rows = np.zeros((0, n), np.float32)
        self.place = _Numbers()
        self.forget = False

    def _grams(self, padded: str, begin: int = 0, end: int | None = None) -> list[int]:
        """The longest known n-gram at each position of a word with spaces around it."""
        grams, at = self.grams, []
        for i in range(begin, min(end or len(padded), len(padded) - 1)):
            for k in range(LONGEST, 0, -1):
                g = grams.get(padded[i : i + k])
                if g is not None:
                    at.append(g)
                    break
        return at

    def _long(self, w: str) -> np.ndarray:
        """Scores of one word of any length, piece by piece."""
        v = self.model["words"].get(w)
        if v is None:
            padded, v, n = f" {w} ", np.zeros(self.rows.shape[1]), 0
            for i in range(0, len(padded), PIECE):
                at = self._grams(padded, i, i + PIECE)
                v, n = v + self.gram_rows[at].sum(0, dtype=float), n + len(at)
            v = v * (2.0 / max(n, 2))
        return v - v.max()

    def scores(self, words: list[str]) -> np.ndarray:
        """Log scores of words in each language, shifted to a maximum of 0."""
        known = self.model["words"]
        out = np.zeros((len(words), self.rows.shape[1]), np.float32)
        unseen = []
        for i, w in enumerate(words):
            v = known.get(w)
            if v is not None:
                out[i] = v
            elif w:
                unseen.append(i)
        if unseen:
            # the longest known n-gram at each place of all words at once, the space behind a word aside
            codes, ends = _codes([f" {words[i]} " for i in unseen])
            lens = np.diff(ends, prepend=0)
            last = np.repeat(ends, lens)
            open_ = np.flatnonzero(np.arange(len(codes)) < last - 1)
            found = np.full(len(codes), -1, np.int64)
            for k, hashes, rows in self.by_length:
                at = open_[open_ + k <= last[open_]]
                if len(hashes) and len(at):
                    mine = _gram_hashes(codes, k)[at]
                    place = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
                    hit = hashes[place] == mine
                    found[at[hit]] = rows[place[hit]]
                    open_ = open_[found[open_] < 0]
            at = np.flatnonzero(found >= 0)
            word = np.repeat(np.arange(len(unseen)), lens)[at]
            some, starts, n = np.unique(word, return_index=True, return_counts=True)
            if len(some):
                sums = np.add.reduceat(self.gram_rows[found[at]], starts, axis=0)
                out[np.array(unseen)[some]] = sums * (2.0 / np.maximum(n, 2))[:, None]
        return out - out.max(1, keepdims=True)

    def _learn(self) -> None:
        """Scores of the words that are new."""
        new, self.place.new = self.place.new, []
        if not new:
            return
        begin = len(self.place) - len(new)
        if len(self.place) > len(self.rows):
            self.rows = np.concatenate([self.rows[:begin], np.zeros((max(len(new), len(self.rows)), self.rows.shape[1]), np.float32)])
        long = [i for i, w in enumerate(new) if len(w) > CACHE_LETTERS]
        self.forget = bool(long)
        short = [w if len(w) <= CACHE_LETTERS else "" for w in new] if long else new
        self.rows[begin : len(self.place)] = self.scores(short)
        for i in long:
            self.rows[begin + i] = self._long(new[i])

    def many(self, texts: list) -> list[tuple[str, float]]:
        """Language of each text and its share of the likelihood; ``und``, 0.0 for text without letters."""
        if not self.model["langs"]:
            return [("und", 0.0)] * len(texts)
        found = [words_of(t) if isinstance(t, str) else [] for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        every = list(chain.from_iterable(found))
        at = np.fromiter(map(self.place.__getitem__, every), np.int64, len(every))
        self._learn()
        total = np.tile(self.model["prior"], (len(found), 1))
        some = np.flatnonzero(counts)
        if some.size:
            total[some] += np.add.reduceat(self.rows[at], (np.cumsum(counts) - counts)[some], axis=0, dtype=np.float64)
        out = []
        for words, t in zip(found, total, strict=True):
            if not any(ch.isalpha() for w in words for ch in w):
                out.append(("und", 0.0))
                continue
            best = int(t.argmax())
            out.append((self.model["langs"][best], float(1.0 / np.exp(np.clip(t - t[best], -50, 0)).sum())))
        if len(self.place) > CACHE_WORDS or self.forget:
            self.place, self.rows, self.forget = _Numbers(), self.rows[:0], False
        return out

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.many([text])[0]


def runs(texts: list) -> Iterator[tuple[int, int]]:
    """Texts of about ``RUN_CHARS`` together, at least one."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if i > begin and size + n > RUN_CHARS:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


_scorers: list[Scorer] = []


def predict(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for each input row, from its whole text alone.

    Null text and text without letters: ``und`` with score 0. Ties go to the language
    first in code point order. Other columns are not read; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not _scorers or _scorers[0].model is not shared.value:
            _scorers[:] = [Scorer(shared.value)]
        scorer = _scorers[0]
        for pdf in batches:
            texts, got = list(pdf["_text"]), []
            for a, b in runs(texts):
                got += scorer.many(texts[a:b])
            yield pd.DataFrame({"_id": pdf["_id"], "lang_pred": [x[0] for x in got], "score": [x[1] for x in got]})

    kind = dict(narrow.dtypes)["_id"]
    # an id column with nulls would become floating point in pandas: it travels as text
    out = narrow.withColumn("_id", F.col("_id").cast("string")).mapInPandas(run, "_id string, lang_pred string, score double")
    return out.select(F.col("_id").cast(kind).alias("doc_id"), "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text; learnt from the rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
