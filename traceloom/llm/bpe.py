"""Byte-level BPE encoding and decoding by merge replay over the corpus's words (operator 7).

The corpus is the distinct words (matches of the split pattern) of all texts:

* batches: runs of documents of about ``BATCH_CHARS``. A batch holds its distinct words
  and, in place of its texts, each word's number; it is shuffled once, packed;
* words: each batch's distinct words, dealt by hash to partitions of the corpus. A
  partition makes them distinct across batches and replays the merges over them: an
  inverted index leads from the rank of each adjacent pair to the positions where the
  pair stands, ranks are applied in order to all their positions, and each merge updates
  only the pairs with the left and right neighbours. At most ``REPLAY_BYTES`` of a
  partition's words are replayed together, which bounds memory and changes no result;
* back: the ids of a batch's words come back in the order of its words, and its documents'
  ids are gathered by word number.

A word that a third of all tokens are is one entry of each batch. Decoding looks each id
up and joins the bytes.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import planes, read, release, shuffle_partitions, slices, unplanes
from .hashing import hash_runs

#: Texts are taken together up to so many characters.
CHUNK_CHARS = 1 << 18
#: Characters of a batch, about, and of the texts whose words a hash partition holds.
BATCH_CHARS, PARTITION_CHARS = 8_000_000, 24_000_000
#: Bytes of words that are replayed together.
REPLAY_BYTES = 1 << 19
#: Runs that are gathered together, and words of a batch whose ids are made and decoded together.
GATHER_RUNS, JOIN_WORDS = 1 << 16, 1 << 18
#: Words of a generation that a worker remembers, and their characters at most.
CACHE_WORDS = 200_000
CACHE_WORD_CHARS = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a rank file: base64 token and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=8)
def splitter(pattern: str):
    r"""The compiled split pattern. ``\s`` is Unicode's White_Space, ``\S`` its complement."""
    import regex

    space = r"\t-\r\x20\x85\xa0  -     　"
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S"):
            out.append(space if inside and two == r"\s" else f"[{'^' if two == r'\S' else ''}{space}]")
            i += 2
            continue
        if two[0] == "\\":
            out.append(two)
            i += 2
            continue
        inside = (inside or two[0] == "[") and two[0] != "]"
        out.append(two[0])
        i += 1
    return regex.compile("".join(out))


class Merger:
    """Applies merge ranks to many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        #: Rank of the merge of any two bytes, or -1.
        self.two = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        self.pairs: dict[int, int] = {}

    def _rank(self, key: int) -> int:
        if len(self.pairs) > 400_000:
            self.pairs.clear()
        r = self.pairs[key] = self.ranks.get(self.tokens[key >> 32] + self.tokens[key & 0xFFFFFFFF], -1)
        return r

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. A word that is a token itself is one id."""
        out: list[list[int]] = [[] for _ in words]
        todo = []
        for i, w in enumerate(words):
            r = self.ranks.get(w)
            if r is not None:
                out[i] = [r]
            elif w:
                todo.append(i)
        if not todo:
            return out
        data = np.frombuffer(b"".join([words[i] for i in todo]), np.uint8)
        lens = np.fromiter((len(words[i]) for i in todo), np.int64, len(todo))
        ends = np.cumsum(lens)
        symbol = self.single[data].tolist()
        n = len(symbol)
        place = np.arange(n)
        step = place + 1
        step[ends - 1] = -1
        after = step.tolist()  # place of the next symbol, -1 at a word's end
        step = place - 1
        step[ends - lens] = -1
        before = step.tolist()
        ranks = np.full(n, -1, np.int64)
        ranks[:-1] = self.two[data[:-1], data[1:]]
        ranks[ends - 1] = -1
        pair = ranks.tolist()  # rank of the pair that starts at each place
        order = np.argsort(ranks, kind="stable")
        sorted_ranks = ranks[order]
        order, sorted_ranks = order[sorted_ranks >= 0], sorted_ranks[sorted_ranks >= 0]
        values, cuts = np.unique(sorted_ranks, return_index=True)
        index = {r: x.tolist() for r, x in zip(values.tolist(), np.split(order, cuts[1:]), strict=True)} if len(values) else {}
        heap = list(index)  # sorted, and so a heap
        known, miss, push = self.pairs, self._rank, heapq.heappush
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()  # leftmost first among equal ranks
            for k, p in enumerate(places):
                if pair[p] != r:
                    continue  # a merge has changed the pair meanwhile
                q = after[p]
                symbol[p] = r
                pair[q] = -1
                after[p] = nxt = after[q]
                low = r
                if nxt >= 0:
                    before[nxt] = p
                    key = r << 32 | symbol[nxt]
                    x = known.get(key)
                    if x is None:
                        x = miss(key)
                    pair[p] = x
                    if x >= 0:
                        if x in index:
                            index[x].append(p)
                        else:
                            index[x] = [p]
                            push(heap, x)
                        if x < low:
                            low = x
                else:
                    pair[p] = -1
                prev = before[p]
                if prev >= 0:
                    key = symbol[prev] << 32 | r
                    x = known.get(key)
                    if x is None:
                        x = miss(key)
                    pair[prev] = x
                    if x >= 0:
                        if x in index:
                            index[x].append(prev)
                        else:
                            index[x] = [prev]
                            push(heap, x)
                        if x < low:
                            low = x
                if low < r:  # a lower rank has come up: it goes first, the rest waits
                    if rest := places[k + 1 :]:
                        index[r] = rest + index.get(r, [])
                        push(heap, r)
                    break
        for i, p in zip(todo, (ends - lens).tolist(), strict=True):
            ids = out[i]
            while p >= 0:
                ids.append(symbol[p])
                p = after[p]
        return out


class Encoder:
    """Encodes runs of texts with a bounded cache of words, in two generations."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merger = Merger(ranks)
        self.pattern = pattern
        self.find = splitter(pattern).findall
        self.cache: dict[str, bytes] = {}  # words seen lately
        self.older: dict[str, bytes] = {}  # those of the time before

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's count of ids."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            found = self.find(t)
            counts[i] = len(found)
            words += found
        place = dict.fromkeys(words)
        place = dict(zip(place, range(len(place)), strict=True))
        cache, older = self.cache, self.older
        known = {w: b for w in place if (b := cache.get(w) or older.get(w)) is not None}
        new = [w for w in place if w not in known]
        got = self.merger.replay([w.encode("utf-8", "replace") for w in new])
        fresh = dict(zip(new, (np.array(x, np.int32).tobytes() for x in got), strict=True))
        known |= fresh
        parts = [known[w] for w in place]
        if len(cache) + len(known) > CACHE_WORDS:
            self.older, self.cache = cache, {}
        self.cache.update((w, b) for w, b in known.items() if len(w) <= CACHE_WORD_CHARS)
        lens = np.fromiter((len(b) >> 2 for b in parts), np.int64, len(parts))
        flat = np.frombuffer(b"".join(parts), np.int32)
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        ids, each = gather(flat, lens, at)
        ends = np.cumsum(each)
        bounds = np.cumsum(counts)
        upto = np.where(bounds > 0, ends[np.maximum(bounds - 1, 0)] if len(ends) else 0, 0)
        return ids, np.diff(upto, prepend=0)


def gather(flat: np.ndarray, lens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` numbered ``at``, one after another, and their lengths."""
    starts = np.cumsum(lens) - lens
    each = lens[at]
    ends = np.cumsum(each)
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    for i in range(0, len(at), GATHER_RUNS):  # places are 8 bytes each: few at a time
        own, last = each[i : i + GATHER_RUNS], ends[i : i + GATHER_RUNS]
        begin, end = int(last[0] - own[0]), int(last[-1])
        out[begin:end] = flat[np.repeat(starts[at[i : i + GATHER_RUNS]] - (last - own), own) + np.arange(begin, end)]
    return out, each


def text_runs(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    start, size, held = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > most:
            yield start, i, held
            start, size, held = i, 0, []
        held.append(t)
        size += len(t)
    if held:
        yield start, start + len(held), held


class _Packer:
    """Gathers documents into a batch: its distinct words, and each word's number in place of the texts."""

    def __init__(self, find, parts: int):
        self.find, self.parts = find, parts
        self.begin()

    def begin(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.rows: list[pa.RecordBatch] = []
        self.index: list[np.ndarray] = []
        self.counts: list[int] = []
        self.chars = 0

    def add(self, rows: pa.RecordBatch, texts: list[str]) -> None:
        self.rows.append(rows)
        for t in texts:
            found = self.find(t)
            self.index.append(np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)))
            self.counts.append(len(found))
            self.chars += len(t)

    def out(self, batch: int) -> pa.RecordBatch:
        index = np.concatenate([*self.index, np.zeros(0, np.int32)])
        # frequent words have small numbers, which compress better
        order = np.argsort(-np.bincount(index, minlength=len(self.number)), kind="stable")
        renumbered = np.empty(len(order), np.int32)
        renumbered[order] = np.arange(len(order), dtype=np.int32)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.rows[0].schema) as out:
            for rows in self.rows:
                out.write_batch(rows)
        words = list(self.number)
        words = pa.array([words[i].encode("utf-8", "replace") for i in order.tolist()], pa.binary())
        pieces = [sink.getvalue(), planes(np.array(self.counts, np.int32)), planes(renumbered[index]), *_word_bytes(words)]
        columns = [pa.array([batch], pa.int64()), *(pa.array([_squeeze(x)], pa.binary()) for x in pieces)]
        self.begin()
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _BATCH.split(", ")])


_BATCH = "batch long, rows binary, counts binary, numbers binary, lens binary, words binary"


def _squeeze(b) -> bytes:
    b = pa.py_buffer(b)
    return b.size.to_bytes(8, "little") + pa.compress(b, "zstd", asbytes=True)


def _unsqueeze(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)


def _word_bytes(words: pa.BinaryArray) -> tuple[bytes, pa.Buffer]:
    """The lengths of words, and their bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return planes(np.diff(offsets).astype(np.int32)), words.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if len(words) and words.buffers()[2] else pa.py_buffer(b"")


def _word_array(lens: np.ndarray, data: bytes) -> pa.BinaryArray:
    offsets = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _dealt(lens: np.ndarray, data: bytes, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a batch by their hash partitions: word numbers in that order, and each one's partition."""
    place = (hash_runs(data, lens.astype(np.int64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    return order, place[order]


def _deal(parts: int):
    """A row for each batch and hash partition: the words of the one that belong to the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                lens, data = unplanes(_unsqueeze(whole.column(4)[i].as_py()), np.int32), _unsqueeze(whole.column(5)[i].as_py())
                if not len(lens):
                    continue  # texts without words have no ids to wait for
                order, place = _dealt(lens, data, parts)
                words = _word_array(lens, data).take(pa.array(order))
                p, starts = np.unique(place, return_index=True)
                pieces = [_word_bytes(words.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(place)], strict=True)]
                batch = pa.array(np.full(len(p), whole.column(0)[i].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), batch, *(pa.array([_squeeze(x[k]) for x in pieces], pa.binary()) for k in (0, 1))], names=["p", "batch", "lens", "words"])

    return run


def _replayed(shared):
    """For each batch of a hash partition: how many ids each of its words has, and the ids."""
    def run(table: pa.Table) -> pa.Table:
        merger = _merger(shared.value)
        sizes = [unplanes(_unsqueeze(x.as_py()), np.int32) for x in table.column("lens")]
        coded = _word_array(np.concatenate(sizes), b"".join(_unsqueeze(x.as_py()) for x in table.column("words"))).dictionary_encode()
        words, flat, lens, size, held = coded.dictionary.to_pylist(), [], [], 0, []
        for i, w in enumerate(words):
            held.append(w)
            size += len(w)
            if size >= REPLAY_BYTES or i + 1 == len(words):
                got = merger.replay(held)
                lens.append(np.fromiter(map(len, got), np.int64, len(got)))
                flat.append(np.fromiter((x for ids in got for x in ids), np.int32, int(lens[-1].sum())))
                held, size = [], 0
        flat, lens = np.concatenate([*flat, np.zeros(0, np.int32)]), np.concatenate([*lens, np.zeros(0, np.int64)])
        at = coded.indices.to_numpy()
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in sizes])])
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            ids, each = gather(flat, lens, at[a:b])
            out.append((_squeeze(planes(each.astype(np.int32))), _squeeze(planes(ids))))
        merger.pairs.clear()
        release()
        return pa.table({
            "batch": table.column("batch"), "p": table.column("p"), "lens": pa.array([x for x, _ in out], pa.binary()), "ids": pa.array([x for _, x in out], pa.binary()),
        })

    return run


def _joined(shared, parts: int, decoded: bool):
    """The documents of a batch with their ids, and with what these decode to if ``decoded``, in Arrow batches of about ``JOIN_WORDS`` words."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _mergers.clear()  # all merges have been replayed by now
        order = np.argsort(right.column("p").to_numpy())
        read_ = lambda name: np.concatenate([*(unplanes(_unsqueeze(right.column(name)[int(i)].as_py()), np.int32) for i in order), np.zeros(0, np.int32)])
        lens, flat = read_("lens").astype(np.int64), read_("ids")
        out = []
        for i in range(left.num_rows):  # each batch has its row, so that no group of answers comes alone
            rows, counts, numbers, sizes, data = (_unsqueeze(left.column(c)[i].as_py()) for c in ("rows", "counts", "numbers", "lens", "words"))
            dealt, _ = _dealt(unplanes(sizes, np.int32), data, parts)
            if len(dealt) != len(lens):
                raise RuntimeError("the words of a batch have changed between two runs of the input")
            at = np.empty(len(dealt), np.int32)
            at[dealt] = np.arange(len(dealt), dtype=np.int32)
            numbers, rows = unplanes(numbers, np.int32), pa.ipc.open_stream(rows).read_all().combine_chunks()
            upto = np.concatenate([[0], np.cumsum(unplanes(counts, np.int32))])
            a = 0
            while a < rows.num_rows:
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + JOIN_WORDS, "right")) - 1)
                ids, each = gather(flat, lens, at[numbers[upto[a] : upto[b]]])
                ends = np.concatenate([[0], np.cumsum(each)])[upto[a : b + 1] - upto[a]]
                columns = dict(zip(rows.schema.names, rows.slice(a, b - a).columns, strict=True))
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
                if decoded:
                    columns["_bytes"] = decode_ids(_by_id(shared.value), ids, np.diff(ends))
                out.append(pa.table(columns))
                a = b
        release()
        return pa.concat_tables(out)

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded_col: str | None = None) -> DataFrame:
    """``keep`` columns and ``ids array<int>`` of each whole text, one row per input row.

    Null and empty texts have no ids. Repeated rows, null ids and other columns don't
    matter. No special tokens: their strings are ordinary text. An empty table gives an
    empty result. ``ranks`` is broadcast: its size is the vocabulary's. ``decoded_col``
    names a further column with the bytes that the ids decode to.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    narrow = docs.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), F.col(f"`{text_col}`").alias("_text"))
    fields = [f"_k{i} {t}" for i, (_, t) in enumerate(narrow.dtypes[:-1])]
    chars = docs.agg(F.sum(F.length(F.col(f"`{text_col}`")))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-chars // PARTITION_CHARS))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task, n = _Packer(splitter(pattern).findall, parts), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            others = batch.select(list(range(batch.num_columns - 1)))
            for a, b, texts in text_runs(batch.column(batch.num_columns - 1).to_pylist()):
                if packer.rows and packer.chars + sum(map(len, texts)) > BATCH_CHARS:
                    yield packer.out(task << 33 | n)
                    n += 1
                packer.add(others.slice(a, b - a), texts)
        if packer.rows:
            yield packer.out(task << 33 | n)
        release()

    # both readers take whole rows, so that they share one shuffle
    held = narrow.mapInArrow(packed, _BATCH).repartition(parts, "batch")
    words = held.mapInArrow(_deal(parts), "p int, batch long, lens binary, words binary")
    back = words.groupBy("p").applyInArrow(_replayed(shared), "batch long, p int, lens binary, ids binary")

    schema = ", ".join([*fields, "ids array<int>", *(["_bytes binary"] if decoded_col else [])])
    out = held.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(_joined(shared, parts, decoded_col is not None), schema)
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "ids", *([F.col("_bytes").alias(decoded_col)] if decoded_col else []))


_mergers: list[Merger] = []


def _merger(ranks: dict[bytes, int]) -> Merger:
    """The worker's merger; one vocabulary at a time."""
    if not _mergers or (_mergers[0].ranks is not ranks and _mergers[0].ranks != ranks):
        _mergers[:] = [Merger(ranks)]
    return _mergers[0]


def _by_id(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids, one after another, and their lengths."""
    if not _tables or _tables[0][0] is not ranks:
        by_id = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            by_id[r] = b
        _tables[:] = [(ranks, np.frombuffer(b"".join(by_id), np.uint8), np.fromiter(map(len, by_id), np.int64, len(by_id)))]
    return _tables[0][1:]


_tables: list[tuple] = []


def decode_ids(by_id: tuple[np.ndarray, np.ndarray], ids: np.ndarray, counts: np.ndarray) -> pa.BinaryArray:
    """The bytes of runs of ``counts`` ids."""
    data, each = gather(*by_id, ids)
    offsets = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def decode(encoded: DataFrame, ranks: dict[bytes, int], *, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), out_col: str = "decoded") -> DataFrame:
    """``keep`` columns and the bytes (``binary``) of each row's ids. Null ids give empty bytes; an unknown id is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    narrow = encoded.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), F.col(f"`{ids_col}`").alias("_ids"))
    fields = [f"_k{i} {t}" for i, (_, t) in enumerate(narrow.dtypes[:-1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            column = batch.column(batch.num_columns - 1)
            counts = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            texts = decode_ids(_by_id(shared.value), column.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], "_out"])

    out = narrow.mapInArrow(run, ", ".join([*fields, "_out binary"]))
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), F.col("_out").alias(out_col))


def default_vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def digest(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """Encodes, decodes the ids again, and reports digests of both."""
    ranks, pattern = default_vocabulary()
    both = encode(docs, ranks, pattern, decoded_col="decoded")
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256")
    more = ["ids"] if with_ids else []
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids, F.sha2("decoded", 256).alias("decoded_sha256"), *more)


def query(spark, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text."""
    return digest(read(spark, sf_dir, "documents"))
