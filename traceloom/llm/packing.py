"""Token ids packed into fixed rows by best-fit decreasing (operator 6).

A task encodes its documents and packs them in units of at most ``UNIT_ROWS`` full rows,
so its memory is bounded and nothing is shuffled. A document longer than a row is split
into pieces of a whole row and a rest; no token is lost or repeated. Pieces go from the
longest to the shortest to the open row with the least room that still holds them; a
segment tree over room sizes finds it in log(row length) steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_vocabulary, text_runs
from .common import read

ROW = 2048
UNIT_ROWS = 2048

SCHEMA = (
    "pack_id string, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<bigint>, pieces array<int>, doc_offsets array<bigint>"
)


class RoomTree:
    """Smallest room of at least a size among open rows, by a segment tree over room sizes."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def push(self, room: int, row: int) -> None:
        if room:
            self.rows[room].append(row)
            self._add(room, 1)

    def pop(self, size: int) -> tuple[int, int] | None:
        """Take out an open row with the least room >= size: (room, row)."""
        i, count = size + self.leaves, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], row: int) -> list[list[int]]:
    """Item numbers of each row. Sizes are from 1 to ``row``; ties keep their order."""
    tree, rows = RoomTree(row), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        found = tree.pop(size)
        if found is None:
            found = (row, len(rows))
            rows.append([])
        room, at = found
        rows[at].append(item)
        tree.push(room - size, at)
    return rows


def pack(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, id_col: str = "doc_id", text_col: str = "text", row: int = ROW, pad: int | None = None) -> DataFrame:
    """Packed rows of all documents (``SCHEMA``).

    ``ids``: ``row`` little-endian ids, uint16 if the vocabulary and pad fit, else int32,
    filled with ``pad`` (the first free id); ``cu_seqlens``: 0 and the end of each
    segment; ``position_resets``: where positions start again at 0, each segment's start;
    ``doc_ids``, ``pieces``, ``doc_offsets``: each segment's document, its piece number
    and its first token's place in the document. Null, empty and wordless texts have no
    tokens and no segment. Null ids and repeated rows are documents like others.
    """
    import tiktoken  # noqa: F401  fails here rather than on executors

    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    pad = max(ranks.values()) + 1 if pad is None else pad
    kind = "<u2" if max(pad, *ranks.values()) < 1 << 16 else "<i4"
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    most = UNIT_ROWS * row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        part, unit = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # (doc_id, piece, offset, ids)
        tokens = 0

        def flush() -> pa.RecordBatch:
            rows = best_fit_decreasing([len(x[3]) for x in held], row)
            cols: list[list] = [[] for _ in range(9)]
            for r, items in enumerate(rows):
                segments = [held[i] for i in items]
                ends = np.cumsum([len(x[3]) for x in segments])
                data = np.full(row, pad, kind)
                data[: ends[-1]] = np.concatenate([x[3] for x in segments])
                starts = [0, *map(int, ends[:-1])]
                values = (f"{part}-{unit}", r, int(ends[-1]), data.tobytes(), [*starts, int(ends[-1])], starts, [x[0] for x in segments], [x[1] for x in segments], [x[2] for x in segments])
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, _, texts in text_runs(batch.column(1).to_pylist()):
                for i, text in enumerate(texts, a):
                    got = np.array(encoding.encode_ordinary(text), kind)
                    for piece, at in enumerate(range(0, len(got), row)):
                        if tokens >= most:
                            yield flush()
                            held, tokens, unit = [], 0, unit + 1
                        held.append((ids[i], piece, at, got[at : at + row]))
                        tokens += len(held[-1][3])
        if held:
            yield flush()

    return narrow.mapInArrow(run, SCHEMA)


def position_ids(cu_seqlens: list[int], row: int = ROW) -> np.ndarray:
    """Positions of a packed row: 0, 1, ... in each segment; 0 in the padding."""
    out = np.zeros(row, np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False):
        out[a:b] = np.arange(b - a)
    return out


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet with raw id matrices (``ids``), ``cu_seqlens`` and ``position_resets``."""
    packed.write.mode("errorifexists").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """Packed rows of the token ids of every document."""
    ranks, pattern = default_vocabulary()
    return pack(read(spark, sf_dir, "documents"), ranks, pattern)
