"""Vectorised 64-bit hashes of the words of a batch of texts (numpy only, runs on executors).

Words are runs of bytes other than ASCII white space in UTF-8. A word's hash is a
polynomial over a random byte table modulo 2**64, finished with a mixer, so that a
whole batch is hashed without a Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}

#: Texts are hashed together up to about so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_chunk(chunk: Sequence[bytes], prefixes: Sequence[int] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of all words of the texts, in order, and how many words each text has.

    For each of ``prefixes``, the hashes of the words' first so many bytes follow.
    """
    data = np.frombuffer(b"\n".join(chunk) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.empty(len(data) + 1, np.int8)
    edge[0] = 0
    edge[1:] = ~space
    step = np.diff(edge)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    lengths = np.fromiter(map(len, chunk), np.int64, len(chunk)) + 1
    bounds = np.cumsum(lengths)
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts, *(np.zeros(0, np.uint64) for _ in prefixes)
    terms = _BYTE[data] * _power(_P, len(data))
    terms[space] = 0
    back = _power(_P_INV, len(data))[starts]
    total = np.add.reduceat(terms, starts)
    total *= back
    total += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    more = []
    for k in prefixes:
        part = terms[starts].copy()
        for i in range(1, k):
            part += np.where(starts + i < ends, terms[np.minimum(starts + i, len(data) - 1)], np.uint64(0))
        more.append(mix(part * back + np.uint64(k)))
    return mix(total), counts, *more


def hash_runs(data: bytes, lens: np.ndarray) -> np.ndarray:
    """Hashes of runs of bytes, one after another, of the lengths given; an empty run's is 0."""
    out = np.zeros(len(lens), np.uint64)
    some = np.flatnonzero(lens)
    if some.size:
        starts = (np.cumsum(lens) - lens)[some]
        terms = _BYTE[np.frombuffer(data, np.uint8)] * _power(_P, len(data))
        total = np.add.reduceat(terms, starts) * _power(_P_INV, len(data))[starts]
        out[some] = mix(total + lens[some].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def chunks(texts: Sequence[str | None], lower: bool) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs (from, to, encoded texts) of texts of about ``CHUNK_BYTES`` bytes; null is empty."""
    start, size, held = 0, 0, []
    for i, text in enumerate(texts):
        b = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        b = b.lower() if lower else b
        if held and size + len(b) > CHUNK_BYTES:
            yield start, i, held
            start, size, held = i, 0, []
        held.append(b)
        size += len(b)
    if held:
        yield start, start + len(held), held
