"""Vectorised text helpers shared by the Arrow-backed operators.

Every helper works on the UTF-8 bytes of a chunk of documents at once, so a
Python worker never loops over characters.  A chunk is bounded in bytes (one
document may exceed the bound on its own), which bounds the worker's memory.

Conventions: a null text counts as the empty text; each document of a chunk is
followed by one newline byte, which no word class contains.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_ROOT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def splitmix(seed: int, n: int) -> np.ndarray:
    """n well-mixed 64-bit values from a seed, by rule, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(_ROOT) + U64(seed & _MASK))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply); a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = splitmix(11, 256)
_R = 0xD1342543DE82EF95  # odd, hence invertible modulo 2**64
_R_INV = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _pow(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        for k, base in enumerate((_R, _R_INV)):
            p = np.full(n, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


class Chunk:
    """The bytes of some documents and where each begins."""

    def __init__(self, texts: pa.Array):
        joined = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", "\n")
        wide = pa.types.is_large_string(joined.type)
        n = len(joined)
        self.offsets = np.frombuffer(joined.buffers()[1], np.int64 if wide else np.int32, n + 1).astype(np.int64)
        data = joined.buffers()[2]
        self.buf = np.frombuffer(data, np.uint8, int(self.offsets[-1])) if data is not None else np.zeros(0, np.uint8)
        self.n = n
        self._sums: np.ndarray | None = None

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """The index of the document that holds each byte position (ascending or not)."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def segments(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes whose class is true. inside: a table of 256 booleans."""
        m = inside[self.buf]
        edge = np.flatnonzero(m[1:] != m[:-1]) + 1
        if len(m) and m[0]:
            edge = np.concatenate(([0], edge))
        if len(edge) % 2:
            edge = np.concatenate((edge, [len(m)]))
        return edge[0::2], edge[1::2]

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range: a polynomial over random byte values, then mixed with the length."""
        if self._sums is None:
            p = _pow(len(self.buf) + 1)[0][: len(self.buf)]
            s = np.empty(len(self.buf) + 1, U64)
            s[0] = 0
            np.cumsum(_BYTE[self.buf] * p, out=s[1:])
            self._sums = s
        inv = _pow(len(self.buf) + 1)[1]
        h = (self._sums[ends] - self._sums[starts]) * inv[starts]
        return mix(h + (ends - starts).astype(U64) * U64(_ROOT))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: ASCII letters and digits and every byte of a non-ASCII character.
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    lo = total = 0
    for i, s in enumerate(sizes.tolist()):
        if i > lo and total + s > limit:
            yield lo, i
            lo, total = i, 0
        total += s
    if len(sizes) > lo:
        yield lo, len(sizes)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of each k consecutive values; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= U64(_R)
        acc += h[j : n + j]
    return mix(acc)


def by_chunk(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text", limit: int = CHUNK_BYTES):
    """A function for mapInArrow that applies f to slices of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.schema.get_field_index(text))
            for lo, hi in chunks(col, limit):
                out = f(b.slice(lo, hi - lo))
                if out is not None and out.num_rows:
                    yield out

    return run


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: counts[i] consecutive values for row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
