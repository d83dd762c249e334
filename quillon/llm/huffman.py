"""Canonical, length-limited Huffman codes for token ids: building, packing and table-driven reading."""

from __future__ import annotations

import numpy as np

LIMIT = 20  # longest code, in bits; 2**LIMIT entries in the reading table
STEP = 64  # ids between two bit-offset checkpoints


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << limit:
        raise ValueError("too many ids for this code length")
    if n <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    levels = []  # of each level: the running number of leaves in the merged list
    merged = leaves
    levels.append(np.arange(1, n + 1))
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, pairs))
        by = np.argsort(both, kind="stable")
        merged = both[by]
        levels.append(np.cumsum(by < n))
    depth = np.zeros(n, np.int64)
    take = 2 * n - 2
    for running in reversed(levels):
        if not take:
            break
        own = int(running[take - 1])
        depth[:own] += 1
        take = 2 * (take - own)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: shorter codes first, then by id."""
    codes = np.zeros(len(lengths), np.uint32)
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    width = lengths[ids].astype(np.int64)
    first = np.concatenate(([0], np.cumsum(1 << (LIMIT - width))))[:-1] if len(ids) else np.zeros(0, np.int64)
    codes[ids] = first >> (LIMIT - width)
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of the ids and the bit offset of each STEP-th id."""
    width = lengths[ids].astype(np.int64)
    if len(ids) and not width.min():
        raise ValueError("an id without a code")
    ends = np.cumsum(width)
    starts = ends - width
    total = int(ends[-1]) if len(ids) else 0
    # each code lies in one or two words of 32 bits; no two codes share a bit, so sums are unions (and exact in doubles)
    word = starts >> 5
    at = codes[ids].astype(np.uint64) << (64 - (starts & 31) - width).astype(np.uint64)
    n = (total >> 5) + 2
    words = np.bincount(word, (at >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (at & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], starts[::STEP].astype(np.uint32)


class Reader:
    """One table look-up per id: the next LIMIT bits give the id and its length."""

    def __init__(self, lengths: np.ndarray):
        ids = np.flatnonzero(lengths)
        ids = ids[np.lexsort((ids, lengths[ids]))]
        span = 1 << (LIMIT - lengths[ids].astype(np.int64))
        self.id = np.repeat(ids.astype(np.uint32), span)
        self.width = np.repeat(lengths[ids], span)

    def read(self, payload: bytes, n: int, checkpoints: np.ndarray) -> np.ndarray:
        """The n ids of a block: all stretches between checkpoints are read side by side."""
        if not n:
            return np.zeros(0, np.uint32)
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        word = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((STEP, len(at)), np.uint32)
        full = n - STEP * (len(at) - 1)
        for k in range(STEP):
            if k == full:
                at = at[:-1]
            key = (word[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - LIMIT)
            out[k, : len(at)] = self.id[key]
            at = at + self.width[key]
        return out.T.reshape(-1)[:n]
