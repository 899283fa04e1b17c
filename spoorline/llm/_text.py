"""Vectorised words, hashes and shingles over Arrow string columns.

A word is a maximal run of characters outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F`` after
lower-casing A-Z: digits, a-z and everything beyond ASCII. All bytes of a non-ASCII character are
word bytes, so the scan can work on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def chunks(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``i..j`` with their UTF-8 bytes and offsets, about ``max_bytes`` at a time; a null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes of one non-zero ``kind`` within a row, and each row's first run."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1] & (kind != 0))
    ends = np.flatnonzero(edge[1:] & (kind != 0)) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte ranges, all from one running sum."""
    n = len(values)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(_P, n), out=total[1:])
    h = (total[ends] - total[starts]) * _power(_P_INV, n)[starts] if n else np.empty(0, np.uint64)
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each row's words start among them."""
    low = _LOWER[data]
    starts, ends, at = runs(low, offsets, _WORD[low].view(np.uint8))
    return run_hashes(low, starts, ends), at


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (across rows too; callers keep the valid starts)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out + h[i : len(h) - k + 1 + i]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return mix(out + np.uint64(k))


def grams_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """As ``grams``, of the runs that start at ``at`` only."""
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        out = (out + h[at + i]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return mix(out + np.uint64(k))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row's distinct ``k``-word shingles, sorted, and how often each occurs; a row of fewer words has one."""
    h, at = words(data, offsets)
    g = grams(h, k)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            yield np.unique(g[a : b - k + 1], return_counts=True)
        elif b > a:
            yield grams(h[a:b], int(b - a)), np.ones(1, np.int64)
        else:
            yield np.empty(0, np.uint64), np.empty(0, np.int64)
