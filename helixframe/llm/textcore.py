"""Vectorised words, hashes and grams over the flat buffers of Arrow string columns.

A word is ``[^\\x20\\x09-\\x0D]+`` of one text's UTF-8 bytes. Work goes over pieces of at most
``PIECE`` bytes, so its memory does not follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_GRAM = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, PIECE + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), PIECE + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche; a bijection on 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n, at = len(column), column.offset
    _, where, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64)[at:at + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``limit`` bytes; a longer text is a run of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each text (one more entry at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[0] = False
    edge = offsets[offsets < len(data)]
    before[edge] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[:-1] = word[1:]
    after[-1] = False
    edge = offsets[offsets > 0] - 1
    after[edge] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    out = np.empty(len(starts), U)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, side="right")))
        base = starts[a]
        piece = data[base:ends[b - 1]].astype(U) + U(1)
        power, inverse = (_POW, _INV) if len(piece) <= PIECE else (
            _powers(_BASE, len(piece) + 1), _powers(pow(_BASE, -1, 1 << 64), len(piece) + 1))
        total = np.zeros(len(piece) + 1, U)
        np.cumsum(piece * power[:len(piece)], out=total[1:])
        s, e = starts[a:b] - base, ends[a:b] - base
        out[a:b] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U))
        a = b
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive entries of ``h``; the caller leaves out those across texts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, have, power, size = None, 0, h, 1
    factor = _GRAM
    while True:
        if k & size:
            part = power[have:have + n]
            out = part.copy() if out is None else out * U(factor) + part
            have += size
        size *= 2
        if size > k:
            break
        power = power[:len(power) - size // 2] * U(factor) + power[size // 2:]
        factor = factor * factor & _MASK
    return mix(out)


def gram_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k-grams that stay inside one text, and the first of each text in that list."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    offsets = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], n)
    return at, offsets


def doc_shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and their offsets.

    A text with fewer than ``k`` words is one shingle, one without words has none.
    """
    at, offsets = gram_starts(first, k)
    all_grams = grams(h, k)
    values, out, lengths = all_grams[at] if len(at) else np.zeros(0, U), [], np.zeros(len(first) - 1, np.int64)
    words = np.diff(first)
    for i, n in enumerate(words):
        if n >= k:
            own = np.unique(values[offsets[i]:offsets[i + 1]])
        elif n:
            own = grams(h[first[i]:first[i + 1]], int(n)) ^ U(int(n))
        else:
            continue
        out.append(own)
        lengths[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate(([0], np.cumsum(lengths)))
