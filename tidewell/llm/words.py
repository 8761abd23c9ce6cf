"""Vectorised words, shingles and 64-bit fingerprints over UTF-8 bytes (numpy; no per-word Python objects).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. All separators are ASCII, so
working on bytes gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE, _MIX = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _LOWER.astype(U64) + U64(1)
_VALUE[_SPACE] = 0
_POWERS = np.ones(1, U64)
#: Separators of plain words: every ASCII byte that is neither a letter nor a digit.
PLAIN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def powers(n: int) -> np.ndarray:
    """The first n powers of the polynomial base modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << max(12, (n - 1).bit_length())
        p = np.full(size, _BASE, U64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def fmix(h: np.ndarray) -> np.ndarray:
    """The Murmur3 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def word_hashes(buf: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of the documents buf[offsets[i]:offsets[i+1]], and for each document the range of its words as len(offsets) bounds."""
    if not len(buf):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = ~apart[buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[first] = inside[first]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    spans = np.diff(starts, append=len(buf))
    at = np.arange(starts[0], len(buf), dtype=np.int64)
    at -= np.repeat(starts, spans)
    value = np.where(apart, U64(0), _VALUE)[buf[starts[0]:]]
    value *= powers(int(spans.max()))[at]
    return fmix(np.add.reduceat(value, starts - starts[0])), np.searchsorted(starts, offsets)


def combined(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= _MIX
        out += words[i:i + n]
    return fmix(out)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each document its distinct k-word shingles as sorted fingerprints; with fewer words the whole sequence counts as one."""
    words, at = word_hashes(buf, offsets)
    runs = combined(words, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a:b - k + 1]))
        elif b > a:
            out.append(combined(words[a:b], b - a) ^ U64(b - a))
        else:
            out.append(np.zeros(0, U64))
    return out


def slices(column: pa.ChunkedArray | pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``most`` bytes (a longer text alone is a run): first row, last row, bytes, offsets. Null: empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if column.null_count:  # a null's bytes aren't defined
        lengths = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        keep = [data[a:a + n] for a, n in zip(offsets[:-1].tolist(), lengths.tolist(), strict=True) if n]
        data = np.concatenate(keep) if keep else np.zeros(0, np.uint8)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, len(column))
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j
