"""Binary messages for shuffles of many small numbers: one row per (map batch, part) instead of one per fingerprint.

``dealt`` sends documents' fingerprints to the part of their range; ``gathered`` reads a part back. Within a part 40 bits
of a fingerprint go along; with the part they stand for the whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SCHEMA = "part int, at int, keys binary, sizes binary, counts binary, low binary, mid binary"
_ARROW = pa.schema([("part", pa.int32()), ("at", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("low", pa.binary()), ("mid", pa.binary())])
U64 = np.uint64


def dealt(docs: Iterable[tuple[int, int, np.ndarray]], parts: list[int], flush: int = 500_000) -> Iterator[pa.RecordBatch]:
    """docs: (int64 key, size, uint64 fingerprints). parts: the values that hash partitioning sends to parts of their own."""
    keys: list[int] = []
    sizes: list[int] = []
    held: list[np.ndarray] = []
    n = 0
    for key, size, h in docs:
        if len(h):
            keys.append(key)
            sizes.append(size)
            held.append(h)
            n += len(h)
        if n >= flush:
            yield _packed(keys, sizes, held, parts)
            keys, sizes, held, n = [], [], [], 0
    if held:
        yield _packed(keys, sizes, held, parts)


def _packed(keys: list[int], sizes: list[int], held: list[np.ndarray], parts: list[int]) -> pa.RecordBatch:
    h = np.concatenate(held)
    doc = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held])
    at = (((h >> U64(32)) * U64(len(parts))) >> U64(32)).astype(np.uint16 if len(parts) < 1 << 16 else np.uint32)
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(len(parts) + 1))
    h, doc = h[order], doc[order]
    key, size = np.array(keys, np.int64), np.array(sizes, np.uint32)
    rows = []
    for i in range(len(parts)):
        a, b = bounds[i], bounds[i + 1]
        if a < b:
            first = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
            own = doc[a:b][first]
            rows.append((parts[i], i, key[own].tobytes(), size[own].tobytes(), np.diff(first, append=b - a).astype(np.uint32).tobytes(), h[a:b].astype(np.uint32).tobytes(), (h[a:b] >> U64(32)).astype(np.uint8).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part in this task: its number, then the 40-bit fingerprint, key and size of each entry."""
    held: dict[int, list] = {}
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
            held.setdefault(row[0], []).append(row[1:])
    for at in sorted(held):
        rows = held.pop(at)
        counts = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
        h = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows]).astype(U64)
        h |= np.concatenate([np.frombuffer(r[4], np.uint8) for r in rows]).astype(U64) << U64(32)
        key = np.repeat(np.concatenate([np.frombuffer(r[0], np.int64) for r in rows]), counts)
        size = np.repeat(np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows]), counts)
        del rows
        yield at, h, key, size


def shared(h: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the entries whose fingerprint occurs under two keys or more: indices (one per fingerprint and key, sorted by both), the run each lies in, and the count of keys per run."""
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    at = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(h) else order
    at = at[np.lexsort((key[at], h[at]))]
    if not len(at):
        return at, at, at
    newh = np.concatenate([[True], h[at][1:] != h[at][:-1]])
    at = at[newh | np.concatenate([[True], key[at][1:] != key[at][:-1]])]
    newh = np.concatenate([[True], h[at][1:] != h[at][:-1]])
    run = np.cumsum(newh) - 1
    n = np.bincount(run)
    keep = n[run] >= 2
    at, run = at[keep], run[keep]
    if not len(at):
        return at, at, at
    run = np.cumsum(np.concatenate([[True], run[1:] != run[:-1]])) - 1
    return at, run, np.bincount(run)


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component, by label propagation with pointer jumping."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (jump := new[new]).tolist() != new.tolist() if len(new) < 64 else not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new
