"""Centroid clustering in whole numbers, exact whatever the order of the sums.

Vectors are packed once into blocks of integers. A round is one job: tasks expand squared distances as
|x|^2 - 2 x.c + |c|^2, the middle term as one float64 matrix product a block, and ``treeAggregate`` combines the sums and counts
of each centroid on the executors; the driver gets one sum a centroid and component. The product of a row is exact in
float64, in any order of its additions, where components * (largest |x| + largest |c|)^2 is below 2^53; rows beyond that go by
64-bit integers below 2^63 and by Python's integers above. The rounds end early where one changes no centroid, as the
following ones then can't either.

Defined cases: vectors that are null, have another number of components or hold a null or a non-finite one are left out;
repeated rows each count, also as first centroids; rows of one id that tie by hash come in the order of their components; rows
without an id take part, but become first centroids only after all others; with fewer vectors than centroids each vector is
one; without vectors the result is empty. Distances and sums that a long can't hold are null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

EXACT, LONG = 1 << 53, 1 << 63


def whole(rows: np.ndarray, scale: int) -> tuple[str, bytes]:
    """floor(scale * x) of float64 rows, exactly, in the narrowest of int16, int32 and int64, or as decimal text."""
    if not rows.size or np.abs(rows).max() < EXACT / scale:
        x = np.floor(rows * scale).astype(np.int64)  # a power of two: the product is exact
        top = int(np.abs(x).max()) if x.size else 0
        kind = "int16" if top < 1 << 15 else "int32" if top < 1 << 31 else "int64"
        return kind, x.astype(kind).tobytes()
    exact = [math.floor(v * scale) if abs(v) < EXACT else int(v) * scale for v in rows.ravel().tolist()]  # beyond 2^53 there are whole numbers only
    return "text", ",".join(map(str, exact)).encode()


def unpacked(kind: str, raw: bytes, dims: int) -> np.ndarray:
    """A block's rows as int64, or as Python's integers where those are needed."""
    if kind != "text":
        return np.frombuffer(raw, kind).reshape(-1, dims).astype(np.int64)
    return np.array([int(v) for v in raw.split(b",")], object).reshape(-1, dims)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c: float64 or int64 where the whole block allows it, else Python's integers."""
    dims = c.shape[1]
    reach = int(np.abs(c).max())
    near = np.abs(x).max(1) if len(x) else np.zeros(0, np.int64)
    top = int(near.max()) if len(x) else 0
    if dims * (top + reach) ** 2 < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        out = a @ b.T
        out *= -2
        out += (a * a).sum(1)[:, None]
        out += (b * b).sum(1)[None, :]
        return out
    if dims * (top + reach) ** 2 < LONG:
        a, b = x.astype(np.int64), c.astype(np.int64)
        return np.stack([((a - row) ** 2).sum(1) for row in b], 1)
    out = np.empty((len(x), len(c)), object)
    fits = np.array([dims * (int(v) + reach) ** 2 < EXACT for v in near])
    if fits.any():  # a wide row keeps its narrow neighbours from nothing
        out[fits] = distances(x[fits].astype(np.int64), c).astype(np.int64).astype(object)
    wide, far = x[~fits].astype(object), c.astype(object)
    out[~fits] = np.stack([((wide - row) ** 2).sum(1) for row in far], 1)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first of its nearest rows of c, and the squared distance."""
    d = distances(x, c)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def sums(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums of the rows of each cluster as Python's integers."""
    top = int(np.abs(x).max()) if len(x) else 0
    if len(x) * top < EXACT:
        member = np.zeros((k, len(x)))
        member[at, np.arange(len(x))] = 1
        return (member @ x.astype(np.float64)).astype(np.int64).astype(object)
    out = np.zeros((k, x.shape[1]), object)
    for i in range(k):
        out[i] += x[at == i].astype(object).sum(0)
    return out


def packed(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(ids, kind, raw): blocks of kept vectors, of an Arrow batch each."""
    v = F.col(vector_col).cast("array<double>")
    good = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).alias("id"), v.alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kind, raw = whole(batch.column(1).flatten().to_numpy().reshape(-1, dims), scale)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_pylist()], pa.list_(batch.column(0).type)), pa.array([kind]), pa.array([raw], pa.binary())], ["ids", "kind", "raw"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(pack, f"ids array<{kind}>, kind string, raw binary")


def first_centroids(blocks: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The k vectors of the smallest sha256 of ``<seed>:<id>``, in its order; no task passes on more than k rows."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            for ids, kind, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys = [(i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()) for i in ids]
                last = sorted(keys)[min(k, len(keys)) - 1]
                x = unpacked(kind, raw, dims)
                best += [(*key, ",".join(map(str, x[n].tolist()))) for n, key in enumerate(keys) if key <= last]
                best = sorted(best)[:k]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*best, strict=True)) or [(), (), ()], (pa.bool_(), pa.string(), pa.string()), strict=True)], ["nameless", "hash", "x"])

    found = blocks.mapInArrow(least, "nameless boolean, hash string, x string").orderBy("nameless", "hash", "x").limit(k).collect()
    return np.array([[int(v) for v in r["x"].split(",")] for r in found], object).reshape(-1, dims)


def narrow(c: np.ndarray) -> np.ndarray:
    """Centroids as int64 where they fit."""
    return c.astype(np.int64) if all(abs(v) < 1 << 62 for v in c.ravel().tolist()) else c


def totals(blocks: DataFrame, c: np.ndarray) -> tuple[list[int], np.ndarray, list[int]]:
    """For each centroid the count of its vectors, their componentwise sum and their summed distance."""
    k, dims = c.shape

    def added(held, block):
        counts, total, inertia = held
        x = unpacked(block["kind"], bytes(block["raw"]), dims)
        at, d = nearest(x, c)
        own = [sum(map(int, d[at == i].tolist())) for i in range(k)]
        return [a + b for a, b in zip(counts, np.bincount(at, minlength=k).tolist(), strict=True)], total + sums(x, at, k), [a + b for a, b in zip(inertia, own, strict=True)]

    def joined(a, b):
        return [x + y for x, y in zip(a[0], b[0], strict=True)], a[1] + b[1], [x + y for x, y in zip(a[2], b[2], strict=True)]

    return blocks.select("kind", "raw").rdd.treeAggregate(([0] * k, np.zeros((k, dims), object), [0] * k), added, joined)


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every kept vector. ``scale`` is a power of two."""
    if scale < 1 or scale & (scale - 1):
        raise ValueError("the scale must be a power of two, so that scaling is exact")
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    blocks = saved(packed(vectors, dims, scale, id_col, vector_col), "blocks")
    c = narrow(first_centroids(blocks, k, seed, dims))
    if not len(c):
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        counts, total, _ = totals(blocks, c)
        new = narrow(np.array([[v // n for v in row] if n else old for n, row, old in zip(counts, total.tolist(), c.tolist(), strict=True)], object))
        if (new == c).all():
            break
        c = new
    inertia = totals(blocks, c)[2]
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    every = sum(inertia)

    def long(v: int) -> int | None:
        return int(v) if v < LONG else None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                at, d = nearest(unpacked(batch.column(1)[n].as_py(), batch.column(2)[n].as_py(), dims), c)
                ids, at = batch.column(0).slice(n, 1).flatten(), at.tolist()
                rest = [long(v) for v in d.tolist()], [long(inertia[i]) for i in at], [long(every)] * len(at)
                yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), *[pa.array(v, pa.int64()) for v in rest], pa.array([digests[i] for i in at])], ["id", "cluster", "distance", "cluster_inertia", "inertia", "sha"])

    return blocks.mapInArrow(place, schema)


def op11_exact_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))
