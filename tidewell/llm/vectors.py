"""Near-duplicate vectors by an epsilon grid order join.

Vectors of unit length lie within eps = sqrt(2 - 2 * cosine) of each other exactly where their cosine is high enough. They
are sorted by grid cells on the leading principal dimensions and cut into groups of consecutive vectors; pairs of groups
whose boxes on those dimensions are farther apart than eps are skipped, the others are joined by recursion over sequence
halves with the same test. A task returns counts and a spanning forest of its links, never the pairs.

Equal vectors are one class with a multiplicity. Cosines are computed in double precision; those within 1e-9 of the
threshold are computed again as dot(a, b) / sqrt(dot(a, a) * dot(b, b)).

Defined cases: vectors that are null, empty, zero or hold a null or a non-finite component link with nothing, as do rows
with a null id (their component is null and they aren't kept); shorter vectors count as padded with zeros; rows that share
an id share its links; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, with_class
from .links import components
from .messages import local_components

LEADING = 8
GROUP = 8_192  # vectors of a sorted group
LEAF = 512


def principal(vectors: DataFrame, dims: int) -> np.ndarray:
    """The leading eigenvectors (columns) of the covariance of unit vectors; one sum per matrix entry reaches the driver."""
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + dims + len(upper[0]))
        for batch in batches:
            if batch.num_rows:
                x = unit(batch.column(0).to_pylist(), dims)
                total += np.concatenate([[len(x)], x.sum(0), (x.T @ x)[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

    got = np.zeros(1 + dims + len(upper[0]))
    for r in vectors.select("raw").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        got[r["i"]] = r["v"]
    n, mean, square = max(got[0], 1), got[1:1 + dims], np.zeros((dims, dims))
    square[upper] = got[1 + dims:]
    square = square + np.triu(square, 1).T
    return np.linalg.eigh(square / n - np.outer(mean, mean) / n / n)[1][:, ::-1][:, :LEADING]


def unpacked(raw: list[bytes], dims: int) -> np.ndarray:
    x = np.zeros((len(raw), dims))
    for i, b in enumerate(raw):
        v = np.frombuffer(b, np.float64)
        x[i, :len(v)] = v
    return x


def unit(raw: list[bytes], dims: int) -> np.ndarray:
    x = unpacked(raw, dims)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Joined:
    """The join of two sorted sequences (or of one with itself): counts and link edges."""

    def __init__(self, a: np.ndarray, b: np.ndarray | None, axes: np.ndarray, cosine: float, weight_a: np.ndarray, weight_b: np.ndarray | None):
        self.a, self.same = a, b is None
        self.b = a if b is None else b
        self.pa = a @ axes
        self.pb = self.pa if b is None else b @ axes
        self.cosine, self.eps2 = cosine, 2 - 2 * cosine + 1e-9
        self.wa, self.wb = weight_a, weight_a if b is None else weight_b
        self.na, self.nb = np.zeros(len(a), np.int64), np.zeros(len(self.b), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        if len(self.a) and len(self.b):
            self.join(0, len(self.a), 0, len(self.b))

    def distant(self, i: int, j: int, k: int, m: int) -> bool:
        x, y = self.pa[i:j], self.pb[k:m]
        gap = np.maximum(0, np.maximum(y.min(0) - x.max(0), x.min(0) - y.max(0)))
        return float((gap * gap).sum()) > self.eps2

    def join(self, i: int, j: int, k: int, m: int) -> None:
        if (self.same and m <= i) or self.distant(i, j, k, m):
            return
        if max(j - i, m - k) <= LEAF:
            return self.leaf(i, j, k, m)
        if j - i >= m - k:
            mid = (i + j) // 2
            if self.same and (i, j) == (k, m):
                self.join(i, mid, i, mid)
                self.join(i, mid, mid, j)
                self.join(mid, j, mid, j)
                return
            self.join(i, mid, k, m)
            self.join(mid, j, k, m)
        else:
            mid = (k + m) // 2
            self.join(i, j, k, mid)
            self.join(i, j, mid, m)

    def leaf(self, i: int, j: int, k: int, m: int) -> None:
        c = self.a[i:j] @ self.b[k:m].T
        hit = c >= self.cosine
        for x, y in zip(*np.nonzero(np.abs(c - self.cosine) < 1e-9), strict=True):
            u, v = self.a[i + x], self.b[k + y]
            hit[x, y] = float(u @ v) / np.sqrt(float(u @ u) * float(v @ v)) >= self.cosine
        if self.same:
            hit &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
        if hit.any():
            self.na[i:j] += hit @ self.wb[k:m]
            self.nb[k:m] += self.wa[i:j] @ hit
            x, y = np.nonzero(hit)
            u, v = local_components(x + i, y + k + len(self.a) * (not self.same))
            self.edges.append((u, v))


def linked(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.coalesce(good, F.lit(False)), v).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # trailing zeros don't count, nor does the sign of a zero
            out = [(np.trim_zeros(np.array(x), "b") + 0.0).tobytes() if x else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "raw"])

    rows = saved(rows.mapInArrow(pack, "id long, raw binary"), "vectors")
    classes = saved(rows.where(F.col("raw").isNotNull()).groupBy("raw").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    top = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("raw")).alias("bytes")).first()
    plain = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    if not top["n"]:
        return plain
    dims = top["bytes"] // 8
    axes = principal(classes, dims)
    cell = float(np.sqrt(2 - 2 * cosine))
    lead = axes.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = unit(batch.column(0).to_pylist(), dims) @ axes
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(p), pa.list_(pa.float64())), pa.array(list(np.floor(p / cell).astype(np.int32)), pa.list_(pa.int32()))], ["raw", "rep", "copies", "p", "cells"])

    groups = max(1, -(-top["n"] // GROUP))
    placed = classes.mapInArrow(place, "raw binary, rep long, copies long, p array<double>, cells array<int>")
    order = [F.col("cells")[i] for i in range(lead)] + [F.col("p")[0], F.col("rep")]
    ordered = saved(placed.repartitionByRange(groups, *order).withColumn("g", F.spark_partition_id()), "ordered")
    found = ordered.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[f(F.col("p")[i]).alias(f"{n}{i}") for i in range(lead) for n, f in (("lo", F.min), ("hi", F.max))]).orderBy("g").collect()  # a row per partition
    # consecutive partitions make up a group, whatever number of partitions the session deals
    bounds: list[dict] = []
    for r in found:
        if not bounds or bounds[-1]["n"] + r["n"] > GROUP * 3 // 2:
            bounds.append({"g": [], "n": 0, "lo": np.full(lead, np.inf), "hi": np.full(lead, -np.inf)})
        own = bounds[-1]
        own["g"].append(r["g"])
        own["n"] += r["n"]
        own["lo"] = np.minimum(own["lo"], [r[f"lo{i}"] for i in range(lead)])
        own["hi"] = np.maximum(own["hi"], [r[f"hi{i}"] for i in range(lead)])
    boxes = spark.sparkContext.broadcast((np.array([b["lo"] for b in bounds]), np.array([b["hi"] for b in bounds])))  # a box for GROUP vectors
    group_of = spark.createDataFrame([(g, i) for i, b in enumerate(bounds) for g in b["g"]], "g int, i int")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = boxes.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                gap = np.maximum(0, np.maximum(lo[i:] - hi[i], lo[i] - hi[i:]))
                j = i + np.flatnonzero((gap * gap).sum(1) <= cell * cell + 1e-9)
                k = i * len(lo) + j
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(j), i), j[1:]]), pa.int32()), pa.array(np.concatenate([k, k[1:]]), pa.int64()), pa.array(np.repeat([0, 1], [len(j), len(j) - 1]), pa.int32())], ["i", "k", "side"])

    work = saved(spark.range(len(bounds)).withColumnRenamed("id", "i").mapInArrow(near, "i int, k long, side int"), "work")  # pairs of groups that may link
    n_parts = max(1, min(work.where("side = 0").count(), 20_000))
    dealt = ordered.select("g", "raw", "rep", "copies", "cells", F.col("p")[0].alias("p0")).join(F.broadcast(group_of), "g").join(work, "i")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        for batch in batches:
            for k, side, raw, rep, copies in zip(*(batch.column(n).to_pylist() for n in ("k", "side", "raw", "rep", "copies")), strict=True):
                if k != now:
                    if now is not None:
                        yield from done(held)
                    now, held = k, ([], [])
                held[side].append((raw, rep, copies))
        if now is not None:
            yield from done(held)

    def done(held: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        x, y = held
        got = Joined(unit([r[0] for r in x], dims), unit([r[0] for r in y], dims) if y else None, axes, cosine, np.array([r[2] for r in x]), np.array([r[2] for r in y]) if y else None)
        ids = np.array([r[1] for r in [*x, *y]], np.int64)
        n = got.na + got.nb if got.same else np.concatenate([got.na, got.nb])
        root = np.arange(len(ids))
        if got.edges:
            u, r = local_components(*(np.concatenate(e) for e in zip(*got.edges, strict=True)))
            root[u] = r
        hit = np.flatnonzero(n)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(n[hit]), pa.array(ids[root[hit]])], ["u", "n", "v"])

    found = saved(dealt.repartition(n_parts, "k").sortWithinPartitions("k", "side", *[F.col("cells")[i] for i in range(lead)], "p0", "rep").select("k", "side", "raw", "rep", "copies").mapInArrow(join, "u long, n long, v long"), "links")
    where = components(found.select("u", "v").where("u <> v"))
    counts = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    info = classes.join(counts, "rep", "left").join(where.withColumnRenamed("node", "rep"), "rep", "left")
    whole = with_class(rows, info, ["raw"], "copies", F.col("raw").isNotNull())
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return whole.select(F.col("id").alias(id_col), F.when(F.col("rep").isNotNull(), F.coalesce("n", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op3_ego_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
