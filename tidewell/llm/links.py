"""Connected components of a large edge table by alternating large-star and small-star rounds, each written to the checkpoint folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved
from .messages import local_components

HUB_SHARE = 1000


def contracted(edges: DataFrame) -> DataFrame:
    """A forest for each task's edges: rows (u, v) with v the smallest node of u's component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], 0
        for batch in batches:
            a.append(np.asarray(batch.column(0)))
            b.append(np.asarray(batch.column(1)))
            n += batch.num_rows
            if n > 2_000_000:  # a task's memory stays bounded
                yield out(np.concatenate(a), np.concatenate(b))
                a, b, n = [], [], 0
        if n:
            yield out(np.concatenate(a), np.concatenate(b))

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        u, v = local_components(a, b)
        return pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with m of least (u, m, n). Hubs, nodes of over one in HUB_SHARE edges and so fewer than that, are met by broadcast: a star of any size stays in the tasks that it lies in."""
    hubs = F.broadcast(least.where(F.col("n") > max(total // HUB_SHARE, 1)).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns) with at least one other node: component is the smallest node reachable. Each round at least lowers one node's label, and the rounds are of the order of log(n)**2 in all, so they end without a limit."""
    now, before = saved(contracted(edges), "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if mark["n"] == 0 or tuple(mark) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = tuple(mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both, least, 2 * mark["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, least, mark["n"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now, old = saved(small.distinct(), "edges"), now
        forget(old, large)
