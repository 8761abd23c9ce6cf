"""Helpers that the operators of this subpackage share: reading, checkpoint tables, partition counts."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's folder. From then on the session's Arrow batches hold BATCH_ROWS rows at most: rows carry whole texts, so that batches of the default 10,000 take hundreds of MB of a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. A local master without one gets a folder of its own; a cluster without one is refused, as its machines don't see each other's folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back: lineage ends there and an executor's loss can't undo it."""
    spark = df.sparkSession
    path = f"{_own_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def _own_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/tidewell/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*frames: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df.saved_at)


def forget_all(spark: SparkSession) -> None:
    """Delete all tables that this application's operators saved; for when their results are written."""
    _delete(spark, _own_root(spark))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the frame's plan (the file sizes for a plain scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, mb_each: int = 20, least: int = 12, most: int = 100_000) -> int:
    """So many partitions that each holds about ``mb_each`` MB of the input."""
    size = input_bytes(df)
    if size >= 1 << 55:  # the planner doesn't know: as many as the plan has now, or the session deals
        return max(least, min(most, df.rdd.getNumPartitions()), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(most, math.ceil(size / (mb_each << 20))))


HOT_SHARE = 1000


def with_class(rows: DataFrame, info: DataFrame, on: list[str], copies: str, may=None) -> DataFrame:
    """rows left-joined with their classes by the columns ``on``. Classes of over one in HOT_SHARE rows, fewer than that, are met by broadcast, and their rows, like those that can't have a class (``may`` is false), are spread over all tasks: no key gathers more than that share."""
    rest = [c for c in info.columns if c not in on]
    total = info.agg(F.sum(copies).alias("n")).first()["n"] or 0
    limit = max(total // HOT_SHARE, 1)
    hot = F.broadcast(info.where(F.col(copies) > limit).select(*[F.col(c).alias(f"_on_{c}") for c in on], *[F.col(c).alias(f"_hot_{c}") for c in rest], F.lit(True).alias("_is_hot")))
    cold = info.where(F.col(copies) <= limit).select(*[F.col(c).alias(f"_of_{c}") for c in on], *[F.col(c).alias(f"_cold_{c}") for c in rest], F.xxhash64(*on).alias("_met"))
    out = rows.join(hot, [F.col(c) == F.col(f"_on_{c}") for c in on], "left")
    alone = F.col("_is_hot").isNotNull() | (~F.coalesce(may, F.lit(False)) if may is not None else F.lit(False))
    out = out.withColumn("_meet", F.when(alone, F.xxhash64(*rows.columns)).otherwise(F.xxhash64(*on)))
    out = out.join(cold, [F.col("_meet") == F.col("_met"), *[F.col(c) == F.col(f"_of_{c}") for c in on]], "left")
    return out.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in rest])


def _murmur3_int(x: int) -> int:
    """Spark's hash() of one int column (Murmur3, seed 42)."""
    mask = 0xFFFFFFFF

    def rotl(v: int, r: int) -> int:
        return ((v << r) | (v >> (32 - r))) & mask

    k = rotl(((x & mask) * 0xCC9E2D51) & mask, 15) * 0x1B873593 & mask
    h = (rotl(42 ^ k, 13) * 5 + 0xE6546B64) & mask
    h ^= 4
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & mask
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & mask
    h ^= h >> 16
    return h - (1 << 32) if h >= 1 << 31 else h


def spread_keys(n: int) -> list[int]:
    """``n`` ints of which hash partitioning into ``n`` parts sends each to a part of its own."""
    found: dict[int, int] = {}
    x = 0
    while len(found) < n:
        found.setdefault(_murmur3_int(x) % n, x)
        x += 1
    return [found[i] for i in range(n)]


def fold_mod(col: str, m: int):
    """crc32 of the id's decimal text modulo m; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m
