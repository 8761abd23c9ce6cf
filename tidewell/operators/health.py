"""Health questions as queries over metadata frames (job log, parts, replicas, errors, disks, queues)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio, readable_size


def slowest(log: DataFrame, since: Column | None = None, n: int = 10, took: str = "seconds", at: str = "began", key: str = "query_id") -> DataFrame:
    """The n slowest finished queries, those since a moment if given; ties by id."""
    done = log.where(F.col("state") == "finished")
    return (done.where(F.col(at) >= since) if since is not None else done).orderBy(F.desc(took), key).limit(n)


def running(log: DataFrame, took: str = "seconds") -> DataFrame:
    return log.where(F.col("state") == "running").orderBy(F.desc(took))


def errors_by_code(errors: DataFrame, codes: list[int] | None = None) -> DataFrame:
    """Errors counted by code and name with one of their messages, most first."""
    chosen = errors.where(F.col("code").isin(codes)) if codes else errors
    return chosen.groupBy("code", "name").agg(F.count(F.lit(1)).alias("n"), F.any_value("message").alias("sample"), F.max("at").alias("last")).orderBy(F.desc("n"), "code")


def stuck_tasks(queue: DataFrame, tries: int = 10) -> DataFrame:
    """Queue entries that were tried often and failed last time."""
    return queue.where((F.col("num_tries") > tries) & (F.coalesce("last_exception", F.lit("")) != "")).orderBy(F.desc("num_tries"))


def merges_and_mutations(merges: DataFrame, mutations: DataFrame) -> DataFrame:
    """Work under way: merges with their progress, mutations that aren't done."""
    a = merges.select(F.lit("merge").alias("kind"), "table", F.round("progress", 2).alias("progress"), F.lit(None).cast("string").alias("reason"))
    b = mutations.where(~F.col("is_done")).select(F.lit("mutation").alias("kind"), "table", F.lit(None).cast("double").alias("progress"), F.col("latest_fail_reason").alias("reason"))
    return a.unionByName(b)


def disks(frame: DataFrame, least_free: float = 0.15) -> DataFrame:
    free = F.try_divide(F.col("free_bytes").cast("double"), F.col("total_bytes"))
    return frame.select("name", readable_size("free_bytes").alias("free"), readable_size("total_bytes").alias("total"), F.round(free, 3).alias("share"), (free < least_free).alias("low"))


def backlog(queue: DataFrame, keys: list[str]) -> DataFrame:
    """Inserts that wait to be sent on."""
    return queue.groupBy(*keys).agg(F.sum("data_files").alias("files"), F.sum("data_compressed_bytes").alias("bytes"), F.max("error_count").alias("errors")).where("files > 0")


def compression(columns: DataFrame) -> DataFrame:
    """Columns by what they cost on disk."""
    return columns.select("name", "type", readable_size("compressed").alias("on_disk"), readable_size("uncompressed").alias("raw"), ratio(F.col("uncompressed"), F.col("compressed")).alias("ratio"), "compressed").orderBy(F.desc("compressed"), "name")
