"""Running queries: typed parameters, time-range macros, tags, limits, streamed and typed results, a job log, a projection router."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.status import SparkJobInfo


def parameterised(spark: SparkSession, sql: str, **args: object) -> DataFrame:
    """:name markers are bound as typed values, IDENTIFIER(:name) as names."""
    return spark.sql(sql, args=args)


def time_filter(column: str, start: object, end: object) -> Column:
    return (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end))


@contextmanager
def tagged(spark: SparkSession, comment: str, **settings: str) -> Iterator[None]:
    """Settings and a description that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in settings}
    spark.sparkContext.setJobDescription(comment)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        spark.sparkContext.setJobDescription(None)


class OverLimit(RuntimeError):
    pass


class TooLarge(RuntimeError):
    pass


LOG: list[dict] = []
_NO_JOB = SparkJobInfo(0, [], "")


def bounded(df: DataFrame, most_bytes: int = 2 << 30) -> DataFrame:
    """The frame, if the planner doesn't expect its result to take more than so many bytes; for results that go to the driver."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > most_bytes:
        raise TooLarge(f"the result may take {size} bytes; {most_bytes} are allowed")
    return df


def limited(spark: SparkSession, run: Callable[[], object], seconds: float = 10, query_id: str | None = None, progress: Callable[[int, int], object] | None = None, every: float = 0.2) -> object:
    """Runs a query; its jobs are cancelled once it takes longer. ``progress`` is told the tasks done and the tasks known so far. The log gets a row for it."""
    name = query_id or f"query-{uuid.uuid4().hex[:12]}"
    spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(name)

    ended = threading.Event()

    def watch() -> None:
        tracker = spark.sparkContext.statusTracker()
        while not ended.wait(every):
            stages = [i for job in tracker.getJobIdsForGroup(name) for s in (tracker.getJobInfo(job) or _NO_JOB).stageIds if (i := tracker.getStageInfo(s))]
            progress(sum(i.numCompletedTasks for i in stages), sum(i.numTasks for i in stages))

    timer, began = threading.Timer(seconds, stop), time.time()
    timer.start()
    if progress:
        threading.Thread(target=watch, daemon=True).start()
    state = "failed"
    try:
        out = run()
        state = "finished"
        return out
    except Exception as e:
        if late.is_set():
            state = "cancelled"
            raise OverLimit(f"{name} took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        ended.set()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        LOG.append({"query_id": name, "began": began, "seconds": time.time() - began, "state": state})


def query_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x["query_id"], x["began"], x["seconds"], x["state"]) for x in LOG], "query_id string, began double, seconds double, state string")


def streamed(df: DataFrame) -> Iterator[Row]:
    """Rows as they come, a partition in memory at a time."""
    return df.toLocalIterator(prefetchPartitions=True)


def typed(df: DataFrame, kind: type) -> list:
    """A small result as dataclass objects."""
    names = [f.name for f in fields(kind)]
    return [kind(*(r[n] for n in names)) for r in df.select(*names).collect()]


@dataclass(frozen=True)
class Copy:
    """A copy of a table sorted by other columns."""

    read: Callable[[], DataFrame]
    order: tuple[str, ...]


def routed(copies: list[Copy], equal_to: dict[str, object]) -> DataFrame:
    """The copy whose sort key starts with the most of the filtered columns, filtered."""
    def prefix(c: Copy) -> int:
        n = 0
        for k in c.order:
            if k not in equal_to:
                break
            n += 1
        return n

    df = max(copies, key=prefix).read()
    for k, v in equal_to.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
