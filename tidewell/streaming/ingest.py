"""Continuous ingest: micro-batches into a raw table and rollup states together, each block once."""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import start_of
from ..functions.states import partial, rolled
from ..sources.files import Files

FATAL = ("ParseException", "AnalysisException", "AccessControlException")


def retried(run: Callable[[], object], attempts: int = 5, first: float = 0.2, most: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Exponential waits with jitter; errors that a retry can't mend are raised at once."""
    for n in range(attempts):
        try:
            return run()
        except Exception as e:
            if n == attempts - 1 or type(e).__name__ in FATAL:
                raise
            wait = min(most, first * 2**n)
            sleep(wait / 2 + random.random() * wait / 2)
    return None


class Ledger:
    """Tokens of the last ``keep`` blocks, a small file each; a block whose token is there is a repetition."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 1000):
        self.files, self.path, self.keep = Files(spark, path), path, keep

    def known(self) -> list[str]:
        items = sorted(self.files.listed(self.path), key=lambda i: (i.modified, i.path))
        return [i.path.rsplit("/", 1)[1] for i in items]

    def holds(self, token: str) -> bool:
        return self.files.exists(f"{self.path}/{token}")

    def add(self, token: str) -> None:
        self.files.write(f"{self.path}/{token}", json.dumps({"at": time.time()}))
        for old in self.known()[:-self.keep]:
            self.files.delete(f"{self.path}/{old}")


def block_token(df: DataFrame) -> str:
    """A digest of a block's rows, whatever their order."""
    r = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return f"{r['n']}-{r['s']}-{r['x']}".replace("--", "-m")


@dataclass
class Rollup:
    """A raw table and its per-minute states. A block goes to both or counts as not written: outputs are folders named by the block's token, so a repetition overwrites its own files, and neither is read or merged before a mark says that both are there."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...] = ("tenant_id", "event_type")
    at: str = "event_time"
    users: str = "user_id"
    money: str = "revenue"
    duration: str = "duration_ms"

    def states_of(self, block: DataFrame) -> DataFrame:
        return partial(block, [*self.keys, start_of("minute", self.at).alias("minute")], self.users, self.money, self.duration)

    def write(self, block: DataFrame, token: str | None = None) -> bool:
        """False if the block was there already."""
        ledger = Ledger(self.spark, f"{self.path}/ledger")
        block = block.persist()
        try:
            token = token or block_token(block)
            if self._seen(ledger, token):
                return False
            block.write.mode("overwrite").parquet(f"{self.path}/raw/block={token}")
            self.states_of(block).write.mode("overwrite").parquet(f"{self.path}/states/block={token}")
            self._commit(ledger, token)
            return True
        finally:
            block.unpersist()

    def backfill(self, history: DataFrame, before: str, token: str = "backfill") -> bool:
        """Rolls up history before a cutoff once; the live stream takes what is at or after it."""
        ledger = Ledger(self.spark, f"{self.path}/ledger")
        if self._seen(ledger, token):
            return False
        self.states_of(history.where(F.col(self.at) < F.lit(before))).write.mode("overwrite").parquet(f"{self.path}/states/block={token}")
        self._commit(ledger, token)
        return True

    def _commit(self, ledger: Ledger, token: str) -> None:
        """From here on readers see the block, and a repetition of it is one."""
        ledger.files.write(f"{self.path}/commits/{token}", "")
        ledger.add(token)

    def _seen(self, ledger: Ledger, token: str) -> bool:
        if ledger.holds(token):
            return True
        if ledger.files.exists(f"{self.path}/commits/{token}"):  # a crash between the two marks
            ledger.add(token)
            return True
        return False

    def stream(self, source: DataFrame, checkpoint: str, since: str | None = None, every: str | None = None) -> StreamingQuery:
        """Micro-batches by ``every`` (such as '1 second'), or all that is there and an end. Late rows add partial rows to old minutes."""
        live = source.where(F.col(self.at) >= F.lit(since)) if since else source
        out = live.writeStream.foreachBatch(lambda df, n: self.write(df, f"batch-{n:012d}") and None).option("checkpointLocation", checkpoint)
        return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()

    def compact(self, what: str = "states") -> int:
        """Merges the blocks of ``states`` (equal keys too) or ``raw`` into one folder; returns how many. The new folder appears by a rename, from which on the list beside it hides the old ones; a crash leaves either view whole."""
        files, root = Files(self.spark, self.path), f"{self.path}/{what}"
        old = self._blocks(what)
        if len(old) < 2:
            return 0
        ledger = Ledger(self.spark, f"{self.path}/ledger")
        for b in old:
            self._seen(ledger, b.removeprefix("block="))
        name = f"block=merged-{uuid.uuid4().hex}"
        df = self.spark.read.option("basePath", root).parquet(*[f"{root}/{b}" for b in old]).drop("block")
        (rolled(df, [*self.keys, "minute"]) if what == "states" else df).write.parquet(f"{self.path}/_staging/{name}")
        files.write(f"{self.path}/replaced/{what}/{name}", json.dumps(old))
        files.move(f"{self.path}/_staging/{name}", f"{root}/{name}")
        for b in old:
            files.delete(f"{root}/{b}")
        files.delete(f"{self.path}/replaced/{what}/{name}")
        return len(old)

    def _blocks(self, what: str) -> list[str]:
        """Folders to read: blocks written to the end, but for those that a merged one has replaced."""
        files = Files(self.spark, self.path)
        there = files.folders(f"{self.path}/{what}")
        gone = {b for i in files.listed(f"{self.path}/replaced/{what}") if (name := i.path.rsplit("/", 1)[1]) in there for b in json.loads(files.read(i.path))}
        whole = {f"block={i.path.rsplit('/', 1)[1]}" for i in files.listed(f"{self.path}/commits")}
        return [b for b in there if b not in gone and (b in whole or b.startswith("block=merged-"))]

    def _read(self, what: str) -> DataFrame:
        root = f"{self.path}/{what}"
        return self.spark.read.option("basePath", root).parquet(*[f"{root}/{b}" for b in self._blocks(what)]).drop("block")

    def raw(self) -> DataFrame:
        return self._read("raw")

    def states(self) -> DataFrame:
        return self._read("states")


def first_blocks(headers: DataFrame, keep: int = 1000, expiry: timedelta = timedelta(hours=1)) -> DataFrame:
    """A stream's block headers without repetitions: of ``source``, ``token``, ``at`` (a timestamp) and any other columns, the rows whose token isn't among the source's last ``keep`` ones or was met longer than ``expiry`` ago.

    The tokens live in the stream's own state, restored on a restart: at most ``keep`` a source, gone once the watermark has passed
    the source's newest block by ``expiry``. A source's headers, a row a block however many rows that has, meet in one task and pass
    through it; headers without a source, a token or a time pass unprotected."""
    span = int(expiry.total_seconds() * 1000)

    def fresh(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        newest = max(known.values(), default=0)
        for frame in frames:
            new = []
            for token, at in zip(frame["token"], frame["at"], strict=True):
                ms = None if pd.isna(at) else int(at.timestamp() * 1000)
                if key[0] is None or token is None or ms is None:
                    new.append(True)
                    continue
                newest = max(newest, ms)
                new.append(token not in known or known[token] < ms - span)
                if new[-1]:
                    known.pop(token, None)  # to the end of the order
                    known[token] = ms
                    while len(known) > keep:
                        del known[next(iter(known))]
            yield frame[new]
        state.update((list(known), list(known.values())))
        state.setTimeoutTimestamp(max(newest + span, state.getCurrentWatermarkMs() + 1))

    return headers.withWatermark("at", f"{span} milliseconds").groupBy("source").applyInPandasWithState(fresh, headers.schema, "tokens array<string>, met array<long>", "append", GroupStateTimeout.EventTimeTimeout)


class Batches:
    """Rows of a client, written as a block once there are ``rows`` of them or the first has waited ``seconds``, with retries; a block's token stays the same through them, so that it is written once."""

    def __init__(self, spark: SparkSession, schema: str, write: Callable[[DataFrame, str], object], rows: int = 50_000, seconds: float = 1.0, clock: Callable[[], float] = time.monotonic, **retry: object):
        self.spark, self.schema, self.write, self.rows, self.seconds, self.clock, self.retry = spark, schema, write, rows, seconds, clock, retry
        self.held: list[tuple] = []
        self.since = 0.0

    def add(self, row: tuple) -> bool:
        """True if this row filled a block."""
        if not self.held:
            self.since = self.clock()
        self.held.append(row)
        return self.tick()

    def tick(self) -> bool:
        """Writes the block if it is due; for a timer, when no row comes."""
        due = len(self.held) >= self.rows or (self.held and self.clock() - self.since >= self.seconds)
        return self.flush() if due else False

    def flush(self) -> bool:
        if not self.held:
            return False
        df, token = self.spark.createDataFrame(self.held, self.schema), uuid.uuid4().hex
        retried(lambda: self.write(df, token), **self.retry)
        self.held = []  # only now: a block that couldn't be written is still held
        return True


def refreshed(spark: SparkSession, build: Callable[[], DataFrame], path: str) -> None:
    """Recomputes a result in full and swaps it in: readers see the old one or the new one."""
    files = Files(spark, path)
    build().write.mode("overwrite").parquet(f"{path}_new")
    files.delete(f"{path}_old")
    if files.exists(path):
        files.move(path, f"{path}_old")
    files.move(f"{path}_new", path)
    files.delete(f"{path}_old")
