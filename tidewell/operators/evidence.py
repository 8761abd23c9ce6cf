"""Evidence from decisions: dry runs, period roll-ups, latency reports, alerts, hash-chained logs, health states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import nearest


def finding_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"))


def dry_run(requests: DataFrame, made: DataFrame) -> DataFrame:
    """Per application and statement: requests evaluated and what enforcement would do."""
    seen = requests.groupBy(F.col("app_id").alias("app")).agg(F.count(F.lit(1)).alias("evaluated"))
    hits = made.join(requests.select("request_id", F.col("app_id").alias("app")), "request_id").groupBy("app", "statement").agg(F.count_if(F.col("action") == "redact").alias("would_redact"), F.count_if(F.col("action") == "block").alias("would_block"))
    return hits.join(seen, "app").select("app", "statement", "evaluated", "would_redact", "would_block")


def period_rollup(records: DataFrame, at: str = "at", unit: str = "month") -> DataFrame:
    """Per policy, version, period and statement."""
    used = F.coalesce(F.col("exception_used"), F.lit(False)) if "exception_used" in records.columns else F.lit(False)
    enforced = (F.col("mode") == "enforce") & ~used
    skipped = F.count_if("skipped") if "skipped" in records.columns else F.count_if(F.lit(False))
    return records.groupBy("policy_id", "policy_version", F.date_trunc(unit, at).cast("date").alias("period"), "statement").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(enforced & (F.col("action") == "redact")).alias("redacted"), F.count_if(enforced & (F.col("action") == "block")).alias("blocked"), F.count_if(F.col("mode") == "monitor").alias("monitor_only"), skipped.alias("skipped_checks"), F.count_if(used).alias("exceptions_used"))


def latency_report(df: DataFrame, keys: list[str], value: str, seconds: float | None = None) -> DataFrame:
    """Mean, least, most and nearest-index quantiles (the value at min(n - 1, floor(q * n)) in order), each found by ever finer histograms: no task holds a group's values."""
    own = df.where(F.col(value).isNotNull())
    n = F.count(F.lit(1))
    rate = [(n / seconds).alias("per_second")] if seconds else []
    whole = own.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), *rate)
    at = nearest(own, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "p50", "p95", "p99")
    met = whole.join(at, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]) if keys else whole.crossJoin(at)  # a row each
    return met.select(*keys, "n", "mean", "least", "most", "p50", "p95", "p99", *["per_second"] * bool(seconds))


def increase_over(df: DataFrame, series: list[str], at: str, value: str, seconds: int, slices: int = 12) -> DataFrame:
    """Adds ``increase``: a counter's growth over the ``seconds`` up to each sample, from the first sample in that time on; a fall is a restart and counts from zero. A series has one sample a time. Time is cut into slices of ``slices`` times the range; a slice's task also gets the samples of the range before it, so that a long series spreads over many tasks."""
    wide = seconds * slices
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    home = F.floor(micros / (wide * 1_000_000)).cast("long")
    late = micros >= (home + 1) * (wide * 1_000_000) - F.lit(seconds * 1_000_000)
    dealt = df.withColumn("_at", micros).withColumn("_s", F.explode(F.array_compact(F.array(home, F.when(late, home + 1))))).withColumn("_own", F.col("_s") == F.floor(F.col("_at") / (wide * 1_000_000)))
    w = Window.partitionBy(*series, "_s").orderBy("_at")
    before = F.lag(value).over(w)
    step = F.when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    total = dealt.withColumn("_step", step).withColumn("_sum", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    grown = F.col("_sum") - F.first("_sum").over(w.rangeBetween(-seconds * 1_000_000, Window.currentRow))
    return total.withColumn("increase", grown).where("_own").select(*df.columns, "increase")


def increase(df: DataFrame, series: list[str], at: str, value: str) -> DataFrame:
    """Growth of a counter since the last sample and its rate a second; a fall is a restart and counts from zero."""
    w = Window.partitionBy(*series).orderBy(at)
    before, when = F.lag(value).over(w), F.lag(at).over(w)
    grown = F.when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    seconds = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(when.cast("timestamp"))) / 1e6
    return df.select("*", grown.alias("increase"), F.try_divide(grown, seconds).alias("rate"))


def alerts(df: DataFrame, series: list[str], at: str, condition: Column, hold: str = "5 minutes") -> DataFrame:
    """Rows at which a condition has held without a break for so long."""
    w = Window.partitionBy(*series).orderBy(at)
    run = df.withColumn("_on", F.coalesce(condition, F.lit(False))).withColumn("_run", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w))
    since = F.min(F.when(F.col("_on"), F.col(at))).over(Window.partitionBy(*series, "_run"))
    return run.withColumn("since", since).where(F.col("_on") & (F.col(at) >= F.col("since") + F.expr(f"INTERVAL {hold}"))).drop("_on", "_run")


def replica_status(readonly: Column, session_expired: Column, delay: Column, active: Column, total: Column, most_delay: int = 300) -> Column:
    return F.when(readonly | session_expired, "READONLY").when(delay > most_delay, "LAGGING").when(active < total, "DEGRADED").otherwise("OK")


def unhealthy(status: Column | str) -> Column:
    return F.bool_or(F.col(status) != "OK" if isinstance(status, str) else status != "OK")


def hash_chained(df: DataFrame, chain: str, order: str, payload: str) -> DataFrame:
    """Adds ``prev_hash`` and ``hash`` = sha256(prev_hash + payload) along each chain; chains run side by side, one is a sequence by nature and streams through its task."""
    columns = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", prev_hash string, hash string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = object(), ""
        for frame in frames:
            before, own = [], []
            for c, p in zip(frame[chain], frame[payload], strict=True):
                if c != now:
                    now, last = c, ""
                before.append(last)
                last = hashlib.sha256((last + (p or "")).encode()).hexdigest()
                own.append(last)
            yield frame[columns].assign(prev_hash=before, hash=own)

    return df.repartition(chain).sortWithinPartitions(chain, order).mapInPandas(run, schema)


def numbered(df: DataFrame, chain: str, order: str, name: str = "i") -> DataFrame:
    """Adds a chain's row numbers from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(chain).orderBy(order)))


def chain_breaks(df: DataFrame, chain: str, number: str, payload: str) -> DataFrame:
    """(chain, number, broken): the first row of each chain that doesn't prove itself, if any. Rows are numbered from 1 in each chain. A row is proven by its own hash over ``prev_hash`` and payload (``edited`` where that fails) and by its ``prev_hash``, which is the hash of the row before (``unlinked``; ``missing`` where that row isn't there). Neighbours meet by chain and number, so nothing is computed in sequence and a chain of any length spreads over all tasks. Rows cut off a chain's end leave no trace in it."""
    own = F.sha2(F.concat(F.col("prev_hash"), F.coalesce(F.col(payload), F.lit(""))), 256)
    rows = df.select(chain, number, "prev_hash", "hash", (F.coalesce(own == F.col("hash"), F.lit(False))).alias("whole"))
    before = rows.select(F.col(chain).alias("_c"), (F.col(number) + 1).alias("_n"), F.col("hash").alias("_hash"), F.lit(True).alias("_there"))
    met = rows.join(before, [F.col(chain) == F.col("_c"), F.col(number) == F.col("_n")], "left")
    first = F.col(number) == 1
    wrong = (
        F.when(~first & F.col("_there").isNull(), "missing")
        .when(~F.col("prev_hash").eqNullSafe(F.when(first, F.lit("")).otherwise(F.col("_hash"))), "unlinked")
        .when(~F.col("whole"), "edited")
    )
    return met.withColumn("broken", wrong).where("broken IS NOT NULL").groupBy(chain).agg(F.min(F.struct(number, "broken")).alias("f")).select(chain, f"f.{number}", "f.broken")
