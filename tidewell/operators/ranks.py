"""Exact order statistics by histograms that get finer around the wanted ranks.

The first pass counts each group and finds its bounds. Each further one counts the values of at most BINS slices of the interval
that a rank lies in, combined before they shuffle, and goes on with the slice that holds the rank; a slice whose least and
greatest value are the same is the answer. Slices are even in turns of value and of the logarithm of the distance to the
interval's begin, so that neither long tails nor close values take many passes. No pass sorts the input or holds more than BINS
rows for a group and rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch

BINS = 1 << 16
BROADCAST_ROWS = 100_000


def _stored(df: DataFrame, name: str = "ranks") -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _distance(a: Column, b: Column, kind: T.DataType) -> Column:
    """a - b as a double that falls nowhere as a grows, half of it for doubles (the whole might not be finite)."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return a.cast("double") / 2 - b.cast("double") / 2
    if isinstance(kind, T.DecimalType):
        return (a - b).cast("double")
    return (a.cast("decimal(20,0)") - b.cast("decimal(20,0)")).cast("double")


def _slice(v: Column, low: Column, high: Column, kind: T.DataType, logs: bool, bins: int) -> Column:
    far, whole = _distance(v, low, kind), _distance(high, low, kind)
    share = F.log1p(far) / F.log1p(whole) if logs else far / whole
    inside = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return inside
    infinite = F.lit(float("inf"))
    return F.when(F.isnan(v), bins + 1).when(v == infinite, bins).when(v == -infinite, -1).otherwise(inside)


def ranked(df: DataFrame, keys: list[str], value: str, ranks: list[Column], bins: int = BINS, times: str | None = None) -> DataFrame:
    """(keys, i, n, value, before): for each group the value at each of ``ranks`` and the count of smaller ones. With ``times``, a column of positive whole numbers, a row counts that often. A rank is a Column over the group's count ``n`` of rows with a value, from 0 on; one outside gives no row. Null keys are a group. Whole numbers, decimals and doubles; infinities are values, NaN is the greatest."""
    kind = df.schema[value].dataType
    own = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), (F.col(times) if times else F.lit(1)).cast("long").alias("_t"))
    plain = ~F.isnan("_v") & (F.abs("_v") < float("inf")) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(True)
    finite = F.when(plain, F.col("_v"))
    groups = own.groupBy(*keys).agg(F.sum("_t").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), r.cast("long").alias("rank")) for i, r in enumerate(ranks)])
    now = groups.select(*keys, "n", "low", "high", "least", "most", F.inline(wanted)).where(F.col("rank").between(0, F.col("n") - 1))
    now = _stored(now.withColumn("before", F.lit(0).cast("long")))
    settled, turn = F.col("least").eqNullSafe(F.col("most")), 0
    done = now.where(settled)
    while not (open_ := now.where(~settled)).isEmpty():
        few = open_.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        renamed = open_.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "i", "n", "rank", "before", "low", "high", "least", "most")
        on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_v").between(F.col("least"), F.col("most"))]
        met = own.join(F.broadcast(renamed) if few else renamed, on)
        cut = met.groupBy(*keys, "i", "n", "rank", F.col("before").alias("_before"), _slice(F.col("_v"), F.col("low"), F.col("high"), kind, turn % 2 == 1, bins).alias("_bin")).agg(F.sum("_t").alias("_c"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        to = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "i").orderBy("_bin"))
        placed = cut.withColumn("_to", to).where((F.col("rank") < F.col("_to")) & (F.col("rank") >= F.col("_to") - F.col("_c")))
        now = _stored(placed.select(*keys, "n", F.col("least").alias("low"), F.col("most").alias("high"), "least", "most", "i", "rank", (F.col("_to") - F.col("_c")).alias("before")))
        done, turn = done.unionByName(now.where(settled)), turn + 1
    return done.select(*keys, "i", "n", F.col("least").alias("value"), "before")


def _wide(df: DataFrame, keys: list[str], named: dict[int, str]) -> DataFrame:
    """One row a group: its values under their names."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(name) for i, name in named.items()])


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a double for each share by its name): the value at share * (n - 1) in order, in proportion between its neighbours."""
    ranks, named = [], {}
    for name, q in shares.items():
        place = F.col("n").cast("double") - 1
        named |= {len(ranks): f"{name}_a", len(ranks) + 1: f"{name}_b"}
        ranks += [F.floor(place * q), F.ceil(place * q)]
    got = ranked(df, keys, value, ranks)
    wide = got.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("value"))).cast("double").alias(name) for i, name in named.items()])

    def between(name: str, q: float) -> Column:
        place = (F.col("n").cast("double") - 1) * q
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        return F.when(a == b, a).otherwise(a + (b - a) * (place - F.floor(place))).alias(name)

    return wide.select(*keys, *[between(name, q) for name, q in shares.items()])


def nearest(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a value for each share by its name): the value at min(n - 1, floor(share * n)) in order."""
    got = ranked(df, keys, value, [F.least(F.col("n") - 1, F.floor(F.col("n") * q)) for q in shares.values()])
    return _wide(got, keys, dict(enumerate(shares)))


def kth_row(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The row at place k, from 0, in the order of numeric columns without nulls, each settling the ties of the one before; no row if there are fewer. Of rows that tie in all of them one is taken."""
    for c in order:
        got = ranked(df, [], c, [F.lit(k)]).first()
        if got is None:
            return df.limit(0)
        df, k = df.where(F.col(c) == F.lit(got["value"])), k - got["before"]
    return df.limit(1)
