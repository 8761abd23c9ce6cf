"""Mergeable aggregate states: count, sum, distinct count (HLL sketch), quantile (KLL sketch); and exact ones as relations."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import _stored, ranked


def count_state() -> Column:
    return F.count(F.lit(1))


def sum_state(x: Column | str) -> Column:
    return F.sum(x)


def uniq_state(x: Column | str) -> Column:
    return F.hll_sketch_agg(x)


def quantile_state(x: Column | str) -> Column:
    return F.kll_sketch_agg_bigint((F.col(x) if isinstance(x, str) else x).cast("long"))


def count_merge(x: Column | str) -> Column:
    return F.sum(x)


def sum_merge(x: Column | str) -> Column:
    return F.sum(x)


def uniq_merge_state(x: Column | str) -> Column:
    return F.hll_union_agg(x)


def uniq_merge(x: Column | str) -> Column:
    return F.hll_sketch_estimate(F.hll_union_agg(x))


def quantile_merge_state(x: Column | str) -> Column:
    return F.kll_merge_agg_bigint(x)


def quantile_merge(x: Column | str, q: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(F.kll_merge_agg_bigint(x), F.lit(q))


def partial(df: DataFrame, keys: list[Column | str], users: str, money: str, duration: str) -> DataFrame:
    """A row per key with the four states of a block of rows."""
    return df.groupBy(*keys).agg(count_state().alias("events"), uniq_state(users).alias("users"), sum_state(money).alias("revenue"), quantile_state(duration).alias("p95"))


def rolled(states: DataFrame, keys: list[Column | str]) -> DataFrame:
    """States merged to coarser keys, still states."""
    return states.groupBy(*keys).agg(count_merge("events").alias("events"), uniq_merge_state("users").alias("users"), sum_merge("revenue").alias("revenue"), quantile_merge_state("p95").alias("p95"))


def finished(states: DataFrame, keys: list[Column | str], q: float = 0.95) -> DataFrame:
    """The figures; several rows of a key merge first, however many partial blocks wrote them."""
    return states.groupBy(*keys).agg(count_merge("events").alias("events"), uniq_merge("users").alias("users"), sum_merge("revenue").alias("revenue"), quantile_merge("p95", q).alias("p95"))


def exact_partial(df: DataFrame, keys: list[Column | str], user: str, duration: str) -> DataFrame:
    """Exact states of a block of rows, as rows (keys, of, user, duration, n): how often each user and each duration occurs under a key. They grow with what is distinct, and no key's state is ever one value."""
    who, long = df.schema[user].dataType, F.col(duration).cast("long")
    named = [("user", F.col(user), F.lit(None).cast("long")), ("duration", F.lit(None).cast(who), long)]
    rows = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(of).alias("of"), u.alias("user"), t.alias("duration")) for of, u, t in named])))
    return rows.groupBy(*rows.columns).agg(count_state().alias("n"))


def exact_rolled(states: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Exact states merged to coarser keys, still states."""
    return states.groupBy(*keys, "of", "user", "duration").agg(count_merge("n").alias("n"))


def exact_finished(states: DataFrame, keys: list[Column | str], q: float = 0.95) -> DataFrame:
    """(keys, events, users, p95): rows, distinct users, and the duration at place ceil(q * n), from 1, of a key, all exact."""
    own = _stored(exact_rolled(states, keys), "states")
    by = own.columns[:-4]
    is_user = F.col("of") == "user"
    counts = own.groupBy(*by).agg(F.sum(F.when(is_user, F.col("n"))).alias("events"), F.count("user").alias("users"), F.lit(None).cast("long").alias("p95"))
    place = F.greatest(F.ceil(F.col("n").cast("decimal(20,0)") * F.lit(Decimal(str(q)))), F.lit(1)) - 1
    at = ranked(own.where(~is_user), by, "duration", [place], times="n").select(*by, F.lit(None).cast("long").alias("events"), F.lit(None).cast("long").alias("users"), F.col("value").alias("p95"))
    return counts.unionByName(at).groupBy(*by).agg(*[F.max(c).alias(c) for c in ("events", "users", "p95")])
