"""Kinds of tables that are written by appending and read through a view: latest version, summed, aggregated states, and lookups."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], version: str | Column, deleted: str | None = None, sequence: str | None = None) -> DataFrame:
    """The row of the greatest version per key (the last ingested on ties, by ``sequence``), less keys whose last row is a deletion. Arg-max of whole rows: combined before the shuffle, no sort."""
    order = F.struct((F.col(version) if isinstance(version, str) else version).alias("v"), *([F.col(sequence).alias("s")] if sequence else []))
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    own = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    out = own.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`") for c in df.columns])
    return out.where(~F.coalesce(F.col(deleted).cast("boolean"), F.lit(False))).drop(deleted) if deleted else out


def latest_by(df: DataFrame, keys: list[str], version: str, values: list[str], deleted: str | None = None) -> DataFrame:
    """The same by arg-max aggregation: no sort, map-side combined."""
    cols = [*values, *([deleted] if deleted else [])]
    out = df.groupBy(*keys).agg(*[F.max_by(c, version).alias(c) for c in cols])
    return out.where(~F.coalesce(F.col(deleted).cast("boolean"), F.lit(False))).drop(deleted) if deleted else out


def summed(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of equal keys added up, in their own types."""
    kinds = dict(df.dtypes)
    return df.groupBy(*keys).agg(*[F.sum(v).cast(kinds[v]).alias(v) for v in values])


def dictionary_get(df: DataFrame, table: DataFrame, key: str, attrs: list[str], table_key: str | None = None, most_rows: int = 1_000_000, default: str = "") -> DataFrame:
    """Adds attributes of a table of unique keys; a miss gives the default. The table is broadcast only if it has at most ``most_rows`` rows, else the join is left to the planner."""
    lean = table.select(F.col(table_key or key).alias("_k"), *[F.col(a).alias(f"_{a}") for a in attrs])
    lean = F.broadcast(lean) if table.limit(most_rows + 1).count() <= most_rows else lean
    kinds = dict(table.dtypes)
    out = df.join(lean, df[key] == F.col("_k"), "left")
    return out.select(*[df[c] for c in df.columns], *[(F.coalesce(f"_{a}", F.lit(default)) if kinds[a] == "string" else F.col(f"_{a}")).alias(a) for a in attrs])


class Dictionary:
    """A lookup table that is read again once it is older than ``lifetime`` seconds."""

    def __init__(self, load: Callable[[], DataFrame], key: str, lifetime: float = 60):
        self.load, self.key, self.lifetime = load, key, lifetime
        self._at, self._table = float("-inf"), None

    def table(self) -> DataFrame:
        if time.monotonic() - self._at >= self.lifetime:
            if self._table is not None:
                self._table.unpersist()
            self._table, self._at = self.load().persist(), time.monotonic()
        return self._table

    def get(self, df: DataFrame, key: str, attrs: list[str]) -> DataFrame:
        return dictionary_get(df, self.table(), key, attrs, self.key)


def expired_out(df: DataFrame, at: str, now: Column, keep: str) -> DataFrame:
    """Row-wise retention: rows older than ``keep`` (such as '60 days') go."""
    return df.where(F.col(at) >= now - F.expr(f"INTERVAL {keep}"))


def expired_rolled_up(df: DataFrame, at: str, now: Column, keep: str, keys: list[str], sums: list[str]) -> DataFrame:
    """Aged rows are added up per key and day, newer ones stay as they are; other columns of the aged rows take any of their values."""
    old = F.col(at) < now - F.expr(f"INTERVAL {keep}")
    kinds = dict(df.dtypes)
    day = F.date_trunc("day", at).cast(kinds[at])
    rest = [c for c in df.columns if c not in {*keys, *sums, at}]
    rolled = df.where(old).groupBy(*keys, day.alias(at)).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in sums], *[F.any_value(c).alias(c) for c in rest])
    return df.where(~old).unionByName(rolled.select(df.columns))


def expired_cleared(df: DataFrame, at: str, now: Column, keep: str, column: str) -> DataFrame:
    """A column's values go once they are aged, the rows stay."""
    return df.withColumn(column, F.when(F.col(at) >= now - F.expr(f"INTERVAL {keep}"), F.col(column)))
