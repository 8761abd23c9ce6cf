"""Overlaps between spans that are stored as relations, by bins of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 4096  # characters of a bin: a long text's spans are spread over its bins


def without_overlaps(new: DataFrame, kept: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = WIDTH) -> DataFrame:
    """Rows of ``new`` whose span shares no place with a span of ``kept`` on the same ``keys`` (half-open spans; touching ones don't share). A new span lies in the bin of its start; a kept one in every bin where a new one that reaches it can start, so that one equi-join on keys and bin decides, and each new row moves once. New rows with a null key or bound have nothing to meet and stay.

    Bins are as wide as the longest new span over eight at least, so that a kept span lies in ten bins at most besides those that it covers."""
    most = new.agg(F.max(F.col(end) - F.col(start)).alias("n")).first()["n"] or 0
    width = max(width, -(-most // 8))

    def bin_of(place: Column) -> Column:
        return F.floor(place / width).cast("long")

    x = new.withColumn("_bin", bin_of(F.col(start)))
    last = bin_of(F.greatest(F.col(end) - 1, F.col(start)))
    y = kept.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(F.sequence(bin_of(F.greatest(F.col(start) - most, F.lit(0))), last)).alias("_b")).distinct()
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_bin") == F.col("_b")]
    return x.join(y, [*on, F.col(start) < F.col("_e"), F.col("_s") < F.col(end)], "left_anti").drop("_bin")


def merged_relations(first: DataFrame, second: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """Both relations' spans, the first's before the second's: of the second those that share no place with one of the first."""
    return first.unionByName(without_overlaps(second, first, keys, width=width))
