"""Reproducible global shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Row numbers come from one global sort; the permutation maps number r to position p, and shard = p mod shards,
slot = p div shards. Both directions are computable from (rows, seed, shards) alone, without a table.

Defined cases: null ids sort first, null texts have no bytes (size 8, crc 0), rows that tie in (id, crc, size) are
interchangeable, an empty table gives no rows, and columns besides the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions_for, saved, table
from .words import fmix

ROUNDS = 6


def _keys(seed: int) -> np.ndarray:
    return fmix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _half_bits(rows: int) -> int:
    return max(1, ((max(rows, 2) - 1).bit_length() + 1) // 2)


def _pass(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> bits, x & mask
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (fmix(left ^ k) & mask), left
        else:
            left, right = right, left ^ (fmix(right ^ k) & mask)
    return (left << bits) | right


def permuted(numbers: np.ndarray, rows: int, seed: int = 42, back: bool = False) -> np.ndarray:
    """Positions of row numbers in 0..rows-1 (with ``back`` the numbers of positions): values outside the range walk on along their cycle."""
    half, keys = _half_bits(rows), _keys(seed)
    out = _pass(numbers.astype(np.uint64), half, keys, back)
    while (away := out >= np.uint64(rows)).any():
        out[away] = _pass(out[away], half, keys, back)
    return out.astype(np.int64)


def row_at(shard: int, slot: int, rows: int, shards: int, seed: int = 42) -> int:
    """The global row number that lies in a shard's slot."""
    return int(permuted(np.array([slot * shards + shard]), rows, seed, back=True)[0])


def position(number: Column | str, rows: int, seed: int = 42) -> Column:
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(permuted(s.to_numpy(), rows, seed))

    return run(number)


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Adds ``row_number`` (0-based in the given order, gapless) and returns the count of rows. One range shuffle; the driver sees one count per partition."""
    spark = df.sparkSession
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions_for(df, 64), *order, "_tie").sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    held = saved(ranged.drop("_tie").withColumn("_part", F.shiftright(at, 33).cast("int")).withColumn("_at", at.bitwiseAND((1 << 33) - 1)), "numbered")
    offsets, total = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(offsets, "_part int, _start long"))  # a row per partition
    return held.join(starts, "_part").withColumn("row_number", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"), total


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, row_number, shard, slot): counts per shard differ by one at most and slots have no gaps."""
    lean = docs.select(F.col(id_col), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    rows, total = numbered(lean, [id_col, "text_crc32", "size"])
    at = rows.withColumn("_p", position("row_number", total, seed))
    return at.withColumn("shard", (F.col("_p") % shards).cast("int")).withColumn("slot", F.expr(f"_p div {shards}")).drop("_p")


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write whole documents (unique ids) as one folder a shard; its files are runs of slots, in order, and however few shards there are all tasks write."""
    placed = docs.join(assigned.select(id_col, "shard", "slot"), id_col)
    placed.repartitionByRange(partitions_for(docs, 128), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
