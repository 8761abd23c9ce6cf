"""Synthetic clickstream, shops and codec series from a number range; the same arguments give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.city import unsigned_mod, with_hashes
from ..functions.scalars import hash_uuid, multi_if, pick

# Domains of the generated columns.
EVENT_MIX = ["page_view", "page_view", "page_view", "page_view", "click", "click", "add_to_cart", "purchase", "signup", "search"]
LIVE_MIX = ["page_view", "page_view", "page_view", "click", "add_to_cart", "purchase", "search"]
COUNTRIES = ["US", "DE", "IN", "BR", "GB", "FR", "JP", "ID", "NG", "CA"]
DEVICES = ["desktop", "mobile", "mobile", "tablet"]
SHOP_FIRST = ["Acme", "Nordic", "Sunrise", "Blue", "Urban", "Pixel", "Green", "Metro"]
SHOP_SECOND = ["Outfitters", "Books", "Gadgets", "Home", "Coffee", "Sports"]
EVENT_COLUMNS = ["event_time", "tenant_id", "user_id", "session_id", "event_type", "country", "device", "url", "duration_ms", "revenue"]


def _moment(start: str, millis):
    return F.timestamp_millis(F.unix_millis(F.to_timestamp(F.lit(start))) + millis)


def _hashed(df: DataFrame, number: str, seeds: range) -> DataFrame:
    """Columns _h and _h<seed>: hashes of the number alone and with each seed."""
    return with_hashes(df, number, _h=None, **{f"_h{k}": k for k in seeds})


def numbers(spark: SparkSession, rows: int, offset: int = 0) -> DataFrame:
    return spark.range(offset, offset + rows).withColumnRenamed("id", "number")


def clickstream(spark: SparkSession, rows: int, seed: int = 0, start: str = "2026-06-01 00:00:00") -> DataFrame:
    """90 days of events from ``start`` plus seed * 90 days; shop numbers are cubically skewed towards 1, money only on purchases."""
    n = F.col("number")
    span = 90 * 86_400_000
    u = unsigned_mod("_h1", 1_000_000) / F.lit(1_000_000.0)
    base = _hashed(numbers(spark, rows, seed * 1_000_000_000), "number", range(9)).select(
        _moment(start, F.lit(seed * span) + unsigned_mod("_h0", span)).alias("event_time"),
        (F.lit(1) + F.floor(F.pow(u, F.lit(3)) * 1000)).cast("int").alias("tenant_id"),
        unsigned_mod("_h2", 5_000_000).alias("user_id"),
        hash_uuid(n).alias("session_id"),
        pick(EVENT_MIX, unsigned_mod("_h3", 10)).alias("event_type"),
        pick(COUNTRIES, unsigned_mod("_h4", 10)).alias("country"),
        pick(DEVICES, unsigned_mod("_h5", 4)).alias("device"),
        F.concat(F.lit("/product/"), unsigned_mod("_h6", 20_000).cast("string")).alias("url"),
        unsigned_mod("_h7", 30_000).cast("int").alias("duration_ms"),
        (unsigned_mod("_h8", 50_000).cast("decimal(12,0)") / F.lit(100)).cast("decimal(12,2)").alias("_money"),
    )
    return base.withColumn("revenue", F.when(F.col("event_type") == "purchase", F.col("_money")).otherwise(F.lit(0).cast("decimal(12,2)"))).drop("_money")


def shops(spark: SparkSession, rows: int = 1000) -> DataFrame:
    n = F.col("number")
    return _hashed(numbers(spark, rows), "number", range(0)).select(
        (n + 1).cast("int").alias("tenant_id"),
        F.concat(pick(SHOP_FIRST, n % 8), F.lit(" "), pick(SHOP_SECOND, F.expr("number div 8") % 6), F.lit(" #"), (n + 1).cast("string")).alias("name"),
        multi_if((n < 20, "enterprise"), (n < 200, "pro"), otherwise="free").alias("tier"),
        pick(COUNTRIES, unsigned_mod("_h", 10)).alias("country"),
    )


def codec_series(spark: SparkSession, rows: int) -> DataFrame:
    """Columns that compress differently: regular times, a jittered sine, random durations, multiples of 500."""
    n = F.col("number")
    return _hashed(numbers(spark, rows), "number", range(1, 3)).select(
        _moment("2026-07-01 00:00:00", n * 10_000).alias("ts"),
        (20 + 5 * F.sin(n / 5000) + unsigned_mod("_h", 10) / 100).alias("temperature"),
        unsigned_mod("_h1", 30_000).cast("int").alias("duration"),
        (unsigned_mod("_h2", 10_000) * 500).alias("cents"),
    )


def live_events(spark: SparkSession, per_second: int = 1000) -> DataFrame:
    """An endless stream of events, shops uniform in 1..1000."""
    n = F.col("value")
    kind = pick(LIVE_MIX, unsigned_mod("_h3", len(LIVE_MIX)))
    return _hashed(spark.readStream.format("rate").option("rowsPerSecond", per_second).load(), "value", range(1, 9)).select(
        F.col("timestamp").alias("event_time"), (unsigned_mod("_h1", 1000) + 1).cast("int").alias("tenant_id"), unsigned_mod("_h2", 5_000_000).alias("user_id"), hash_uuid(n).alias("session_id"), kind.alias("event_type"),
        pick(COUNTRIES[:7], unsigned_mod("_h4", 7)).alias("country"), pick(DEVICES, unsigned_mod("_h5", 4)).alias("device"), F.concat(F.lit("/product/"), unsigned_mod("_h6", 20_000).cast("string")).alias("url"), unsigned_mod("_h7", 30_000).cast("int").alias("duration_ms"),
        F.when(kind == "purchase", (unsigned_mod("_h8", 50_000).cast("decimal(12,0)") / F.lit(100)).cast("decimal(12,2)")).otherwise(F.lit(0).cast("decimal(12,2)")).alias("revenue"),
    )
