"""City hashes against plain integers, signatures by relation, and blocks accepted by a stream's own state."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import city
from tidewell.functions import scalars as X
from tidewell.operators import policy_checks
from tidewell.sources import generators
from tidewell.streaming.ingest import first_blocks

NUMBERS = [0, 1, 2, 41, 2**31, 2**32 - 1, 2**53 + 1, 2**63 - 1]


def test_mixing_step_has_its_published_value():
    """The two products and three shifts, without the salt, are the 64-bit finaliser whose value of 1 is published."""
    assert city.plain(1 ^ city.SALT) == 0xB456BCFC34C2CB2C


def test_hashes_equal_plain_integers(spark):
    df = spark.createDataFrame([(x,) for x in [*NUMBERS, None]], "x long")
    for r in city.with_hashes(df, "x", alone=None, one=1, eight=8).withColumn("expr", city.number_hash("x")).collect():
        want = [None] * 4 if r["x"] is None else [city.plain(r["x"]), city.plain(r["x"], 1), city.plain(r["x"], 8), city.plain(r["x"])]
        assert [None if v is None else v % 2**64 for v in (r["alone"], r["one"], r["eight"], r["expr"])] == want


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=50), st.integers(1, 2**60))
def test_products_and_remainders_wrap(spark, xs, m):
    df = spark.createDataFrame([(x,) for x in xs], "x long").select("x", city.times(F.col("x"), city.FOLD).alias("p"), city.unsigned_mod("x", m).alias("m"))
    for r in df.collect():
        assert r["p"] % 2**64 == r["x"] * city.FOLD % 2**64 and r["m"] == r["x"] % 2**64 % m


def test_mode_of_the_session_comes_back(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    city.with_hashes(spark.range(1), "id", h=1)
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_shards_of_numbers_and_of_other_keys(spark):
    got = spark.range(50).select("id", X.shard_number("id", 4).alias("n"), X.shard_number(F.col("id").cast("string"), 4, whole=False).alias("s")).collect()
    assert all(r["n"] == city.plain(r["id"]) % 4 + 1 and 1 <= r["s"] <= 4 for r in got)


def test_clickstream_goes_by_the_hash(spark):
    for i, r in enumerate(generators.clickstream(spark, 20).orderBy(F.col("url").isNull()).collect()):
        assert r["user_id"] == city.plain(i, 2) % 5_000_000 and r["country"] == generators.COUNTRIES[city.plain(i, 4) % 10]
        assert r["tenant_id"] == 1 + int((city.plain(i, 1) % 1_000_000 / 1_000_000) ** 3 * 1000) and r["duration_ms"] == city.plain(i, 7) % 30_000


def test_signatures(spark):
    policies = spark.createDataFrame([("P", "1", "c", ["legal", "legal", "dpo"]), ("Q", "1", "c", []), ("R", "2", "c", ["legal"]), ("S", "1", "c", ["legal"]), ("T", "1", "c", None)], "policy_id string, version string, content_sha256 string, approvers array<string>")
    rows = [("P", "1", "c", "legal"), ("P", "1", "c", "legal"), ("R", "1", "c", "legal"), ("S", "1", "d", "legal"), ("S", "0", "c", "legal"), ("P", "1", None, "dpo")]
    schema = "policy_id string, version string, content_sha256 string, role string"
    assert sorted((r["policy_id"], r["role"], r["lacks"]) for r in policy_checks.unsigned(policies, spark.createDataFrame(rows, schema)).collect()) == [("P", "dpo", "role"), ("R", "legal", "version"), ("S", "legal", "content_sha256")]
    assert policy_checks.unsigned(policies, spark.createDataFrame([], schema)).count() == 4
    assert policy_checks.unsigned(policies.limit(0), spark.createDataFrame(rows, schema)).count() == 0


@pytest.mark.parametrize("keep, accepted", [(100, ["a", "b", "c"]), (1, ["a", "a", "b", "c"])])
def test_blocks_once_across_restarts(spark, tmp_path, keep, accepted):
    start = datetime(2024, 1, 1)
    schema = "source string, token string, at timestamp, size int"

    def deliver(*tokens, minutes=0, source="s"):
        rows = [(source, t, start + timedelta(minutes=minutes + i), i) for i, t in enumerate(tokens)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        headers = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        first_blocks(headers, keep=keep).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted((r["token"] for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).where(F.col("source") == source).collect()), key=str)

    assert deliver("a", "a", "b", "b") == ["a", "b"]
    assert deliver("b", "c", minutes=5) == ["a", "b", "c"]
    assert deliver("a", minutes=8) == accepted
    assert deliver("a", source="other") == ["a"]  # another source's blocks are its own
    assert deliver("a", minutes=300) == sorted([*accepted, "a"])  # met more than an hour ago
