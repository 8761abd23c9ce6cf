"""Ranks by histograms, overlaps between relations, long span folds, growth over a range, chains and keyed tables, each against a plain version."""

import hashlib
import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import spans, states
from tidewell.operators import detect, evidence, intervals, ranks
from tidewell.sources.keyed import Keyed

# -- ranks


def values(kind, rng):
    if kind == "double":
        return [rng.choice([rng.random(), rng.gauss(0, 1e6), 10.0 ** rng.randint(-300, 300), -0.0, 5e-324, rng.randint(0, 3) / 7]) for _ in range(200)] + [math.inf, -math.inf, 1.7e308, -1.7e308]
    if kind == "long":
        return [rng.choice([rng.randint(-(2**63), 2**63 - 1), rng.randint(0, 5), 2**62 + rng.randint(0, 3)]) for _ in range(200)]
    return [rng.randint(-999, 999) for _ in range(200)]


@pytest.mark.parametrize(("kind", "bins"), [("double", 1 << 16), ("double", 4), ("long", 1 << 16), ("long", 8), ("int", 3), ("decimal(38,4)", 16)])
def test_ranks(spark, kind, bins):
    rng = random.Random(bins)
    cast = kind.split("(")[0]
    rows = [(g, v) for g in ("a", "b", None) for v in values("long" if cast == "decimal" else kind, rng)] + [("c", None), ("d", 7)]
    rows = [(g, None if v is None else float(v) if kind == "double" else v) for g, v in rows]
    base = "long" if cast == "decimal" else kind
    df = spark.createDataFrame(rows, f"g string, v {base}").select("g", F.col("v").cast(kind).alias("v")).repartition(4)
    got = ranks.ranked(df, ["g"], "v", [F.lit(0), F.floor(F.col("n") / 2), F.col("n") - 1, F.col("n"), F.lit(5)], bins).collect()
    by = {g: sorted(v for h, v in rows if h == g and v is not None) for g in ("a", "b", "c", "d", None)}
    want = {(g, i): (len(vs), vs[k], sum(v < vs[k] for v in vs)) for g, vs in by.items() for i, k in enumerate((0, len(vs) // 2, len(vs) - 1, len(vs), 5)) if 0 <= k < len(vs)}
    assert {(r["g"], r["i"]): (r["n"], r["value"], r["before"]) for r in got} == want
    assert len(got) == len(want)


def test_exact_states_of_large_keys(spark):
    """Thousands of users and durations of a key, from blocks merged twice: counts and ranks without an error; null users aren't counted, null keys are a key."""
    e = spark.range(0, 60_000, 1, 4).select(F.when(F.col("id") % 3 < 2, F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("minute"), F.when(F.col("id") % 11 > 0, F.col("id") % 9001).alias("user"), (F.col("id") * 7919 % 10_007).alias("t"))
    blocks = [states.exact_partial(e.where(F.col("minute") % 2 == i), ["k", "minute"], "user", "t") for i in range(2)]
    got = states.exact_finished(states.exact_rolled(blocks[0].unionByName(blocks[1]), ["k", (F.col("minute") % 2).alias("half")]), ["k"]).collect()
    want = {}
    for i in range(60_000):
        want.setdefault(i % 3 if i % 3 < 2 else None, []).append((i % 9001 if i % 11 else None, i * 7919 % 10_007))
    assert {r["k"]: (r["events"], r["users"], r["p95"]) for r in got} == {k: (len(v), len({u for u, _ in v} - {None}), sorted(t for _, t in v)[-(-95 * len(v) // 100) - 1]) for k, v in want.items()}
    assert len(got) == 3


def test_nan_is_the_greatest(spark):
    df = spark.createDataFrame([(v,) for v in (math.nan, 1.0, math.inf, 2.0)], "v double")
    got = {r["i"]: r["value"] for r in ranks.ranked(df, [], "v", [F.lit(i) for i in range(4)]).collect()}
    assert [got[i] for i in range(3)] == [1.0, 2.0, math.inf] and math.isnan(got[3])


def test_percentiles_as_in_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(v)) for g in range(3) for v in rng.lognormal(size=50 + int(g))]
    got = {r["g"]: r for r in ranks.percentiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    for g in range(3):
        assert [got[g][p] for p in ("p10", "p50", "p99")] == pytest.approx(np.quantile([v for h, v in rows if h == g], [0.1, 0.5, 0.99]).tolist())


def test_kth_row(spark):
    rows = [(i % 7, i % 3, i) for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    for k in (0, 13, 57, 99):
        assert tuple(ranks.kth_row(df, k, ["a", "b", "c"]).first()) == sorted(rows)[k]
    assert ranks.kth_row(df, 100, ["a"]).count() == 0 and ranks.kth_row(df.limit(0), 0, ["a"]).count() == 0


def test_ranks_never_sort_the_input(spark, monkeypatch):
    plans = []
    kept = ranks._stored
    monkeypatch.setattr(ranks, "_stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    ranks.ranked(spark.range(1000).select((F.col("id") % 5).alias("g"), F.col("id").alias("v")), ["g"], "v", [F.lit(3)]).collect()
    assert len(plans) >= 2
    for p in plans:  # the histogram's rows are sorted, above their aggregate
        assert "Sort" not in p or p.index("Sort") < p.index("HashAggregate")


# -- overlaps


def apart(new, kept):
    return [x for x in new if not any(x[0] == y[0] and x[0] is not None and None not in x[1:3] and x[1] < y[2] and y[1] < x[2] for y in kept)]


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_overlap_anti_join(spark, width):
    rng = random.Random(width)

    def some(n):
        out = []
        for _ in range(n):
            a = rng.randint(0, 400)
            out.append((rng.randint(0, 3), a, a + rng.choice([0, 1, 2, 5, 40]), "v"))
        return out

    new, kept = some(200) + [(None, 1, 5, "v"), (1, None, 3, "v"), (2, 0, 390, "v"), (9, 3, 4, "v")], some(25) + [(None, 1, 5, "v"), (3, 100, 300, "v")]
    new += new[:3]
    frame = lambda rows: spark.createDataFrame(rows, "k long, start long, end long, value string").repartition(3)
    got = [tuple(r) for r in intervals.without_overlaps(frame(new), frame(kept), ["k"], width=width).collect()]
    assert sorted(got, key=str) == sorted(apart(new, kept), key=str)
    assert intervals.without_overlaps(frame(new), frame(kept).limit(0), ["k"]).count() == len(new)
    assert intervals.without_overlaps(frame(new).limit(0), frame(kept), ["k"]).count() == 0
    assert "NestedLoop" not in intervals.without_overlaps(frame(new), frame(kept), ["k"])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 128, 129, 2000])
def test_long_folds_accept_what_short_ones_do(spark, n):
    rng = random.Random(n)
    c = [(a := rng.randint(0, 3 * n), a + rng.randint(1, 9), f"v{i}") for i in range(n)]
    kept: list = []
    for x in c:
        if not any(x[0] < y[1] and y[0] < x[1] for y in kept):
            kept.append(x)
    kind = "struct<start:int,end:int,value:string>"
    got = spark.createDataFrame([(c,)], f"c array<{kind}>").select(spans.accepted(F.col("c"), kind).alias("o")).first()["o"]
    assert [tuple(x) for x in got] == kept


def test_a_text_of_many_matches(spark):
    n = 10_000
    text = " ".join(f"usér{i}@mail{i % 7}.com" for i in range(n))
    got = detect.with_findings(spark.createDataFrame([(text,)], "text string")).first()["findings"]
    assert len(got) == n and got[-1]["id"] == f"f{n}"
    raw = text.encode()
    assert all(text[f["start"]:f["end"]] == f["value"] == raw[f["byte_start"]:f["byte_end"]].decode() for f in got)


# -- growth over a range


@pytest.mark.parametrize("slices", [1, 3, 12])
def test_growth_over_a_range(spark, slices):
    rng, at, rows = random.Random(5), datetime(2024, 1, 1, tzinfo=timezone.utc), []
    for g in ("a", "b"):
        t = 0
        for _ in range(150):
            t += rng.choice([1, 30, 60, 299, 300, 301, 2000])
            rows.append((g, at + timedelta(seconds=t), rng.randint(0, 100)))
    df = spark.createDataFrame(rows, "g string, at timestamp, v long").repartition(4)
    got = {(r["g"], r["at"]): r["increase"] for r in evidence.increase_over(df, ["g"], "at", "v", 300, slices).collect()}
    want = {}
    for i, (g, t, _) in enumerate(rows):
        own = [v for h, u, v in rows[:i + 1] if h == g and t - u <= timedelta(seconds=300)]
        want[g, t.astimezone().replace(tzinfo=None)] = sum(b - a if b >= a else b for a, b in zip(own, own[1:], strict=False))
    assert list(got.values()) and sorted(got.values()) == sorted(want.values())
    assert len(got) == len(rows)


# -- chains


def test_chain_breaks(spark):
    rows = []
    for chain in range(8):
        before = ""
        for i in range(1, 6):
            own = hashlib.sha256((before + f"{chain}/{i}").encode()).hexdigest()
            rows.append([chain, i, f"{chain}/{i}", before, own])
            before = own
    at = {(r[0], r[1]): r for r in rows}
    at[1, 3][2] = "edited"
    at[2, 2][4] = "0" * 64
    at[3, 4][3] = at[3, 1][4]
    at[4, 1][3] = "x"
    at[7, 5][2] = None
    rows = [r for r in rows if (r[0], r[1]) not in {(5, 2), (6, 5)}]
    got = evidence.chain_breaks(spark.createDataFrame(rows, "c int, i int, text string, prev_hash string, hash string"), "c", "i", "text").collect()
    assert sorted(tuple(r) for r in got) == [(1, 3, "edited"), (2, 2, "edited"), (3, 4, "unlinked"), (4, 1, "unlinked"), (5, 3, "missing"), (7, 5, "edited")]


# -- keyed tables


def test_versions_merge_without_a_shuffle(spark):
    t = Keyed(spark, ["k"], version=("v",), deleted="gone", buckets=4)
    t.append(spark.createDataFrame([(1, 1, "a", False), (2, 1, "b", False), (None, 1, "n", False), (3, 5, "c", True)], "k long, v int, x string, gone boolean"))
    t.append(spark.createDataFrame([(1, 3, "aa", False), (2, 2, "", True), (None, 2, "nn", None), (4, 1, "d", False)], "k long, v int, x string, gone boolean"))
    t.append(spark.createDataFrame([(1, 2, "old", False)], "k long, v int, x string, gone boolean"))
    want = {(1, "aa"), (None, "nn"), (4, "d")}
    read = lambda: {(r["k"], r["x"]) for r in t.read().collect()}
    assert read() == want and t.rows().count() == 9
    assert "Exchange" not in t.read()._jdf.queryExecution().executedPlan().toString()
    t.compact()
    assert read() == want and t.rows().count() == 5
    t.append(spark.createDataFrame([(3, 4, "late", False), (4, 2, "dd", False)], "k long, v int, x string, gone boolean"))
    assert read() == {(1, "aa"), (None, "nn"), (4, "dd")}
    assert "Exchange" not in t.read()._jdf.queryExecution().executedPlan().toString()
    t.drop()


def test_sums_merge(spark):
    t = Keyed(spark, ["day", "k"], sums=("n", "money"), buckets=3)
    for i in range(3):
        t.append(spark.createDataFrame([("d", 1, 1, i), ("d", 2, 1, None)], "day string, k int, n long, money long"))
    want = [("d", 1, 3, 3), ("d", 2, 3, None)]
    assert sorted(tuple(r) for r in t.read().select("day", "k", "n", "money").collect()) == want
    t.compact()
    t.compact()
    assert sorted(tuple(r) for r in t.read().select("day", "k", "n", "money").collect()) == want and t.rows().count() == 2
    t.drop()


def test_a_broken_swap_is_finished(spark):
    t = Keyed(spark, ["k"], sums=("n",), buckets=2)
    t.append(spark.createDataFrame([(1, 2), (1, 3)], "k int, n long"))
    spark.sql(f"ALTER TABLE {t.name} RENAME TO {t.name}_next")  # as after the first of the two renames
    again = Keyed(spark, ["k"], sums=("n",), buckets=2, name=t.name)
    assert again.read().collect()[0]["n"] == 5
    again.drop()
    with pytest.raises(ValueError, match="versions or"):
        Keyed(spark, ["k"])


def test_an_order_is_computed_once_for_all_blocks(spark):
    kind = "struct<start:int,end:int>"
    df = spark.createDataFrame([([(i % 91, i % 91 + 3) for i in range(400)],)], f"c array<{kind}>").select(spans.accepted(F.reverse("c"), kind).alias("o"))
    assert df._jdf.queryExecution().analyzed().toString().count("reverse(") == 1
    assert [tuple(x) for x in df.first()["o"][:2]] == [(399 % 91, 399 % 91 + 3), (396 % 91, 396 % 91 + 3)]
