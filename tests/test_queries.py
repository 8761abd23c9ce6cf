"""Every registered query with an SQL twin against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tidewell import cases, queries, whole

QUERIES, SQL = queries.QUERIES | cases.QUERIES | cases.GOLDEN | whole.QUERIES, queries.SQL | cases.SQL | cases.GOLDEN_SQL | whole.SQL
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(v) for v in row) for row in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_clickstream_rows_follow_the_events_table(spark, duck):
    rows = sum(r["n"] for r in QUERIES["q_clickstream"](spark, DIR).collect())
    assert rows == duck.execute("SELECT count(*) FROM events").fetchone()[0]


def test_sketches_are_near_exact_figures(spark, duck):
    users = dict(duck.execute("SELECT event_type, count(DISTINCT user_id) FROM events GROUP BY 1").fetchall())
    for r in QUERIES["q_uniq_hll"](spark, DIR).collect():
        assert abs(r["users"] / users[r["event_type"]] - 1) <= 0.1
    exact = {r[0]: r[1:] for r in duck.execute("SELECT json_extract_string(props, '$.k')::INT, count(*), count(DISTINCT user_id), list_sort(list(event_id % 1000)) FROM events GROUP BY 1").fetchall()}
    rows = QUERIES["q_rollup_states_hourly"](spark, DIR).collect()
    assert len(rows) == len(exact)
    for r in rows:
        events, distinct, durations = exact[r["tenant_id"]]
        rank = sum(x <= r["p95"] for x in durations) / len(durations)
        assert r["events"] == events and abs(r["users"] / distinct - 1) <= 0.05 and 0.9 <= rank <= 1
