import time

import pytest
from pyspark.sql import functions as F

from tidewell.functions import scalars as X
from tidewell.functions import states
from tidewell.operators import kinds
from tidewell.plans import queries as P
from tidewell.sources import exports, files, generators, snapshots, tables
from tidewell.sources.tables import Table, parts_pressure, storage_report
from tidewell.streaming import ingest
from tidewell.streaming.ingest import Ledger, Rollup, refreshed, retried


@pytest.fixture(scope="module")
def events(spark):
    return generators.clickstream(spark, 4000).persist()


def table(events, path):
    return Table(str(path), events.schema, ("tenant_id", "event_time"), "event_time", ("user_id",))


def test_generator_is_reproducible_and_skewed(spark, events):
    assert events.exceptAll(generators.clickstream(spark, 4000)).count() == 0
    share = events.where("tenant_id = 1").count() / 4000
    assert 0.07 < share < 0.13
    assert events.where("event_type <> 'purchase' AND revenue <> 0").count() == 0
    assert generators.codec_series(spark, 10).count() == 10


def test_partition_operations(spark, events, tmp_path):
    t = table(events, tmp_path / "events")
    assert t.read(spark).count() == 0
    t.append(events)
    months = t.partitions(spark)
    assert months == [202606, 202607, 202608] and t.read(spark).count() == 4000
    june = events.where(X.yyyymm("event_time") == 202606).count()
    t.detach(spark, 202606)
    assert t.read(spark).count() == 4000 - june
    t.attach(spark, 202606)
    assert t.read(spark).count() == 4000
    t.append(events.limit(10))
    t.optimize(spark, 202607)
    assert len(files.Files(spark, t.path).listed(f"{t.path}/yyyymm=202607", ".parquet")) == 1 and t.read(spark).count() == 4010
    report = storage_report(t.parts(spark), ["partition"])
    assert report.agg(F.sum("rows")).first()[0] == 4010 and parts_pressure(t.parts(spark), ["partition"], 0).count() == 3
    assert {r["name"] for r in t.columns(spark).collect()} >= {"tenant_id", "revenue"}
    dropped = t.expire(spark, "2026-08-15 00:00:00", 30, whole_partitions=False)
    assert 202606 in dropped and t.read(spark).agg(F.min("event_time") >= "2026-07-16").first()[0]
    t.drop(spark, 202608)
    assert 202608 not in t.partitions(spark)
    copy = t.like(str(tmp_path / "copy"), by_month=None)
    copy.append(events.select("tenant_id").limit(1))
    assert copy.read(spark).first()["url"] == ""
    copy.truncate(spark)
    assert copy.read(spark).count() == 0


def test_snapshots(spark, events, tmp_path):
    t = table(events, tmp_path / "events")
    t.append(events)
    full = snapshots.backup(spark, {"events": t.path}, str(tmp_path / "full"))
    t.append(events.limit(50))
    inc = snapshots.backup(spark, {"events": t.path}, str(tmp_path / "inc"), str(tmp_path / "full"))
    assert sum(f["at"].startswith(str(tmp_path / "inc")) for f in inc["files"]) == len(inc["files"]) - len(full["files"])
    back = t.like(str(tmp_path / "back"))
    snapshots.restore(spark, str(tmp_path / "inc"), "events", back.path)
    assert back.read(spark).exceptAll(t.read(spark)).count() == 0 and back.read(spark).count() == 4050
    with pytest.raises(ValueError):
        snapshots.restore(spark, str(tmp_path / "full"), "events", back.path)
    snapshots.restore(spark, str(tmp_path / "full"), "events", back.path, [202606], allow_non_empty=True)
    assert back.read(spark).count() == 4050 + events.where(X.yyyymm("event_time") == 202606).count()


def test_latest_version(spark):
    rows = [(1, 1, "a@x.io", "free", "2026-07-01", False), (1, 1, "a@x.io", "pro", "2026-07-05", False), (2, 1, "b@x.io", "free", "2026-07-01", False), (2, 1, "b@x.io", "free", "2026-07-09", True)]
    df = spark.createDataFrame(rows, "user_id int, tenant_id int, email string, plan string, updated_at string, is_deleted boolean")
    got = kinds.latest(df, ["tenant_id", "user_id"], "updated_at", "is_deleted").select("user_id", "tenant_id", "email", "plan").collect()
    assert [tuple(r) for r in got] == [(1, 1, "a@x.io", "pro")]
    assert [(r["user_id"], r["plan"]) for r in kinds.latest_by(df, ["user_id"], "updated_at", ["plan"], "is_deleted").collect()] == [(1, "pro")]


def test_states_merge_like_one_pass(events):
    keys = ["tenant_id"]
    blocks = [states.partial(events.where(F.pmod(F.xxhash64("session_id"), F.lit(3)) == i), keys, "user_id", "revenue", "duration_ms") for i in range(3)]
    merged = states.finished(blocks[0].unionByName(blocks[1]).unionByName(blocks[2]), keys)
    direct = events.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("money"), F.count_distinct("user_id").alias("u"))
    for r in merged.join(direct, "tenant_id").collect():
        assert r["events"] == r["n"] and r["revenue"] == r["money"] and abs(r["users"] - r["u"]) <= max(1, 0.05 * r["u"])


def test_rollup_stream_writes_each_block_once(spark, events, tmp_path):
    source = str(tmp_path / "in")
    events.where("tenant_id < 500").repartition(3).write.parquet(source)
    roll = Rollup(spark, str(tmp_path / "roll"))
    for _ in range(2):
        q = roll.stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source), str(tmp_path / "cp"))
        q.awaitTermination()
    assert roll.raw().count() == events.where("tenant_id < 500").count()
    assert roll.states().agg(F.sum("events")).first()[0] == roll.raw().count()
    block = events.limit(5)
    assert roll.write(block) and not roll.write(block)
    assert roll.backfill(events.where("tenant_id >= 500"), "2026-07-01") and not roll.backfill(events, "2026-07-01")


def test_ledger_forgets_the_oldest(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), keep=3)
    for i in range(5):
        ledger.add(f"t{i}")
    assert len(ledger.known()) == 3 and ledger.holds("t4")


def test_retry(monkeypatch):
    waits, left = [], [2]

    def flaky():
        if left[0]:
            left[0] -= 1
            raise OSError("again")
        return 7

    assert retried(flaky, sleep=waits.append) == 7 and len(waits) == 2 and all(0.1 <= w <= 0.4 for w in waits)

    class ParseException(Exception):
        pass

    def broken():
        raise ParseException

    with pytest.raises(ParseException):
        retried(broken, sleep=waits.append)
    assert len(waits) == 2


def test_export_and_refresh(spark, events, tmp_path):
    exports.export_csv(events, 1, str(tmp_path / "csv"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert len(rows.columns) == 9 and rows.count() == events.where("tenant_id = 1").count() and rows.first()["event_time"].endswith("Z")
    for n in (1, 2):
        refreshed(spark, lambda n=n: events.limit(n), str(tmp_path / "top"))
        assert spark.read.parquet(str(tmp_path / "top")).count() == n


def test_dictionary(spark, events):
    loads = []

    def load():
        loads.append(1)
        return generators.shops(spark)

    d = kinds.Dictionary(load, "tenant_id", lifetime=1000)
    out = d.get(events, "tenant_id", ["tier"])
    assert out.count() == 4000 and d.get(events, "tenant_id", ["name"]).where("name = ''").count() == 0 and len(loads) == 1
    small = generators.shops(spark).where("tenant_id < 3")
    assert kinds.dictionary_get(events, small, "tenant_id", ["tier"]).where("tenant_id > 2 AND tier <> ''").count() == 0


def test_query_helpers(spark, events):
    with P.tagged(spark, "test", **{"spark.sql.shuffle.partitions": "3"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert P.limited(spark, lambda: events.count(), 60) == 4000 and P.query_log(spark).where("state = 'finished'").count() >= 1
    assert sum(1 for _ in P.streamed(events.limit(20))) == 20
    other = events.orderBy("country")
    routed = P.routed([P.Copy(lambda: events, ("tenant_id",)), P.Copy(lambda: other, ("country", "tenant_id"))], {"country": "DE"})
    assert routed.count() == events.where("country = 'DE'").count() and "Sort" in P.plan_text(routed)
    assert "tenant_id" in exports.shown(events, 2, vertical=True)


def test_chat_requests_keep_unknown_fields(spark):
    raw = '{"model":"m","temperature":0.5,"messages":[{"role":"user","content":"a \\"b\\"","name":"x"}],"tools":[{"t":1}]}'
    df = files.chat_requests(spark.createDataFrame([(raw,), ("no json",)], "raw string"))
    assert [r["error"] for r in df.collect()] == [None, "bad request"]
    import json

    out = json.loads(df.limit(1).select(files.rewritten(F.col("raw"), F.array(F.lit('new "text"')))).first()[0])
    want = json.loads(raw)
    want["messages"][0]["content"] = 'new "text"'
    assert out == want


def test_scalars(spark):
    row = spark.range(1).select(
        X.readable_size(F.lit(1536)).alias("kib"), X.readable_size(F.lit(3 * 1024**3)).alias("gib"), X.package_name(F.lit("POL-AI-003")).alias("pkg"), X.hash_uuid(F.lit(1)).alias("uuid"),
        X.fenced_json(F.lit('```json\n{"a": 1}\n```'), "a int").alias("j"), X.byte_offset(F.lit("Müller"), F.lit(6)).alias("b"), X.capacity_bytes(F.lit(10), F.lit(2.0), F.lit(3), F.lit(1)).alias("cap"), X.seconds_between(F.lit("2026-01-01").cast("timestamp"), F.lit("2026-01-02").cast("timestamp")).alias("s"),
    ).first()
    assert (row["kib"], row["gib"], row["pkg"], row["j"]["a"], row["b"], row["cap"], row["s"]) == ("1.50 KiB", "3.00 GiB", "pol_ai_003", 1, 7, 78.0, 86400.0) and len(row["uuid"]) == 36


def test_ttl_kinds(spark, events):
    now = F.lit("2026-08-30").cast("timestamp")
    assert kinds.expired_out(events, "event_time", now, "60 days").count() < 4000
    rolled = kinds.expired_rolled_up(events, "event_time", now, "60 days", ["tenant_id"], ["revenue"])
    assert rolled.agg(F.sum("revenue")).first()[0] == events.agg(F.sum("revenue")).first()[0] and rolled.count() < 4000


def test_batches_by_rows_or_time_with_retries(spark):
    now, wrote, fails = [0.0], [], [1]

    def write(df, token):
        if fails and fails.pop():
            raise OSError("busy")
        wrote.append((token, sorted(r[0] for r in df.collect())))

    b = ingest.Batches(spark, "n int", write, rows=3, seconds=1.0, clock=lambda: now[0], sleep=lambda s: None)
    assert [b.add((i,)) for i in range(4)] == [False, False, True, False] and wrote[0][1] == [0, 1, 2]
    now[0] = 0.9
    assert not b.tick()
    now[0] = 1.0
    assert b.tick() and wrote[1][1] == [3] and not b.tick() and not b.flush()
    fails += [1] * 5
    b.add((9,))
    with pytest.raises(OSError):
        b.flush()
    fails.clear()
    assert b.flush() and wrote[-1][1] == [9] and len({t for t, _ in wrote}) == 3


def test_compacted_blocks(spark, tmp_path, events):
    roll = ingest.Rollup(spark, str(tmp_path / "roll"))
    for k in range(3):
        roll.write(events.where(F.col("tenant_id") % 3 == k))
    before = sorted(map(str, states.finished(roll.states(), ["tenant_id"]).collect()))
    assert roll.compact() == 3 and roll.compact() == 0 and roll.compact("raw") == 3
    assert sorted(map(str, states.finished(roll.states(), ["tenant_id"]).collect())) == before and roll.raw().count() == events.count()
    assert roll.write(events.where(F.col("tenant_id") % 3 == 0)) is False  # its token is still known
    # a crash after the merged folder appeared: the list hides what it replaced
    store = ingest.Files(spark, roll.path)
    name = store.folders(f"{roll.path}/states")[0]
    roll.states_of(events.limit(10)).write.parquet(f"{roll.path}/states/block=old")
    store.write(f"{roll.path}/replaced/states/{name}", '["block=old"]')
    assert sorted(map(str, states.finished(roll.states(), ["tenant_id"]).collect())) == before


def test_limits(spark, events):
    assert P.bounded(events.limit(5)).count() == 5
    with pytest.raises(P.TooLarge):
        P.bounded(events, 10)
    seen = []
    P.limited(spark, lambda: events.repartition(7).count(), 60, progress=lambda done, known: seen.append((done, known)), every=0.01)
    assert all(a <= b for a, b in seen)


def test_altered_and_moved_partitions(spark, tmp_path, events):
    t = tables.Table(str(tmp_path / "t"), events.schema, order=("tenant_id", "event_time"), by_month="event_time")
    t.append(events)
    n = events.count()
    other = t.like(str(tmp_path / "t"), order=("country",))
    assert other.alter(spark, lambda df: df.withColumn("device", F.lit("x"))) == len(t.partitions(spark))
    assert t.read(spark).where("device = 'x'").count() == n
    cold = t.like(str(tmp_path / "cold"))
    first = t.partitions(spark)[0]
    t.move(spark, first, cold)
    assert cold.partitions(spark) == [first] and t.read(spark).count() + cold.read(spark).count() == n


def test_encodings_shrink_their_columns(spark, tmp_path):
    series = generators.codec_series(spark, 50_000).coalesce(1)
    sizes = {}
    for name, options in (("plain", {}), ("own", tables.encodings(("ts", "duration"), ("temperature",)))):
        t = Table(str(tmp_path / name), series.schema, options=options)
        t.append(series)
        sizes[name] = {r["name"]: r["compressed"] for r in t.columns(spark).collect()}
        assert t.read(spark).exceptAll(series).count() == 0
    assert sizes["own"]["ts"] < sizes["plain"]["ts"] / 10 and sizes["own"]["duration"] < sizes["plain"]["duration"]


def test_latest_breaks_ties_by_sequence(spark):
    rows = [(1, 5, 1, "a", False), (1, 5, 2, "b", False), (2, 1, 1, "c", False), (2, 9, 2, "d", True), (3, None, 1, "e", False)]
    df = spark.createDataFrame(rows, "k int, v int, s int, x string, gone boolean")
    assert sorted((r["k"], r["x"]) for r in kinds.latest(df, ["k"], "v", "gone", "s").collect()) == [(1, "b"), (3, "e")]
    assert kinds.latest(df, ["k"], "v", "gone", "s").columns == ["k", "v", "s", "x"]


def test_session_info(spark):
    from tidewell.session import session_info

    spark.conf.set("tidewell.macro.shard", "01")
    r = session_info(spark).first()
    assert r["version"].startswith("4.") and r["macros"] == {"shard": "01"} and r["host"]


def test_set_index_rules_files_out(spark, tmp_path, events):
    path = str(tmp_path / "t")
    events.repartitionByRange(6, "country").write.parquet(path)
    tables.set_index(spark, path, "country", 3)
    got = tables.read_indexed(spark, path, "country", "DE")
    assert got.count() == events.where("country = 'DE'").count() and len(got.inputFiles()) < 6
    assert tables.read_indexed(spark, path, "country", "none").count() == 0
    tables.set_index(spark, path, "url", 3)  # too many values: no file is ruled out
    url = events.first()["url"]
    assert tables.read_indexed(spark, path, "url", url).count() == events.where(F.col("url") == url).count()
    events.limit(5).withColumn("country", F.lit("DE")).write.mode("append").parquet(path)
    assert tables.read_indexed(spark, path, "country", "DE").count() == events.where("country = 'DE'").count() + 5


def test_requests_that_go_on_and_that_are_refused(spark):
    good = ['{"model":"m"}', '{"messages":null}', '{"messages":[]}', '{"messages":[{"role":"user","content":null}]}', '{"messages":[{"content":"a","name":7}, null]}', '{"model":{"x":1},"messages":[{}]}']
    bad = ["", "no json", "[]", '"text"', '{"messages":"x"}', '{"messages":["x"]}', '{"messages":[{"content":[{"type":"text","text":"hi"}]}]}', '{"messages":[{"content":1}]}', '{"messages":[{"role":{"a":1},"content":"x"}]}', '{"messages": [']
    got = {r["raw"]: r["error"] for r in files.chat_requests(spark.createDataFrame([(x,) for x in good + bad], "raw string")).collect()}
    assert got == dict.fromkeys(good) | dict.fromkeys(bad, "bad request")


def test_half_written_blocks_are_neither_read_nor_merged(spark, tmp_path, monkeypatch):
    from tidewell.streaming.ingest import Ledger, Rollup

    def block(n):
        return spark.range(10).select(F.lit("t").alias("tenant_id"), F.lit("view").alias("event_type"), F.timestamp_seconds(F.col("id") + 100 * n).alias("event_time"), F.col("id").alias("user_id"), F.lit(1.0).alias("revenue"), F.lit(5).alias("duration_ms"))

    def counts(r):
        return r.raw().count(), r.states().agg(F.sum("events")).first()[0]

    r = Rollup(spark, str(tmp_path / "rollup"))
    assert r.write(block(1), "a") and r.write(block(2), "b")
    with monkeypatch.context() as m:  # a crash after both outputs, before the mark
        m.setattr(Rollup, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            r.write(block(3), "c")
    assert counts(r) == (20, 20)
    assert r.compact() == 2 and r.compact("raw") == 2
    assert counts(r) == (20, 20)
    assert r.write(block(3), "c") and counts(r) == (30, 30)
    with monkeypatch.context() as m:  # a crash between the two marks
        m.setattr(Ledger, "add", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            r.write(block(4), "d")
    assert counts(r) == (40, 40)
    r.compact()
    r.compact("raw")
    assert not r.write(block(4), "d") and not r.write(block(3), "c") and counts(r) == (40, 40)


def test_incremental_copies_take_changed_files_of_equal_size(spark, tmp_path):
    store = files.Files(spark, str(tmp_path))
    store.write(f"{tmp_path}/t/a", "old")
    store.write(f"{tmp_path}/t/b", "same")
    snapshots.backup(spark, {"t": f"{tmp_path}/t"}, f"{tmp_path}/full")
    time.sleep(1.1)  # stores that keep times in seconds
    store.write(f"{tmp_path}/t/a", "new")
    made = snapshots.backup(spark, {"t": f"{tmp_path}/t"}, f"{tmp_path}/inc", f"{tmp_path}/full")
    assert [f["name"] for f in made["files"] if "/inc/" in f["at"]] == ["a"]
    snapshots.restore(spark, f"{tmp_path}/inc", "t", f"{tmp_path}/back")
    assert (store.read(f"{tmp_path}/back/a"), store.read(f"{tmp_path}/back/b")) == ("new", "same")
