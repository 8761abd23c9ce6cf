from pyspark.sql import functions as F

from tidewell.operators import detect, health
from tidewell.plans.queries import plan_text
from tidewell.sources import generators
from tidewell.sources.tables import gathered_copies, write_bucketed


def test_health(spark):
    log = spark.createDataFrame([("a", 1.0, 5.0, "finished"), ("b", 2.0, 9.0, "finished"), ("c", 3.0, 1.0, "running")], "query_id string, began double, seconds double, state string")
    assert [r[0] for r in health.slowest(log, n=1).collect()] == ["b"] and [r[0] for r in health.slowest(log, F.lit(1.5)).collect()] == ["b"] and health.running(log).count() == 1
    errors = spark.createDataFrame([(60, "x", "m", 1), (60, "x", "m", 2), (62, "y", "n", 1)], "code int, name string, message string, at int")
    assert [(r["code"], r["n"]) for r in health.errors_by_code(errors).collect()] == [(60, 2), (62, 1)] and health.errors_by_code(errors, [62]).count() == 1
    queue = spark.createDataFrame([("t", 20, "bad"), ("t", 20, None), ("t", 1, "bad")], "table string, num_tries int, last_exception string")
    assert health.stuck_tasks(queue).count() == 1
    d = spark.createDataFrame([("d", 10, 100), ("e", 50, 100), ("f", 0, 0)], "name string, free_bytes long, total_bytes long")
    assert [r["low"] for r in health.disks(d).collect()] == [True, False, None]
    q = spark.createDataFrame([("t", 2, 5, 0), ("u", 0, 0, 0)], "table string, data_files int, data_compressed_bytes int, error_count int")
    assert [r["table"] for r in health.backlog(q, ["table"]).collect()] == ["t"]
    m = health.merges_and_mutations(spark.createDataFrame([("t", 0.456)], "table string, progress double"), spark.createDataFrame([("t", True, ""), ("u", False, "why")], "table string, is_done boolean, latest_fail_reason string"))
    assert sorted((r["kind"], r["table"]) for r in m.collect()) == [("merge", "t"), ("mutation", "u")]
    c = spark.createDataFrame([("a", "INT", 0, 0), ("b", "INT", 1024, 4096)], "name string, type string, compressed long, uncompressed long")
    assert [(r["name"], r["ratio"]) for r in health.compression(c).collect()] == [("b", 4.0), ("a", None)]


def test_bucketed_tables_join_in_place(spark):
    write_bucketed(generators.shops(spark), "shops_bucketed", "tenant_id", 4)
    t = spark.table("shops_bucketed")
    both = t.hint("merge").join(t.withColumnRenamed("name", "other"), "tenant_id")
    assert t.where("tenant_id = 42").count() == 1 and "Exchange" not in plan_text(both) and both.count() == 1000
    spark.sql("DROP TABLE shops_bucketed")
    assert gathered_copies({"a": spark.range(2), "b": spark.range(3)}).groupBy("host").count().count() == 2


def test_chunked_detection(spark):
    text = "word " * 600 + "Zoë met Zoë " + "é " * 400 + "Zoë"

    def names(t):
        out, at = [], t.find("Zoë")
        while at >= 0:
            out += [{"type": "pii.name", "start": at, "end": at + 3, "score": 0.9}, {"type": "pii.name", "start": at, "end": at + 2, "score": 0.5}]
            at = t.find("Zoë", at + 1)
        return out

    df = spark.createDataFrame([(1, text), (2, None), (3, "none")], "id int, text string")
    got = {r["id"]: r for r in detect.detected_in_chunks(df, "id", names).collect()}
    assert [(f["start"], f["value"]) for f in got[1]["findings"]] == [(i, "Zoë") for i in range(len(text)) if text.startswith("Zoë", i)]
    assert all(text.encode()[f["byte_start"]:f["byte_end"]].decode() == "Zoë" for f in got[1]["findings"]) and got[2]["findings"] == [] and got[3]["findings"] == []
    bad = detect.detected_in_chunks(df, "id", lambda t: 1 / 0).where("id = 3").first()
    assert bad["error"] == "ZeroDivisionError" and bad["findings"] == []


def test_grounded_entities(spark):
    df = spark.createDataFrame([("Ann Lee saw Ann", [("person", "Ann"), ("person", "Ann Lee"), ("colour", "saw"), ("email", " "), ("email", "no@where")])], "text string, entities array<struct<label:string,value:string>>")
    assert [(f["start"], f["end"]) for f in detect.grounded_entities(df).first()["findings"]] == [(0, 7), (12, 15)]
