"""Registered queries over the driver's tables and their SQL twins.

Stand-ins for the clickstream: an event's shop is ``props.k``, its money is ``value`` on purchases; orders are the versions of
a customer's record; documents are chat messages of four applications.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import city
from .functions import scalars as X
from .functions import states
from .operators import detect, evidence, kinds, policy, ranks, redact
from .plans.queries import parameterised, time_filter
from .session import read_table
from .sources import generators

MONEY = "decimal(18,2)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("tenant_id"), F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0).cast("decimal(12,2)").alias("revenue"))


_E = """WITH e AS (SELECT event_id, ts, user_id, event_type, value, json_extract_string(props, '$.k')::INT AS tenant_id,
    CAST(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS DECIMAL(12,2)) AS revenue FROM events) """


def _sum(c: str | Column) -> Column:
    """An exact sum, shown as a double."""
    return F.sum(c).cast(MONEY).cast("double")


# -- dashboards


def q_shop_week(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    own = e.where((F.col("tenant_id") == 42) & time_filter("ts", "2024-01-08", "2024-01-15"))
    return own.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), _sum("revenue").alias("revenue")).orderBy(F.desc("events"), "event_type")


def q_shop_week_sql(spark: SparkSession, d: str) -> DataFrame:
    _events(spark, d).createOrReplaceTempView("tidewell_events")
    return parameterised(spark, "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM IDENTIFIER(:t) WHERE tenant_id = :tenant AND ts >= :since::timestamp_ntz GROUP BY event_type ORDER BY 2 DESC", t="tidewell_events", tenant=7, since="2024-01-10 00:00:00")


def q_funnel_last7d(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    last = e.where(F.col("ts") > e.agg(F.max("ts")).scalar() - F.expr("INTERVAL 7 DAYS"))
    return last.where(F.col("event_type").isin("view", "click", "purchase")).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))


def q_top_shops(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("tenant_id").agg(_sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("events")).orderBy(F.desc("revenue"), "tenant_id").limit(10)


def q_top_users(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("tenant_id = 1").groupBy("user_id").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "user_id").limit(5)


def q_revenue_per_hour(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("event_type = 'purchase'").groupBy(X.start_of("hour", "ts").alias("hour")).agg(_sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("orders"))


def q_events_per_minute(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy(X.start_of("minute", "ts").alias("minute"), "event_type").agg(F.count(F.lit(1)).alias("events"))


def q_revenue_by_tier(spark: SparkSession, d: str) -> DataFrame:
    tiers = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    orders = read_table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").cast(MONEY).alias("price"))
    return kinds.dictionary_get(orders, tiers, "o_custkey", ["c_mktsegment"], "c_custkey").groupBy(F.col("c_mktsegment").alias("tier")).agg(_sum("price").alias("revenue"), F.count(F.lit(1)).alias("orders"))


def q_top_products(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").groupBy("l_partkey").agg(_sum(F.col("l_extendedprice").cast(MONEY)).alias("revenue"), F.count(F.lit(1)).alias("lines")).orderBy(F.desc("revenue"), "l_partkey").limit(100)


def q_user_timeline(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, d).where("user_id = 17").select("event_id", "ts", "event_type", "tenant_id", F.row_number().over(w).alias("step"))


def q_filters(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    return p.where((F.col("p_name").like("%a\\_%") | F.col("p_type").ilike("%econ%")) & ~F.col("p_brand").ilike("%#1%") & F.col("p_size").isin(1, 5, 9, 14, 20)).select(F.lit("FINAL").alias("how"), "*")


def q_lateral_alias(spark: SparkSession, d: str) -> DataFrame:
    read_table(spark, d, "orders").createOrReplaceTempView("tidewell_orders")
    return spark.sql("SELECT o_orderkey, o_orderkey % 7 AS m, m + 1 AS n, IF(n > 3, 'high', 'low') AS side FROM tidewell_orders")


def q_parts_pressure_shape(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("parts")).where("parts > 100")


def q_kth_value_offset(spark: SparkSession, d: str) -> DataFrame:
    return ranks.kth_row(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 1000, ["o_totalprice", "o_orderkey"])


def q_counts_min_max(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.bool_or(F.col("value") > 100).alias("large"), F.count_if(F.col("tenant_id") < 10).alias("small_shops"))


def q_ratio(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").groupBy("l_returnflag").agg(X.ratio(F.sum(F.col("l_extendedprice").cast(MONEY)), F.sum(F.col("l_quantity").cast(MONEY))).cast("double").alias("ratio"))


def q_case_tiers(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "customer")
    return s.groupBy(X.multi_if((F.col("c_custkey") < 20, "enterprise"), (F.col("c_custkey") < 200, "pro"), otherwise="free").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def q_readable_size(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes")).withColumn("size", X.readable_size("bytes"))


def q_extract(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.substring("url", 1, 20).alias("head"), X.has_token(F.col("html"), "div").alias("has_div"))


def q_offsets(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", X.byte_offset(F.col("text"), F.lit(20)).cast("long").alias("bytes20"), F.sha2("text", 256).alias("sha"))


def q_shard_counts(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy(X.shard_number("tenant_id", 4).alias("shard")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("tenant_id").alias("tenants"))


def q_clickstream(spark: SparkSession, d: str) -> DataFrame:
    return generators.clickstream(spark, _events(spark, d).count()).groupBy("event_type", "device").agg(F.count(F.lit(1)).alias("n"), _sum("revenue").alias("revenue"))


def q_shops(spark: SparkSession, d: str) -> DataFrame:
    """A shop for every customer."""
    return generators.shops(spark, read_table(spark, d, "customer").count())


# -- table kinds and states


def q_latest_version(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").withColumn("gone", F.col("o_orderstatus") == "F")
    return kinds.latest(o.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "gone"), ["o_custkey"], "o_orderdate", "gone", "o_orderkey")


def q_argmax_having(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").withColumn("v", F.struct("o_orderdate", "o_orderkey"))
    return o.groupBy("o_custkey").agg(F.max_by("o_orderpriority", "v").alias("priority"), F.max_by("o_orderstatus", "v").alias("status")).where("status = 'O'").drop("status")


def q_daily_revenue_summing(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where("event_type = 'purchase'").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "tenant_id", F.lit(1).cast("long").alias("orders"), F.col("revenue").cast(MONEY).alias("revenue"), F.pmod("event_id", F.lit(3)).alias("block"))
    blocks = kinds.summed(e, ["block", "day", "tenant_id"], ["orders", "revenue"])  # as three inserts would leave it
    return kinds.summed(blocks.drop("block"), ["day", "tenant_id"], ["orders", "revenue"]).withColumn("revenue", F.col("revenue").cast("double"))


def _minute_states(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("duration", F.col("event_id") % 1000)
    return states.partial(e, ["tenant_id", "event_type", X.start_of("minute", "ts").alias("minute")], "user_id", "revenue", "duration")


def q_rollup_merge_exact(spark: SparkSession, d: str) -> DataFrame:
    return _minute_states(spark, d).groupBy("tenant_id", X.start_of("hour", "minute").alias("hour")).agg(states.count_merge("events").alias("events"), states.sum_merge("revenue").cast(MONEY).cast("double").alias("revenue"))


def q_rollup_states_hourly(spark: SparkSession, d: str) -> DataFrame:
    hourly = states.rolled(_minute_states(spark, d), ["tenant_id", X.start_of("hour", "minute").alias("hour")])
    return states.finished(hourly, ["tenant_id"])


def q_uniq_hll(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


def q_p95_exact(spark: SparkSession, d: str) -> DataFrame:
    return ranks.percentiles(_events(spark, d), ["event_type"], "value", {"p95": 0.95}).select("event_type", F.round("p95", 6).alias("p95"))


def q_ttl_delete(spark: SparkSession, d: str) -> DataFrame:
    return kinds.expired_out(_events(spark, d), "ts", F.lit("2024-01-31").cast("timestamp_ntz"), "10 days").groupBy("event_type").agg(F.count(F.lit(1)).alias("left"))


def q_ttl_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("ts", "tenant_id", F.col("revenue").cast(MONEY).alias("revenue"))
    out = kinds.expired_rolled_up(e, "ts", F.lit("2024-01-31").cast("timestamp_ntz"), "10 days", ["tenant_id"], ["revenue"])
    return out.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("rows"), _sum("revenue").alias("revenue"))


def q_ttl_clear(spark: SparkSession, d: str) -> DataFrame:
    return kinds.expired_cleared(_events(spark, d), "ts", F.lit("2024-01-31").cast("timestamp_ntz"), "10 days", "value").agg(F.count("value").alias("kept"), F.count(F.lit(1)).alias("rows"))


def q_partition_counts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").groupBy(X.yyyymm("o_orderdate").alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def q_latency_report(spark: SparkSession, d: str) -> DataFrame:
    return evidence.latency_report(_events(spark, d), ["event_type"], "value").select("event_type", "n", "least", "most", "p50", "p95", "p99")


def q_counter_increase(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("v")).withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "v")))
    return evidence.increase(o.withColumn("at", F.timestamp_seconds("n")), ["o_custkey"], "at", "v").where("increase is not null").select("o_custkey", "v", "increase")


def q_health_status(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return read_table(spark, d, "supplier").select("s_suppkey", evidence.replica_status(c("s_suppkey") % 17 == 0, c("s_suppkey") % 19 == 0, c("s_suppkey") * 7 % 500, c("s_suppkey") % 3, F.lit(2)).alias("status"))


# -- personal data


def _findings(spark: SparkSession, d: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    t = read_table(spark, d, table).select(key, F.col(text).alias("text"))
    return detect.with_findings(t)


def _pattern_counts(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        n = F.coalesce(detect.match_counts("text")[kind].cast("long"), F.lit(0))
        return read_table(spark, d, "documents").select("doc_id", n.alias("n"))

    return run


def q_pii_luhn_cards(spark: SparkSession, d: str) -> DataFrame:
    p = X.ascii_boundaries(detect.PATTERNS["pci.card_number"])
    hits = read_table(spark, d, "documents").where(F.col("text").rlike(p)).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(p), 0)).alias("value"))
    return hits.select("doc_id", "value", detect.luhn(F.col("value")).alias("valid"))


def q_pii_findings(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).select("doc_id", F.inline("findings")).select("doc_id", "type", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "value")


def q_pii_findings_pages(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d, "pages", "page_id", "html").select("page_id", F.inline("findings")).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


def q_pii_findings_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).select(F.inline("findings")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def q_redacted_docs(spark: SparkSession, d: str) -> DataFrame:
    out = redact.redacted(_findings(spark, d), everywhere=False)
    return out.where("redacted > 0").select("doc_id", "redacted_text", "redacted")


def q_redact_restore(spark: SparkSession, d: str) -> DataFrame:
    out = redact.redacted(_findings(spark, d), style="suffix")
    back = redact.restored("redacted_text", "vault") == F.col("text")
    return out.where("redacted > 0").select("doc_id", back.alias("same"))


# -- policy

POLICY = """policy_id: POL-DEMO-001
version: "1.0"
approvers: [security]
statements:
  - {id: "1.1", enforced_by: gateway, applies_when: [{field: destination.hosting, equals: external}], unless: [{field: app.approved_for, contains: personal-data}], detect: [pii.email, pii.phone, pii.national_id], action: redact, on_check_failure: closed}
  - {id: "1.2", enforced_by: gateway, detect: [pci.card_number, secret.api_key], action: block, on_check_failure: closed}
"""
RUNTIME = policy.Runtime(({"policy_id": "POL-DEMO-001", "statement": "1.1", "app": "claims-assistant", "expires": "2027-01-31T00:00:00Z"},), {("support-bot", "POL-DEMO-001"): "monitor"})
APPS = ["sales-copilot", "support-bot", "hr-assistant", "claims-assistant"]


def _requests(spark: SparkSession, d: str) -> DataFrame:
    doc = read_table(spark, d, "documents")
    app = X.pick(APPS, F.pmod("doc_id", F.lit(4)))
    return doc.select(F.col("doc_id").alias("request_id"), app.alias("app_id"), F.when(app == "hr-assistant", F.array(F.lit("personal-data"))).otherwise(F.array().cast("array<string>")).alias("app_approved_for"), F.when(F.pmod("doc_id", F.lit(5)) == 0, "self-hosted").otherwise("external").alias("destination_hosting"), F.lit("provider-a").alias("destination_provider"))


def _decisions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = _requests(spark, d)
    f = _findings(spark, d).select(F.col("doc_id").alias("request_id"), F.inline("findings"))
    return r, policy.decisions(r, f, [policy.compiled(POLICY)], RUNTIME, "2026-12-01T00:00:00Z")


def q_policy_decisions(spark: SparkSession, d: str) -> DataFrame:
    _, made = _decisions(spark, d)
    return made.select("request_id", "statement", "action", "mode", F.size("finding_ids").cast("long").alias("findings"))


def q_policy_enforcement(spark: SparkSession, d: str) -> DataFrame:
    r, made = _decisions(spark, d)
    return policy.enforced(r, made).groupBy("app_id", "status", "action").agg(F.count(F.lit(1)).alias("requests"))


def q_audit_counts(spark: SparkSession, d: str) -> DataFrame:
    r, made = _decisions(spark, d)
    records = policy.audit(made, r, "demo")
    return records.select("app", "statement", "mode", F.explode("finding_types").alias("type", "n")).groupBy("app", "statement", "mode", "type").agg(F.sum("n").alias("n"))


def q_policy_dry_run(spark: SparkSession, d: str) -> DataFrame:
    r, made = _decisions(spark, d)
    return evidence.dry_run(r, made)


def q_policy_monthly_rollup(spark: SparkSession, d: str) -> DataFrame:
    _, made = _decisions(spark, d)
    dated = made.withColumn("at", F.make_timestamp(F.lit(2026), F.pmod("request_id", F.lit(3)).cast("int") + 9, F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return evidence.period_rollup(dated).select(F.col("period").cast("string").alias("period"), "statement", "evaluated", "redacted", "blocked", "monitor_only")


QUERIES = {
    **{f.__name__: f for f in (
        q_shop_week, q_shop_week_sql, q_funnel_last7d, q_top_shops, q_top_users, q_revenue_per_hour, q_events_per_minute, q_revenue_by_tier, q_top_products, q_user_timeline,
        q_filters, q_lateral_alias, q_parts_pressure_shape, q_kth_value_offset, q_counts_min_max, q_ratio, q_case_tiers, q_readable_size, q_extract, q_offsets, q_shard_counts, q_clickstream, q_shops,
        q_latest_version, q_argmax_having, q_daily_revenue_summing, q_rollup_merge_exact, q_rollup_states_hourly, q_uniq_hll, q_p95_exact, q_ttl_delete, q_ttl_rollup, q_ttl_clear, q_partition_counts,
        q_latency_report, q_counter_increase, q_health_status,
        q_pii_luhn_cards, q_pii_findings, q_pii_findings_pages, q_pii_findings_by_type, q_redacted_docs, q_redact_restore,
        q_policy_decisions, q_policy_enforcement, q_audit_counts, q_policy_dry_run, q_policy_monthly_rollup,
    )},
    **{f"q_pii_{name}_counts": _pattern_counts(kind) for name, kind in (("email", "pii.email"), ("phone", "pii.phone"), ("ssn", "pii.national_id"), ("card", "pci.card_number"), ("key", "secret.api_key"))},
}


# -- twins


def _found_sql(table: str, key: str, text: str) -> str:
    """CTEs f(key, type, s, e, value): matches with offsets by detector, each less those that overlap a detector before it."""
    out = [f"t AS (SELECT {key} AS k, {text} AS x FROM {table})"]
    done: list[str] = []
    for i, (kind, p) in enumerate(detect.PATTERNS.items()):
        out.append(f"""h{i} AS (SELECT k, regexp_extract_all(x, '{p}') AS hits, regexp_split_to_array(x, '{p}') AS gaps FROM t WHERE regexp_matches(x, '{p}'))""")
        out.append(f"""u{i} AS (SELECT k, hits[j] AS value, j, hits, gaps FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS j FROM h{i}))""")
        check = ""
        if kind == "pci.card_number":
            check = """AND length(regexp_replace(value, '[^0-9]', '', 'g')) >= 13 AND list_sum(list_transform(range(1, length(regexp_replace(value, '[^0-9]', '', 'g')) + 1),
                lambda q: CASE WHEN q % 2 = 1 THEN substr(reverse(regexp_replace(value, '[^0-9]', '', 'g')), q, 1)::INT
                ELSE (substr(reverse(regexp_replace(value, '[^0-9]', '', 'g')), q, 1)::INT * 2) // 10 + (substr(reverse(regexp_replace(value, '[^0-9]', '', 'g')), q, 1)::INT * 2) % 10 END)) % 10 = 0"""
        out.append(f"""m{i} AS (SELECT k, '{kind}' AS type, value,
            coalesce(list_sum(list_transform(gaps[1:j], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:j - 1], lambda g: length(g))), 0) AS s FROM u{i} WHERE true {check})""")
        if done:
            before = " UNION ALL ".join(f"SELECT * FROM {a}" for a in done)
            out.append(f"a{i} AS (SELECT k, type, value, s::BIGINT AS s, (s + length(value))::BIGINT AS e FROM m{i} m WHERE NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.k = m.k AND m.s < b.e AND b.s < m.s + length(m.value)))")
        else:
            out.append(f"a{i} AS (SELECT k, type, value, s::BIGINT AS s, (s + length(value))::BIGINT AS e FROM m{i})")
        done.append(f"a{i}")
    out.append("f AS (" + " UNION ALL ".join(f"SELECT * FROM {a}" for a in done) + ")")
    return ", ".join(out)


_F = _found_sql("documents", "doc_id", "text")
_APP = "CASE doc_id % 4 WHEN 0 THEN 'sales-copilot' WHEN 1 THEN 'support-bot' WHEN 2 THEN 'hr-assistant' ELSE 'claims-assistant' END"
_D = f"""WITH {_F},
    r AS (SELECT doc_id AS k, {_APP} AS app, CASE WHEN doc_id % 5 = 0 THEN 'self-hosted' ELSE 'external' END AS hosting FROM documents),
    d AS (SELECT r.k AS request_id, app, CASE WHEN type IN ('pci.card_number', 'secret.api_key') THEN '1.2' ELSE '1.1' END AS statement,
        CASE WHEN type IN ('pci.card_number', 'secret.api_key') THEN 'block' ELSE 'redact' END AS action,
        CASE WHEN app = 'support-bot' THEN 'monitor' ELSE 'enforce' END AS mode, type
        FROM f JOIN r ON f.k = r.k
        WHERE type IN ('pci.card_number', 'secret.api_key') OR (hosting = 'external' AND app NOT IN ('hr-assistant', 'claims-assistant')))"""
_M = "DECIMAL(18,2)"

SQL = {
    "q_shop_week": _E + f"SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, sum(revenue)::{_M}::DOUBLE AS revenue FROM e WHERE tenant_id = 42 AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY event_type",
    "q_shop_week_sql": _E + "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM e WHERE tenant_id = 7 AND ts >= TIMESTAMP '2024-01-10' GROUP BY event_type",
    "q_funnel_last7d": _E + "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM e WHERE ts > (SELECT max(ts) FROM e) - INTERVAL 7 DAY AND event_type IN ('view', 'click', 'purchase') GROUP BY event_type",
    "q_top_shops": _E + f"SELECT tenant_id, sum(revenue)::{_M}::DOUBLE AS revenue, count(*) AS events FROM e GROUP BY tenant_id ORDER BY revenue DESC, tenant_id LIMIT 10",
    "q_top_users": _E + "SELECT user_id, count(*) AS c FROM e WHERE tenant_id = 1 GROUP BY user_id ORDER BY c DESC, user_id LIMIT 5",
    "q_revenue_per_hour": _E + f"SELECT date_trunc('hour', ts) AS hour, sum(revenue)::{_M}::DOUBLE AS revenue, count(*) AS orders FROM e WHERE event_type = 'purchase' GROUP BY 1",
    "q_events_per_minute": _E + "SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS events FROM e GROUP BY 1, 2",
    "q_revenue_by_tier": f"SELECT coalesce(c_mktsegment, '') AS tier, sum(o_totalprice::{_M})::{_M}::DOUBLE AS revenue, count(*) AS orders FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "q_top_products": f"SELECT l_partkey, sum(l_extendedprice::{_M})::{_M}::DOUBLE AS revenue, count(*) AS lines FROM lineitem GROUP BY 1 ORDER BY revenue DESC, l_partkey LIMIT 100",
    "q_user_timeline": _E + "SELECT event_id, ts, event_type, tenant_id, row_number() OVER (ORDER BY ts, event_id)::INT AS step FROM e WHERE user_id = 17",
    "q_filters": r"SELECT 'FINAL' AS how, * FROM part WHERE (p_name LIKE '%a\_%' ESCAPE '\' OR p_type ILIKE '%econ%') AND p_brand NOT ILIKE '%#1%' AND p_size IN (1, 5, 9, 14, 20)",
    "q_lateral_alias": "SELECT o_orderkey, o_orderkey % 7 AS m, o_orderkey % 7 + 1 AS n, CASE WHEN o_orderkey % 7 + 1 > 3 THEN 'high' ELSE 'low' END AS side FROM orders",
    "q_parts_pressure_shape": "SELECT l_suppkey, l_returnflag, count(*) AS parts FROM lineitem GROUP BY 1, 2 HAVING count(*) > 100",
    "q_kth_value_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 1000",
    "q_counts_min_max": _E + "SELECT event_type, count(*) AS rows, min(ts) AS first, max(ts) AS last, bool_or(value > 100) AS large, count(*) FILTER (tenant_id < 10) AS small_shops FROM e GROUP BY 1",
    "q_ratio": f"SELECT l_returnflag, round((sum(l_extendedprice::{_M})::DOUBLE / sum(l_quantity::{_M})::DOUBLE), 1) AS ratio FROM lineitem GROUP BY 1",
    "q_case_tiers": "SELECT CASE WHEN c_custkey < 20 THEN 'enterprise' WHEN c_custkey < 200 THEN 'pro' ELSE 'free' END AS tier, count(*) AS n FROM customer GROUP BY 1",
    "q_readable_size": "SELECT source, sum(strlen(text))::BIGINT AS bytes, CASE WHEN sum(strlen(text)) >= 1048576 THEN printf('%.2f MiB', sum(strlen(text)) / 1048576.0) WHEN sum(strlen(text)) >= 1024 THEN printf('%.2f KiB', sum(strlen(text)) / 1024.0) ELSE printf('%.2f B', sum(strlen(text))::DOUBLE) END AS size FROM documents GROUP BY source",
    "q_extract": r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, substr(url, 1, 20) AS head, list_contains(regexp_split_to_array(html, '[^0-9A-Za-z_]+'), 'div') AS has_div FROM pages",
    "q_offsets": "SELECT doc_id, strlen(substr(text, 1, 20))::BIGINT AS bytes20, sha256(text) AS sha FROM documents",
    "q_shops": f"""SELECT (number + 1)::INT AS tenant_id, ({generators.SHOP_FIRST})[1 + number % 8] || ' ' || ({generators.SHOP_SECOND})[1 + (number // 8) % 6] || ' #' || (number + 1) AS name,
        CASE WHEN number < 20 THEN 'enterprise' WHEN number < 200 THEN 'pro' ELSE 'free' END AS tier, ({generators.COUNTRIES})[1 + (h % 10)::INT] AS country
        FROM ({city.hash_sql("SELECT unnest(range((SELECT count(*) FROM customer))) AS number", "number")})""",
    "q_shard_counts": _E + f"SELECT (h % 4 + 1)::INT AS shard, count(*) AS rows, count(DISTINCT tenant_id) AS tenants FROM ({city.hash_sql('SELECT tenant_id FROM e', 'tenant_id')}) GROUP BY 1",
    "q_clickstream": f"""SELECT event_type, device, count(*) AS n, sum(CASE event_type WHEN 'purchase' THEN cents ELSE 0 END)::DOUBLE / 100 AS revenue FROM (
        SELECT number, ({generators.EVENT_MIX})[1 + max(h % 10) FILTER (seed = 3)::INT] AS event_type, ({generators.DEVICES})[1 + max(h % 4) FILTER (seed = 5)::INT] AS device, max(h % 50000) FILTER (seed = 8) AS cents
        FROM ({city.hash_sql("SELECT unnest(range((SELECT count(*) FROM events))) AS number", "number", (3, 5, 8))}) GROUP BY number) GROUP BY ALL""",
    "q_latest_version": "SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1 AND o_orderstatus <> 'F'",
    "q_argmax_having": "SELECT o_custkey, o_orderpriority AS priority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1 AND o_orderstatus = 'O'",
    "q_daily_revenue_summing": _E + f"SELECT strftime(ts, '%Y-%m-%d') AS day, tenant_id, count(*) AS orders, sum(revenue)::{_M}::DOUBLE AS revenue FROM e WHERE event_type = 'purchase' GROUP BY 1, 2",
    "q_rollup_merge_exact": _E + f"SELECT tenant_id, date_trunc('hour', ts) AS hour, count(*) AS events, sum(revenue)::{_M}::DOUBLE AS revenue FROM e GROUP BY 1, 2",
    "q_p95_exact": _E + "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM e GROUP BY 1",
    "q_ttl_delete": _E + "SELECT event_type, count(*) AS left FROM e WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY GROUP BY 1",
    "q_ttl_rollup": _E + f"""SELECT tenant_id, count(*) AS rows, sum(revenue)::{_M}::DOUBLE AS revenue FROM (
        SELECT tenant_id, revenue FROM e WHERE ts >= TIMESTAMP '2024-01-21' UNION ALL SELECT tenant_id, sum(revenue) FROM e WHERE ts < TIMESTAMP '2024-01-21' GROUP BY tenant_id, ts::DATE) GROUP BY 1""",
    "q_ttl_clear": _E + "SELECT count(value) FILTER (ts >= TIMESTAMP '2024-01-21') AS kept, count(*) AS rows FROM e",
    "q_partition_counts": "SELECT strftime(o_orderdate, '%Y%m')::INT AS partition, count(*) AS rows FROM orders GROUP BY 1",
    "q_latency_report": _E + """SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, list_sort(list(value))[1 + least(count(*) - 1, floor(count(*) * 0.5)::BIGINT)] AS p50,
        list_sort(list(value))[1 + least(count(*) - 1, floor(count(*) * 0.95)::BIGINT)] AS p95, list_sort(list(value))[1 + least(count(*) - 1, floor(count(*) * 0.99)::BIGINT)] AS p99 FROM e WHERE value IS NOT NULL GROUP BY 1""",
    "q_counter_increase": "SELECT o_custkey, o_orderkey AS v, CASE WHEN o_orderkey < b THEN o_orderkey ELSE o_orderkey - b END AS increase FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL",
    "q_health_status": "SELECT s_suppkey, CASE WHEN s_suppkey % 17 = 0 OR s_suppkey % 19 = 0 THEN 'READONLY' WHEN s_suppkey * 7 % 500 > 300 THEN 'LAGGING' WHEN s_suppkey % 3 < 2 THEN 'DEGRADED' ELSE 'OK' END AS status FROM supplier",
    "q_pii_luhn_cards": rf"""SELECT doc_id, value, length(regexp_replace(value, '[^0-9]', '', 'g')) >= 13 AND list_sum(list_transform(range(1, length(regexp_replace(value, '[^0-9]', '', 'g')) + 1),
        lambda q: CASE WHEN q % 2 = 1 THEN substr(reverse(regexp_replace(value, '[^0-9]', '', 'g')), q, 1)::INT
        ELSE (substr(reverse(regexp_replace(value, '[^0-9]', '', 'g')), q, 1)::INT * 2) // 10 + (substr(reverse(regexp_replace(value, '[^0-9]', '', 'g')), q, 1)::INT * 2) % 10 END)) % 10 = 0 AS valid
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{detect.PATTERNS["pci.card_number"]}')) AS value FROM documents)""",
    "q_pii_findings": f"WITH {_F} SELECT k AS doc_id, type, s AS start_at, e AS end_at, value FROM f",
    "q_pii_findings_pages": f"WITH {_found_sql('pages', 'page_id', 'html')} SELECT type, count(*) AS n, count(DISTINCT k) AS pages FROM f GROUP BY type",
    "q_pii_findings_by_type": f"WITH {_F} SELECT type, count(*) AS n FROM f GROUP BY type",
    "q_redact_restore": f"WITH {_F} SELECT k AS doc_id, true AS same FROM f GROUP BY k",
    "q_policy_decisions": _D + " SELECT request_id, statement, action, mode, count(*) AS findings FROM d GROUP BY 1, 2, 3, 4",
    "q_policy_enforcement": _D + """, p AS (SELECT request_id, bool_or(mode = 'enforce' AND action = 'block') AS b, bool_or(mode = 'enforce' AND action = 'redact') AS x, bool_or(mode = 'monitor') AS m FROM d GROUP BY 1)
        SELECT app AS app_id, CASE WHEN b THEN 403 ELSE 200 END AS status, CASE WHEN b THEN 'block' WHEN x THEN 'redact' WHEN m THEN 'monitor' ELSE 'pass' END AS action, count(*) AS requests
        FROM r LEFT JOIN p ON r.k = p.request_id GROUP BY 1, 2, 3""",
    "q_audit_counts": _D + " SELECT app, statement, mode, type, count(*) AS n FROM d GROUP BY 1, 2, 3, 4",
    "q_policy_dry_run": _D + """, s AS (SELECT app, count(*) AS evaluated FROM r GROUP BY app), g AS (SELECT DISTINCT request_id, app, statement, action FROM d)
        SELECT g.app, statement, evaluated, count(*) FILTER (action = 'redact') AS would_redact, count(*) FILTER (action = 'block') AS would_block FROM g JOIN s ON g.app = s.app GROUP BY 1, 2, 3""",
    "q_policy_monthly_rollup": _D + """, g AS (SELECT DISTINCT request_id, statement, action, mode FROM d)
        SELECT strftime(make_date(2026, (request_id % 3 + 9)::INT, 1), '%Y-%m-%d') AS period, statement, count(*) AS evaluated, count(*) FILTER (mode = 'enforce' AND action = 'redact') AS redacted,
        count(*) FILTER (mode = 'enforce' AND action = 'block') AS blocked, count(*) FILTER (mode = 'monitor') AS monitor_only FROM g GROUP BY 1, 2""",
    **{f"q_pii_{name}_counts": f"SELECT doc_id, coalesce(len(regexp_extract_all(text, '{detect.PATTERNS[kind]}')), 0)::BIGINT AS n FROM documents" for name, kind in (("email", "pii.email"), ("phone", "pii.phone"), ("ssn", "pii.national_id"), ("card", "pci.card_number"), ("key", "secret.api_key"))},
}
