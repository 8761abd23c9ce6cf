"""Registered queries over whole tables with SQL twins: issued numbers, named values, stored overlaps, ranges, chains, keyed tables.

The documents have few such numbers and names of their own, so that some queries add values by an SQL expression that both
sides read (``PLANTED``, ``NAMED``); the expression goes by the row's id, and every row takes part."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .cases import _ORDER, _redacted_sql
from .functions import scalars as X
from .functions import spans as S
from .functions.spans import barrier, located
from .operators import detect, evidence, gateway, identifiers, intervals, named_values, policy, policy_checks, redact
from .queries import _E, POLICY, RUNTIME, _events, _found_sql, _requests
from .session import read_table, scratch
from .sources import tables
from .sources.keyed import Keyed
from .streaming.ingest import Rollup, first_blocks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def case(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# -- issued numbers


def _number(size: int, step: int, begin: int) -> str:
    return f"lpad(cast((doc_id * {step} + {begin}) % {10**size} AS string), {size}, '0')"


_LETTER = "substr('ABCDEFGHJKLMNPRSTWXY', cast(doc_id * {0} % 20 AS int) + 1, 1)"
PLANTED = " || ".join([
    "coalesce(text, '')", "' acn '", _number(9, 7919, 123456789), "'. Tax file '", _number(9, 104729, 300000007), "', bank routing 0'", _number(8, 1299709, 21000021),
    "'. ABN '", _number(11, 15485863, 51824753556), "' medicare 2'", _number(9, 32452843, 123456701), "' npi 1'", _number(9, 49979687, 234567893), "' iban GB'", _number(2, 7, 29), "'WEST'", _number(14, 67867967, 12345698765432),
    "' nino '", _LETTER.format(3), "'B'", _number(6, 86028121, 123456), "'C beneficiary 1EG4-TE5-MK'", _number(2, 3, 72), "' passport '", _LETTER.format(7), _LETTER.format(11), _number(7, 982451653, 1234567), "' moved to SW1A 1A'", _LETTER.format(3),
    "' (address) with plate A'", _LETTER.format(7), "'51 '", _LETTER.format(3), "'BC', ' licence MORGA657054SM9'", _LETTER.format(3), _LETTER.format(7),
]).replace("'BC', ' licence", "'BC licence")


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '', 'g')"


def _sum(d: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"substr({d}, {i}, 1)::INT * {w}" for i, w in enumerate(weights, 1)) + ")"


def _luhn(d: str) -> str:
    return f"""list_sum(list_transform(range(1, length({d}) + 1), lambda q: CASE WHEN q % 2 = 1 THEN substr(reverse({d}), q, 1)::INT
        ELSE (substr(reverse({d}), q, 1)::INT * 2) // 10 + (substr(reverse({d}), q, 1)::INT * 2) % 10 END)) % 10 = 0"""


def _checks(value: str) -> dict[str, str]:
    d, code = _digits(value), f"upper(regexp_replace({value}, '[^0-9A-Za-z]', '', 'g'))"
    return {
        "AU_ABN": f"length({d}) = 11 AND ({_sum(d, identifiers.ABN_WEIGHTS)} - 10) % 89 = 0",
        "AU_ACN": f"length({d}) = 9 AND (10 - {_sum(d, identifiers.ACN_WEIGHTS)} % 10) % 10 = substr({d}, 9, 1)::INT",
        "AU_TFN": f"length({d}) = 9 AND {_sum(d, identifiers.TFN_WEIGHTS)} % 11 = 0",
        "AU_MEDICARE": f"length({d}) = 10 AND substr({d}, 1, 1) BETWEEN '2' AND '6' AND {_sum(d, identifiers.MEDICARE_WEIGHTS)} % 10 = substr({d}, 9, 1)::INT",
        "ABA_ROUTING_NUMBER": f"length({d}) = 9 AND {_sum(d, identifiers.ROUTING_WEIGHTS)} % 10 = 0",
        "US_NPI": f"length({d}) = 10 AND {_luhn(f'(80840 || {d})')}",
        "IBAN_CODE": f"length({code}) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(substr({code}, 5) || substr({code}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ord(c) - 48 ELSE ord(c) - 55 END), lambda r, n: (r * CASE WHEN n > 9 THEN 100 ELSE 10 END + n) % 97) = 1",
    }


def _matches_sql(name: str, pattern: str, source: str = "t") -> str:
    """CTE name(k, x, value, s): matches in texts t(k, x) with their places."""
    return f"""{name} AS (SELECT k, x, hits[j] AS value, coalesce(list_sum(list_transform(gaps[1:j], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:j - 1], lambda g: length(g))), 0) AS s
        FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS j FROM (SELECT k, x, regexp_extract_all(x, '{pattern}') AS hits, regexp_split_to_array(x, '{pattern}') AS gaps FROM {source} WHERE regexp_matches(x, '{pattern}'))))"""


def _entities_sql(texts: str) -> str:
    """CTEs t(k, x) and f(k, label, s, e, value, score)."""
    ctes, parts = [f"t AS ({texts})"], []
    for i, r in enumerate(identifiers.RECOGNISERS):
        ctes.append(_matches_sql(f"m{i}", r.pattern))
        score, where = "1.0::DOUBLE", "true"
        if r.check:
            where = _checks("value")[r.label]
        else:
            near = "(?i)\\b(?:" + "|".join(r.context) + ")\\b"
            score = f"CASE WHEN regexp_matches(substr(x, greatest(s - {detect.CONTEXT_CHARS}, 0)::BIGINT + 1, length(value) + {2 * detect.CONTEXT_CHARS}), '{near}') THEN {round(r.score + detect.CONTEXT_BOOST, 3)}::DOUBLE ELSE {r.score}::DOUBLE END"
        least = detect.THRESHOLDS.get(r.label, detect.DEFAULT_THRESHOLD)
        parts.append(f"SELECT * FROM (SELECT k, '{r.label}' AS label, s::BIGINT AS s, (s + length(value))::BIGINT AS e, value, {score} AS score FROM m{i} WHERE {where}) WHERE score >= {least}")
    ctes.append("f AS (" + " UNION ALL ".join(parts) + ")")
    return ", ".join(ctes)


def _entities(texts: DataFrame, key: str) -> DataFrame:
    found = identifiers.with_entities(texts).select(key, F.inline("entities"))
    return found.select(key, "label", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "value", "score")


@case(f"WITH {_entities_sql(f'SELECT doc_id AS k, {PLANTED} AS x FROM documents')} SELECT k AS doc_id, label, s AS start_at, e AS end_at, value, score FROM f")
def q_issued_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _entities(read_table(spark, d, "documents").select("doc_id", F.expr(PLANTED).alias("text")), "doc_id")


_PAGES = PLANTED.replace("doc_id", "page_id").replace("text", "html")


@case(f"WITH {_entities_sql(f'SELECT page_id AS k, {_PAGES} AS x FROM pages')} SELECT k AS page_id, label, s AS start_at, e AS end_at, value, score FROM f")
def q_issued_numbers_pages(spark: SparkSession, d: str) -> DataFrame:
    return _entities(read_table(spark, d, "pages").select("page_id", F.expr(_PAGES).alias("text")), "page_id")


_CUSTOMER = {n: f"lpad(cast((c_custkey * {step} + {begin}) % {10**n} AS string), {n}, '0')" for n, step, begin in ((9, 1299709, 123456780), (10, 15485863, 2123456701), (11, 32452843, 51824753556))}
_ISSUED = (("AU_ABN", 11), ("AU_ACN", 9), ("AU_TFN", 9), ("AU_MEDICARE", 10), ("ABA_ROUTING_NUMBER", 9), ("US_NPI", 10))


@case("SELECT c_custkey, " + ", ".join(f"{_checks(_CUSTOMER[n])[k]} AS {k.lower()}" for k, n in _ISSUED) + " FROM customer")
def q_customer_numbers(spark: SparkSession, d: str) -> DataFrame:
    check = {r.label: r.check for r in identifiers.RECOGNISERS}
    return read_table(spark, d, "customer").select("c_custkey", *[check[k](F.expr(_CUSTOMER[n])).alias(k.lower()) for k, n in _ISSUED])


@case(f"""WITH {_entities_sql(f'SELECT doc_id AS k, {PLANTED} AS x FROM documents')}, g AS (SELECT *, score * 1000000 + (e - s) AS weight FROM f)
    SELECT label, count(*) AS n, count(DISTINCT k) AS documents, count(*) FILTER (NOT EXISTS (SELECT 1 FROM g h WHERE h.k = g.k AND h.weight > g.weight AND h.s < g.e AND g.s < h.e)) AS strongest FROM g GROUP BY label""")
def q_issued_numbers_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Entities by label, and how many of them no stronger or longer one overlaps."""
    found = _entities(read_table(spark, d, "documents").select("doc_id", F.expr(PLANTED).alias("text")), "doc_id").select("doc_id", "label", "start_at", "end_at", (F.col("score") * 1000000 + (F.col("end_at") - F.col("start_at"))).alias("weight"))
    path = scratch(spark, "issued")  # both sides of the join and the counts read it
    found.write.parquet(path)
    e = spark.read.schema(found.schema).parquet(path)
    h = e.select(F.col("doc_id").alias("k"), F.col("start_at").alias("s"), F.col("end_at").alias("e"), F.col("weight").alias("w"))
    beaten = e.join(h, [F.col("doc_id") == F.col("k"), F.col("w") > F.col("weight"), F.col("s") < F.col("end_at"), F.col("start_at") < F.col("e")], "left_semi").groupBy(F.col("label").alias("l")).agg(F.count(F.lit(1)).alias("beaten"))
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))
    return n.join(beaten, F.col("label") == F.col("l"), "left").select("label", "n", "documents", (F.col("n") - F.coalesce("beaten", F.lit(0))).alias("strongest"))


# -- named values

#: Each document names a customer, a nation and a supplier, the customer twice.
NAMED = "coalesce(text, '') || ' ' || c_name || ' of ' || n_name || ', supplied by ' || s_name || '; ' || c_name"
_NAMED_SQL = f"""SELECT doc_id AS k, {NAMED} AS x FROM documents JOIN customer ON c_custkey = doc_id % (SELECT count(*) FROM customer) JOIN nation ON n_nationkey = doc_id % (SELECT count(*) FROM nation)
        JOIN supplier ON s_suppkey = doc_id % (SELECT count(*) FROM supplier)"""


def _occurrences_sql(values: str) -> str:
    """CTE o(k, value, s, e): every occurrence in t(k, x) of the values v(value), an equal one after it never overlapping."""
    return f"""v AS (SELECT DISTINCT value FROM ({values}) WHERE trim(value) <> ''),
        p AS (SELECT k, value, string_split(x, value) AS gaps FROM t JOIN v ON contains(x, value)),
        o AS (SELECT k, value, s, s + length(value) AS e FROM (SELECT k, value, (list_sum(list_transform(gaps[1:j], lambda g: length(g))) + (j - 1) * length(value))::BIGINT AS s FROM (SELECT *, unnest(range(1, len(gaps))) AS j FROM p)))"""


_NAMES = "SELECT c_name AS value FROM customer UNION ALL SELECT substr(c_name, 1, 14) FROM customer UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier UNION ALL SELECT ' '"


@case(f"""WITH t AS ({_NAMED_SQL}), {_occurrences_sql(_NAMES)}
    SELECT k AS doc_id, s AS start_at, e AS end_at, value FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.k = a.k AND b.e - b.s > a.e - a.s AND b.s < a.e AND a.s < b.e)""")
def q_named_values(spark: SparkSession, d: str) -> DataFrame:
    """All names of customers, nations and suppliers, and beginnings of customers' names, in one pass over the documents; the longest win."""
    c, n, s = (read_table(spark, d, t) for t in ("customer", "nation", "supplier"))
    sizes = [t.count() for t in (c, n, s)]
    docs = read_table(spark, d, "documents").select("doc_id", "text", *[F.pmod("doc_id", F.lit(k)).alias(f"_{i}") for i, k in enumerate(sizes)])
    texts = docs.join(c, F.col("_0") == F.col("c_custkey")).join(n, F.col("_1") == F.col("n_nationkey")).join(s, F.col("_2") == F.col("s_suppkey")).select("doc_id", F.expr(NAMED).alias("text"))
    values = c.select(F.col("c_name").alias("value")).unionByName(c.select(F.substring("c_name", 1, 14).alias("value"))).unionByName(n.select(F.col("n_name").alias("value"))).unionByName(s.select(F.col("s_name").alias("value"))).unionByName(spark.range(1).select(F.lit(" ").alias("value")))
    kept = named_values.longest_first(named_values.found(texts, values, "doc_id"), "doc_id")
    return kept.select("doc_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "value")


@case(f"WITH t AS (SELECT doc_id AS k, text AS x FROM documents), {_occurrences_sql('SELECT text AS value FROM benchmark')} SELECT k AS doc_id, s AS start_at, e AS end_at, value FROM o")
def q_benchmark_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Every literal occurrence of every benchmark text in the documents."""
    got = named_values.found(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"), "doc_id", value="text")
    return got.select("doc_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "value")


def _namer(text: str) -> list[tuple[str, str]]:
    return [("email", v) for v in re.findall(detect.PATTERNS["pii.email"], text)] + [("person", v) for v in re.findall("[A-Z][a-z]{8,}", text)]


@case(f"""WITH t AS (SELECT doc_id AS k, text AS x FROM documents), n AS (
        SELECT k, x, unnest(list_distinct(regexp_extract_all(x, '{detect.PATTERNS["pii.email"]}'))) AS value, 'pii.email' AS type FROM t UNION ALL
        SELECT k, x, unnest(list_distinct(regexp_extract_all(x, '[A-Z][a-z]{{8,}}'))), 'pii.name' FROM t),
    p AS (SELECT k, type, value, string_split(x, value) AS gaps FROM n),
    o AS (SELECT k, type, value, s, s + length(value) AS e FROM (SELECT k, type, value, (list_sum(list_transform(gaps[1:j], lambda g: length(g))) + (j - 1) * length(value))::BIGINT AS s FROM (SELECT *, unnest(range(1, len(gaps))) AS j FROM p)))
    SELECT k AS doc_id, type, s AS start_at, e AS end_at, value FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.k = a.k AND b.e - b.s > a.e - a.s AND b.s < a.e AND a.s < b.e)""")
def q_grounded_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    """What a (deterministic) model names in chunks, found in the whole texts."""
    found = detect.grounded_in_chunks(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id", _namer)
    return found.select("doc_id", F.inline("findings")).select("doc_id", "type", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "value")


# -- overlaps between relations


def _pattern_spans(spark: SparkSession, d: str, pattern: str) -> DataFrame:
    t = read_table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("x"))
    spans = barrier(t, _s=located(F.split("x", pattern, -1), F.regexp_extract_all("x", F.lit(pattern), F.lit(0))))
    return spans.select("page_id", F.inline("_s")).select("page_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value")


_TAGS, _NUMBERS = "<[a-z]+[^<>]*>", "[0-9]+"


@case(f"""WITH t AS (SELECT page_id AS k, html AS x FROM pages), {_matches_sql('a', _TAGS)}, {_matches_sql('b', _NUMBERS)}
    SELECT k AS page_id, s::BIGINT AS start, (s + length(value))::BIGINT AS end, value FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k AND a.s < b.s + length(b.value) AND b.s < a.s + length(a.value))""")
def q_overlap_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the pages outside their tags; both detectors' findings are relations."""
    return intervals.without_overlaps(_pattern_spans(spark, d, _NUMBERS), _pattern_spans(spark, d, _TAGS), ["page_id"])


# -- ranges and chains


@case(_E + """, s AS (SELECT tenant_id, ts, max(event_id % 500) AS v FROM e GROUP BY 1, 2),
    p AS (SELECT *, lag(v) OVER (PARTITION BY tenant_id ORDER BY ts) AS b FROM s),
    c AS (SELECT *, sum(CASE WHEN b IS NULL THEN 0 WHEN v < b THEN v ELSE v - b END) OVER (PARTITION BY tenant_id ORDER BY ts) AS c FROM p)
    SELECT tenant_id, ts, v, (c - first_value(c) OVER (PARTITION BY tenant_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW))::BIGINT AS increase FROM c""")
def q_counter_increase_range(spark: SparkSession, d: str) -> DataFrame:
    """Growth over the last twelve hours of a shop's counter that restarts."""
    s = _events(spark, d).groupBy("tenant_id", "ts").agg(F.max(F.col("event_id") % 500).alias("v"))
    return evidence.increase_over(s, ["tenant_id"], "ts", "v", 12 * 3600, slices=4)


@case("""WITH RECURSIVE o AS (SELECT conv_id, coalesce(text, '') AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    c AS (SELECT conv_id, i, p, '' AS prev_hash, sha256(p) AS hash FROM o WHERE i = 1 UNION ALL SELECT o.conv_id, o.i, o.p, c.hash, sha256(c.hash || o.p) FROM c JOIN o ON o.conv_id = c.conv_id AND o.i = c.i + 1),
    r AS (SELECT conv_id, i, CASE WHEN (conv_id * 7 + i) % 11 = 0 THEN p || '!' ELSE p END AS p, CASE WHEN (conv_id * 3 + i) % 5 = 0 THEN 'x' ELSE prev_hash END AS prev_hash,
        CASE WHEN (conv_id * 3 + i) % 5 = 0 THEN sha256('x' || p) WHEN (conv_id + i) % 13 = 0 THEN sha256(p || '?') ELSE hash END AS hash FROM c WHERE (conv_id * 5 + i) % 17 <> 0),
    b AS (SELECT r.conv_id, r.i, CASE WHEN r.i > 1 AND q.i IS NULL THEN 'missing' WHEN r.prev_hash <> CASE WHEN r.i = 1 THEN '' ELSE q.hash END THEN 'unlinked' WHEN r.hash <> sha256(r.prev_hash || r.p) THEN 'edited' END AS broken
        FROM r LEFT JOIN r q ON q.conv_id = r.conv_id AND q.i = r.i - 1)
    SELECT conv_id, min(i)::INT AS i, arg_min(broken, i) AS broken FROM b WHERE broken IS NOT NULL GROUP BY conv_id""")
def q_chain_breaks(spark: SparkSession, d: str) -> DataFrame:
    """The first row that breaks each conversation's chain, after edits, false hashes and deletions by the row's number."""
    own = read_table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    n = F.col("i")
    rows = evidence.hash_chained(evidence.numbered(own, "conv_id", "turn"), "conv_id", "i", "text")
    forged = rows.withColumn("prev_hash", F.when((F.col("conv_id") * 3 + n) % 5 == 0, "x").otherwise(F.col("prev_hash"))).withColumn("hash", F.when(F.col("prev_hash") == "x", F.sha2(F.concat(F.lit("x"), "text"), 256)).otherwise(F.col("hash"))).withColumn("hash", F.when(F.col("prev_hash") == "x", F.col("hash")).otherwise( F.when((F.col("conv_id") + n) % 13 == 0, F.sha2(F.concat("text", F.lit("?")), 256)).otherwise(F.col("hash"))))
    edited = forged.withColumn("text", F.when((F.col("conv_id") * 7 + n) % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return evidence.chain_breaks(edited.where((F.col("conv_id") * 5 + n) % 17 != 0), "conv_id", "i", "text")


# -- stored tables that merge by key


def _kept_at(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@case("""WITH l AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
    SELECT s AS state, o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM l, (VALUES ('appended'), ('merged')) v(s) WHERE n = 1 AND o_orderstatus <> 'F'""")
def q_keyed_versions(spark: SparkSession, d: str) -> DataFrame:
    """The newest order of each customer from a stored table of three appends, before and after its compaction."""
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", (F.col("o_orderstatus") == "F").alias("gone"))
    t = Keyed(spark, ["o_custkey"], version=("o_orderdate", "o_orderkey"), deleted="gone")
    for i in range(3):
        t.append(o.where(F.col("o_orderkey") % 3 == i))
    before = _kept_at(t.read().drop("gone"), "keyed")
    t.compact()
    return before.select(F.lit("appended").alias("state"), "*").unionByName(t.read().drop("gone").select(F.lit("merged").alias("state"), "*"))


@case(_E + """, g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, tenant_id, count(*) AS events, sum(revenue)::DECIMAL(18,2)::DOUBLE AS revenue FROM e GROUP BY 1, 2)
    SELECT s AS state, day, tenant_id, events, revenue FROM g, (VALUES ('appended'), ('merged')) v(s)""")
def q_keyed_sums(spark: SparkSession, d: str) -> DataFrame:
    """Daily sums of each shop from a stored table of three appends, before and after its compaction."""
    e = _events(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "tenant_id", F.lit(1).cast("long").alias("events"), F.col("revenue").cast("decimal(18,2)").alias("revenue"), F.pmod("event_id", F.lit(3)).alias("block"))
    t = Keyed(spark, ["tenant_id", "day"], sums=("events", "revenue"))
    for i in range(3):
        t.append(e.where(F.col("block") == i).groupBy("day", "tenant_id").agg(F.sum("events").alias("events"), F.sum("revenue").cast("decimal(18,2)").alias("revenue")))
    before = _kept_at(t.read(), "keyed")
    t.compact()
    both = before.select(F.lit("appended").alias("state"), "day", "tenant_id", "events", "revenue").unionByName(t.read().select(F.lit("merged").alias("state"), "day", "tenant_id", "events", "revenue"))
    return both.withColumn("revenue", F.col("revenue").cast("double"))


# -- requests through the gateway

_KEYS = [("gw-0", "sales-copilot", [], "external", "provider-a"), ("gw-1", "support-bot", [], "external", "provider-a"), ("gw-2", "hr-assistant", ["personal-data"], "external", "provider-a"), ("gw-3", "claims-assistant", [], "self-hosted", "own")]


@case("""WITH m AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1),
    o AS (SELECT conv_id, turns, CASE WHEN conv_id % 7 = 0 THEN 401 WHEN conv_id % 5 = 0 THEN 400 WHEN conv_id % 11 = 0 THEN 200 WHEN conv_id % 3 = 0 THEN 403 ELSE 200 END AS status FROM m)
    SELECT conv_id AS request_id, status,
        CASE WHEN status IN (400, 401) THEN 'reject' WHEN conv_id % 11 = 0 THEN 'pass' WHEN conv_id % 4 = 1 AND status = 403 THEN 'monitor' WHEN status = 403 THEN 'block' WHEN conv_id % 4 = 0 THEN 'redact' WHEN conv_id % 4 = 1 THEN 'monitor' ELSE 'pass' END AS action,
        CASE WHEN status = 200 AND conv_id % 11 <> 0 AND conv_id % 4 = 0 THEN turns ELSE 0 END AS masked, CASE WHEN status = 200 AND conv_id % 11 <> 0 AND conv_id % 4 <> 0 THEN turns ELSE 0 END AS open FROM o""".replace("WHEN conv_id % 3 = 0 THEN 403 ELSE 200 END AS status", "WHEN conv_id % 3 = 0 AND conv_id % 4 <> 1 THEN 403 ELSE 200 END AS status").replace("WHEN conv_id % 4 = 1 AND status = 403 THEN 'monitor' ", ""))
def q_gateway_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as chat requests, each turn with its reader's address, every third with a card: unknown keys, contents in parts, requests without messages, blocked, redacted and watched ones."""
    c = read_table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    card = F.when(F.col("conv_id") % 3 == 0, " card 4111 1111 1111 1111").otherwise("")
    said = F.concat("text", F.lit(" write u"), "conv_id", F.lit("@x.org"), card)
    turns = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", said.alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    whole = F.to_json(F.struct(F.lit("m").alias("model"), "messages"))
    parts = F.to_json(F.struct(F.lit("m").alias("model"), F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("text"))).alias("content"))).alias("messages")))
    raw = F.when(F.col("conv_id") % 5 == 0, parts).when(F.col("conv_id") % 11 == 0, '{"model":"m"}').otherwise(whole)
    key = F.when(F.col("conv_id") % 7 == 0, "gw-x").otherwise(F.concat(F.lit("gw-"), F.col("conv_id") % 4))
    requests = turns.select(F.col("conv_id").alias("request_id"), key.alias("key"), raw.alias("raw"), F.lit(None).cast("string").alias("upstream_error"))
    keys = spark.createDataFrame(_KEYS, "key string, app_id string, app_approved_for array<string>, destination_hosting string, destination_provider string")
    out = gateway.passed(requests, keys, [policy.compiled(POLICY)], RUNTIME, "2026-12-01T00:00:00Z")
    count = lambda what: F.coalesce(F.regexp_count("forwarded", F.lit(what)), F.lit(0)).cast("long")
    return out.select("request_id", "status", "action", count(r"\[EMAIL_1\]").alias("masked"), count(r"u[0-9]+@x\.org").alias("open"))


# -- personal data in whole tables, planted by row

SECRETS = "coalesce(text, '') || ' SSN ' || lpad(cast(doc_id * 7919 % 1000 AS string), 3, '0') || '-' || lpad(cast(doc_id * 31 % 100 AS string), 2, '0') || '-' || lpad(cast(doc_id * 104729 % 10000 AS string), 4, '0') || '; key sk-' || md5(cast(doc_id AS string)) || ' or AKIA' || upper(substr(md5(cast(doc_id + 1 AS string)), 1, 16)) || ', ünd u' || cast(doc_id % 13 AS string) || '@x.org, call +1 415-555-0134. ' || CASE doc_id % 3 WHEN 0 THEN 'licence NSW ' WHEN 1 THEN 'order ' ELSE 'driver ' END || lpad(cast(doc_id * 15485863 % 10000000 AS string), 7, '0') || ' card 4111 1111 1111 1' || lpad(cast(doc_id * 37 % 1000 AS string), 3, '0') || ' u' || cast(doc_id % 13 AS string) || '@x.org'"
_PLANTED = f"planted AS (SELECT doc_id AS k, {SECRETS} AS text FROM documents)"
_SAID = SECRETS.replace("doc_id", "conv_id")


def _planted(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.expr(SECRETS).alias("text"))


@case(f"""WITH {_PLANTED}, {_found_sql('planted', 'k', 'text')}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {_ORDER}, s) AS j FROM f)
    SELECT n.k AS doc_id, 'f' || j AS id, type, s AS start_at, e AS end_at, strlen(substr(x, 1, s::INT))::BIGINT AS byte_start, strlen(substr(x, 1, e::INT))::BIGINT AS byte_end, value FROM n JOIN t ON n.k = t.k""")
def q_planted_findings(spark: SparkSession, d: str) -> DataFrame:
    """All five detectors over every document: ids, characters, bytes."""
    found = detect.with_findings(_planted(spark, d)).select("doc_id", F.inline("findings"))
    return found.select("doc_id", "id", "type", *[F.col(a).cast("long").alias(b) for a, b in (("start", "start_at"), ("end", "end_at"), ("byte_start", "byte_start"), ("byte_end", "byte_end"))], "value")


@case(f"""WITH cases AS (SELECT conv_id * 1000 + turn AS k, conv_id, turn, {_SAID} AS text FROM conversations), {_found_sql('cases', 'k', 'text')}
    SELECT conv_id, turn, 'f' || row_number() OVER (PARTITION BY conv_id ORDER BY turn, {_ORDER}, s) AS id, type, value FROM f JOIN cases ON f.k = cases.k""")
def q_planted_message_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that count on through a conversation's turns."""
    t = read_table(spark, d, "conversations").select("conv_id", "turn", F.expr(_SAID).alias("text"))
    return detect.numbered_across_messages(detect.with_findings(t), "conv_id", "turn").select("conv_id", "turn", F.inline("findings")).select("conv_id", "turn", "id", "type", "value")


@case(_redacted_sql(f"{_PLANTED}, {_found_sql('planted', 'k', 'text')}", "doc_id"))
def q_planted_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact.redacted(detect.with_findings(_planted(spark, d)), everywhere=False).where("redacted > 0").select("doc_id", "redacted_text", "redacted")


@case(f"WITH {_PLANTED} SELECT k AS doc_id, sha256(text) AS restored FROM planted")
def q_planted_restored(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the texts restored from what was redacted and its vault."""
    out = redact.redacted(detect.with_findings(_planted(spark, d)), style="suffix")
    return out.select("doc_id", F.sha2(redact.restored("redacted_text", "vault"), 256).alias("restored"))


@case(f"WITH {_PLANTED} SELECT k AS doc_id, replace(text, 'u' || k % 13 || '@x.org', '[EMAIL_1]') AS redacted_text FROM planted")
def q_planted_everywhere(spark: SparkSession, d: str) -> DataFrame:
    """A value that one finding names goes wherever it stands."""
    value = F.concat(F.lit("u"), F.col("doc_id") % 13, F.lit("@x.org"))
    at = F.instr("text", value) - 1
    one = F.array(F.struct(F.lit("f1").alias("id"), F.lit("pii.email").alias("type"), at.alias("start"), (at + F.length(value)).alias("end"), F.lit(0).alias("byte_start"), F.lit(0).alias("byte_end"), value.alias("value")))
    return redact.redacted(_planted(spark, d).withColumn("findings", one.cast(f"array<{detect.FINDING}>"))).select("doc_id", "redacted_text")


def _licences_sql() -> str:
    near = "(?i)\\b(?:" + "|".join(detect.LICENCE_CONTEXT) + ")\\b"
    ctes = ", ".join(_matches_sql(f"m{i}", p) for i, (p, _) in enumerate(detect.LICENCE_PATTERNS))
    rows = " UNION ALL ".join(f"SELECT k, x, value, s, {score}::DOUBLE AS score FROM m{i}" for i, (_, score) in enumerate(detect.LICENCE_PATTERNS))
    return f"""WITH t AS (SELECT doc_id AS k, {SECRETS} AS x FROM documents), {ctes},
        b AS (SELECT k, value, s, round(score + CASE WHEN regexp_matches(substr(x, greatest(s - {detect.CONTEXT_CHARS}, 0)::BIGINT + 1, length(value) + {2 * detect.CONTEXT_CHARS}), '{near}') THEN {detect.CONTEXT_BOOST} ELSE 0 END, 3) AS score FROM ({rows}))
        SELECT k AS doc_id, value, s::INT AS start_at, score FROM b WHERE score >= {detect.DEFAULT_THRESHOLD}"""


@case(_licences_sql())
def q_planted_licences(spark: SparkSession, d: str) -> DataFrame:
    found = _planted(spark, d).select("doc_id", F.inline(detect.driver_licences(F.col("text"))))
    return found.select("doc_id", "value", F.col("start").alias("start_at"), "score")


@case(f"WITH t AS (SELECT doc_id AS k, {SECRETS} AS x FROM documents), " + ", ".join(_matches_sql(f"m{i}", p) for i, (p, _) in enumerate(detect.KEY_PATTERNS)) + " " + " UNION ALL ".join(f"SELECT k AS doc_id, 'API_KEY' AS label, value, s::INT AS start_at, {score}::DOUBLE AS score FROM m{i}" for i, (_, score) in enumerate(detect.KEY_PATTERNS)))
def q_planted_key_scores(spark: SparkSession, d: str) -> DataFrame:
    found = _planted(spark, d).select("doc_id", F.inline(detect.api_keys(F.col("text"))))
    return found.select("doc_id", "label", "value", F.col("start").alias("start_at"), "score")


_LABELS = list(detect.ENTITY_LABELS) + ["DATE_TIME"]
_LABEL_OF = "CASE doc_id % " + str(len(_LABELS)) + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_LABELS)) + " END"


@case(f"""WITH e AS (SELECT doc_id, {_LABEL_OF} AS label, doc_id * 37 % 100 / 100.0::DOUBLE AS score, substr({SECRETS}, 1, 4) AS value FROM documents)
    SELECT doc_id, CASE label {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in detect.ENTITY_LABELS.items())} END AS type, value FROM e
    WHERE label <> 'DATE_TIME' AND score >= CASE label {" ".join(f"WHEN '{k}' THEN {v}" for k, v in detect.THRESHOLDS.items())} ELSE {detect.DEFAULT_THRESHOLD} END""")
def q_recognised_labels(spark: SparkSession, d: str) -> DataFrame:
    """An entity a document, of every label and score: those of a known label that reach its threshold, as findings."""
    entity = F.struct(F.expr(_LABEL_OF).alias("label"), F.lit(0).alias("start"), F.lit(4).alias("end"), (F.col("doc_id") * 37 % 100 / F.lit(100.0)).alias("score"))
    return detect.recognised(_planted(spark, d).withColumn("entities", F.array(entity))).select("doc_id", F.inline("findings")).select("doc_id", "type", "value")


def _addresses(text: str) -> list[dict]:
    if len(text) % 17 == 0:
        raise TimeoutError
    return [{"type": "pii.email", "start": m.start(), "end": len(text) + 1 if len(text) % 19 == 0 else m.end(), "score": 0.9} for m in re.finditer(r"u[0-9]+@x\.org", text)]


@case(f"""WITH t AS (SELECT doc_id AS k, {SECRETS} AS x FROM documents), {_matches_sql('m', 'u[0-9]+@x[.]org')}
    SELECT k AS doc_id, CASE WHEN length(x) % 17 = 0 THEN 'TimeoutError' WHEN length(x) % 19 = 0 THEN 'ValueError' ELSE '' END AS error, CASE WHEN length(x) % 17 = 0 OR length(x) % 19 = 0 THEN -1 ELSE s END::INT AS start_at,
        CASE WHEN length(x) % 17 = 0 OR length(x) % 19 = 0 THEN -1 ELSE strlen(substr(x, 1, s::BIGINT)) END::INT AS byte_start FROM (SELECT DISTINCT k, x, CASE WHEN length(x) % 17 = 0 OR length(x) % 19 = 0 THEN 0 ELSE s END AS s FROM m)""")
def q_plugged_detector(spark: SparkSession, d: str) -> DataFrame:
    """A plugged-in detector that fails on some texts and misplaces spans in others: those rows are marked, not passed on unchecked."""
    out = detect.detected_by(_planted(spark, d), _addresses)
    return out.select("doc_id", F.coalesce("error", F.lit("")).alias("error"), F.inline_outer("findings")).select("doc_id", "error", F.coalesce("start", F.lit(-1)).alias("start_at"), F.coalesce("byte_start", F.lit(-1)).alias("byte_start"))


@case(f"""WITH {_PLANTED}, c AS (SELECT k, text, 'u' || k % 13 || '@x.org' AS value, CASE WHEN k % 2 = 0 THEN instr(text, 'u' || k % 13 || '@x.org') - 1 ELSE k % 50 END AS s FROM planted)
    SELECT k AS doc_id, (CASE WHEN k % 5 = 0 THEN -1 WHEN substr(text, s + 1, length(value)) = value THEN s ELSE instr(text, value) - 1 END)::INT AS start_at FROM c""")
def q_refound_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans at the right place, at a wrong one, or of values that aren't there."""
    value = F.concat(F.lit("u"), F.col("doc_id") % 13, F.lit("@x.org"))
    at = F.when(F.col("doc_id") % 2 == 0, F.instr("text", value) - 1).otherwise((F.col("doc_id") % 50).cast("int"))
    said = F.when(F.col("doc_id") % 5 == 0, F.concat(value, F.lit("#nowhere"))).otherwise(value)
    df = _planted(spark, d).withColumn("span", F.struct(at.alias("start"), (at + F.length(value)).alias("end"), said.alias("value")))
    return df.select("doc_id", F.coalesce(S.refound(F.col("text"), F.col("span"))["start"], F.lit(-1)).alias("start_at"))


@case("""SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN source END AS label, CASE WHEN doc_id % 4 < 2 THEN doc_id::INT ELSE -1 END AS n FROM documents""")
def q_fenced_replies(spark: SparkSession, d: str) -> DataFrame:
    """JSON in prose and fences, broken, or absent."""
    own = F.to_json(F.struct(F.col("source").alias("label"), F.col("doc_id").alias("n")))
    kind = F.col("doc_id") % 4
    reply = F.when(kind == 0, F.concat(F.lit("Sure:\n```json\n"), own, F.lit("\n```"))).when(kind == 1, own).when(kind == 2, "{oops}").otherwise("no object")
    df = read_table(spark, d, "documents").select("doc_id", X.fenced_json(reply, "label string, n int").alias("j"))
    return df.select("doc_id", "j.label", F.coalesce("j.n", F.lit(-1)).alias("n"))


# -- checks that fail

_OPEN = """policy_id: POL-OPEN-001
version: "2.0"
approvers: [security]
statements:
  - {id: "2.1", enforced_by: gateway, applies_when: [{field: destination.hosting, equals: external}], unless: [{field: app.approved_for, contains: personal-data}], detect: [pii.email, pii.phone, pii.national_id], action: redact, on_check_failure: open}
  - {id: "2.2", enforced_by: gateway, applies_when: [{field: destination.hosting, equals: self-hosted}], detect: [pci.card_number, secret.api_key], action: block, on_check_failure: closed}
"""
_GOES_ON = "doc_id % 7 = 0 AND doc_id % 5 <> 0 AND doc_id % 4 <> 2"


def _failed_checks(spark: SparkSession, d: str) -> DataFrame:
    return policy.failing_open(_requests(spark, d).withColumn("error", F.when(F.col("request_id") % 7 == 0, "Timeout")), [policy.compiled(_OPEN)])


@case(f"SELECT doc_id AS request_id, CASE WHEN doc_id % 7 = 0 AND NOT ({_GOES_ON}) THEN 503 ELSE 200 END AS status, CASE WHEN {_GOES_ON} THEN '2.1 skipped: Timeout' ELSE '' END AS skipped FROM documents")
def q_failed_checks(spark: SparkSession, d: str) -> DataFrame:
    """A seventh of the requests loses its check: those under statements that fail open go on, marked."""
    r = _failed_checks(spark, d)
    none = spark.createDataFrame([], "request_id long, policy_id string, statement string, action string, mode string, finding_ids array<string>")
    return policy.enforced(r, none).select("request_id", "status", F.array_join(F.transform("checks_skipped", lambda x: F.concat_ws(" ", x["statement"], x["check_status"])), ", ").alias("skipped"))


@case(f"""WITH {_PLANTED}, {_found_sql('planted', 'k', 'text')}, h AS (SELECT DISTINCT k AS doc_id, CASE WHEN type IN ('pci.card_number', 'secret.api_key') THEN '2.2' ELSE '2.1' END AS statement FROM f),
    d AS (SELECT * FROM h WHERE (doc_id % 7 <> 0 OR {_GOES_ON}) AND CASE statement WHEN '2.2' THEN doc_id % 5 = 0 ELSE doc_id % 5 <> 0 AND doc_id % 4 <> 2 END)
    SELECT statement, (count(*) + coalesce(any_value(s.n), 0))::BIGINT AS evaluated, count(*) FILTER (statement = '2.1') AS redacted, count(*) FILTER (statement = '2.2') AS blocked, coalesce(any_value(s.n), 0)::BIGINT AS skipped_checks
    FROM d LEFT JOIN (SELECT '2.1' AS statement, count(*) AS n FROM documents WHERE {_GOES_ON}) s USING (statement) GROUP BY statement""")
def q_skipped_check_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Decisions and skipped checks of all requests in one period's evidence."""
    r = _failed_checks(spark, d)
    found = detect.with_findings(_planted(spark, d)).select(F.col("doc_id").alias("request_id"), F.inline("findings"))
    made = policy.decisions(r.where("error IS NULL"), found, [policy.compiled(_OPEN)], policy.Runtime((), {}), "2026-12-01T00:00:00Z")
    skipped = policy.skip_records(r).select("policy_id", "policy_version", "statement", F.lit("none").alias("action"), F.lit("skipped").alias("mode"), "skipped")
    records = made.select("policy_id", "policy_version", "statement", "action", "mode", F.lit(False).alias("skipped")).unionByName(skipped).withColumn("at", F.lit("2026-12-01").cast("timestamp"))
    return evidence.period_rollup(records).select("statement", "evaluated", "redacted", "blocked", "skipped_checks")


# -- policies as relations


_PART = """SELECT CASE o_custkey % 5 WHEN 0 THEN 'pol-' ELSE 'POL-AI-' END || lpad(cast(o_custkey % 1000 AS string), 3, '0') AS policy_id,
    CASE o_custkey % 7 WHEN 0 THEN '' ELSE '1.' || cast(o_custkey % 3 AS string) END AS version, cast(o_custkey % 3 AS int) AS signers,
    CASE o_orderkey % 11 WHEN 0 THEN '1.x' ELSE '1.' || cast(o_orderkey % 10 AS string) END AS statement, cast(1 + o_orderkey % 2 AS int) AS uses,
    CASE o_orderkey % 4 WHEN 0 THEN 'workflow' WHEN 1 THEN 'nobody' ELSE 'gateway' END AS enforced_by, CASE o_custkey % 2 WHEN 0 THEN 'block' ELSE 'burn' END AS action,
    CASE o_custkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE 'maybe' END AS failure, cast(o_custkey % 3 AS int) AS detectors,
    CASE o_custkey % 6 WHEN 0 THEN 'policy' WHEN 1 THEN 'statement' WHEN 2 THEN 'detector' WHEN 3 THEN 'exemption' ELSE 'condition' END AS part,
    CASE o_custkey % 6 WHEN 0 THEN 'policy' WHEN 1 THEN CASE o_custkey % 2 WHEN 0 THEN 'block' ELSE 'burn' END WHEN 2 THEN CASE o_orderkey % 3 WHEN 0 THEN 'pii.email' ELSE 'pii.passport' END
        ELSE CASE o_orderkey % 3 WHEN 0 THEN 'app.id' WHEN 1 THEN 'app.approved_for' ELSE 'app.colour' END END AS name,
    CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' END AS equals, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' END AS contains FROM orders"""


def _broken_sql() -> str:
    fields = ", ".join(sorted(policy_checks.FIELDS))
    sources = ", ".join(sorted(detect.SOURCES))
    gated, field = "enforced_by = 'gateway'", "part IN ('condition', 'exemption') AND enforced_by = 'gateway'"
    single = "name IN ('app.id', 'app.risk_tier', 'destination.hosting', 'destination.provider')"
    rules = [
        ("part = 'policy' AND NOT regexp_full_match(policy_id, 'POL-[A-Z]+-[0-9][0-9][0-9]')", "'the id ' || policy_id || ' has another form than POL-AI-003'"),
        ("part = 'policy' AND length(version) = 0", "'no version'"),
        ("part = 'policy' AND signers = 0", "'no approvers'"),
        ("part = 'statement' AND NOT regexp_full_match(statement, '[0-9]+([.][0-9]+)*')", "'an id is numbers joined by dots'"),
        ("part = 'statement' AND uses > 1", "'the id is used ' || uses || ' times'"),
        ("part = 'statement' AND enforced_by = 'nobody'", "'nothing called nobody enforces statements'"),
        (f"part = 'statement' AND {gated} AND action = 'burn'", "'there is no action burn'"),
        (f"part = 'statement' AND {gated} AND failure = 'maybe'", "'on_check_failure says neither open nor closed'"),
        (f"part = 'statement' AND {gated} AND detectors = 0", "'no detector is named'"),
        (f"part = 'detector' AND {gated} AND name = 'pii.passport'", f"'there is no detector pii.passport, only {sources}'"),
        (f"{field} AND name = 'app.colour'", f"'there is no field app.colour, only {fields}'"),
        (f"{field} AND name = 'app.approved_for' AND (contains IS NULL OR contains = '' OR equals IS NOT NULL)", "'app.approved_for is a list: compare by contains'"),
        (f"{field} AND {single} AND (equals IS NULL OR equals = '' OR contains IS NOT NULL)", "name || ' is one value: compare by equals'"),
    ]
    return f"WITH p AS ({_PART}) " + " UNION ALL ".join(f"SELECT policy_id, statement, part, name, {say} AS message FROM p WHERE {wrong}" for wrong, say in rules)


@case(_broken_sql())
def q_policy_part_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every rule that the parts of many policies break; a part for each order."""
    return policy_checks.broken_rules(spark.sql(_PART.replace("FROM orders", "FROM {orders}"), orders=read_table(spark, d, "orders")))


_DUE = "SELECT o_orderkey AS policy_id, cast(1 + o_custkey % 2 AS string) AS version, {sha} AS content_sha256, {roles} AS approvers FROM orders"
_HELD = "SELECT l_orderkey AS policy_id, cast(1 + l_linenumber % 2 AS string) AS version, {sha} AS content_sha256, CASE l_partkey % 4 WHEN 0 THEN 'legal' WHEN 1 THEN 'security' WHEN 2 THEN 'privacy' END AS role FROM lineitem"
_ROLES = "CASE o_orderkey % 3 WHEN 0 THEN {0}'legal', 'security'{1} WHEN 1 THEN {0}'privacy'{1} ELSE {0}'legal', 'privacy', 'legal'{1} END"


@case(f"""WITH due AS (SELECT DISTINCT policy_id, version, content_sha256, unnest(approvers) AS role FROM ({_DUE.format(sha="sha256(cast(o_orderkey AS string))", roles=_ROLES.format("[", "]"))})),
    held AS ({_HELD.format(sha="sha256(cast(l_orderkey + l_suppkey % 2 AS string))")})
    SELECT *, CASE WHEN NOT EXISTS (SELECT 1 FROM held h WHERE h.policy_id = due.policy_id AND h.role = due.role) THEN 'role'
        WHEN NOT EXISTS (SELECT 1 FROM held h WHERE h.policy_id = due.policy_id AND h.role = due.role AND h.version = due.version) THEN 'version' ELSE 'content_sha256' END AS lacks
    FROM due WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.policy_id = due.policy_id AND h.role = due.role AND h.version = due.version AND h.content_sha256 = due.content_sha256)""")
def q_missing_signatures(spark: SparkSession, d: str) -> DataFrame:
    """A policy for each order, a signature for each of its lines: what still has to be signed, and why."""
    due = _DUE.format(sha="sha2(cast(o_orderkey AS string), 256)", roles=_ROLES.format("array(", ")")).replace("FROM orders", "FROM {orders}")
    held = _HELD.format(sha="sha2(cast(l_orderkey + l_suppkey % 2 AS string), 256)").replace("FROM lineitem", "FROM {lineitem}")
    return policy_checks.unsigned(spark.sql(due, orders=read_table(spark, d, "orders")), spark.sql(held, lineitem=read_table(spark, d, "lineitem")))


# -- blocks in a stream's state


@case(_E + "SELECT DISTINCT tenant_id::VARCHAR AS source, strftime(ts, '%Y-%m-%d %H') AS token, 1::BIGINT AS blocks FROM e")
def q_stream_first_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Hours of each shop as blocks, every event a delivery of its hour's: each block is accepted once, although the stream restarts and everything is delivered again."""
    at = scratch(spark, "first_blocks")
    e = _events(spark, d).select(F.col("tenant_id").cast("string").alias("source"), F.date_format("ts", "yyyy-MM-dd HH").alias("token"), F.col("ts").cast("timestamp").alias("at"))
    for _ in range(2):
        e.repartition(2).write.mode("append").parquet(f"{at}/headers")
        headers = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/headers")
        first_blocks(headers, keep=100_000, expiry=timedelta(days=3650)).writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("source", "token").agg(F.count(F.lit(1)).alias("blocks"))


# -- stored tables in their layouts, rates, crashes


@case(_E + """, m AS (SELECT tenant_id, date_trunc('day', ts) AS day, count(*) AS n FROM e GROUP BY 1, 2), w AS (SELECT *, lag(n) OVER (PARTITION BY tenant_id ORDER BY day) AS b, lag(day) OVER (PARTITION BY tenant_id ORDER BY day) AS t FROM m)
    SELECT tenant_id, strftime(day, '%Y-%m-%d') AS day, n, CASE WHEN n < b THEN n ELSE n - b END AS increase, CASE WHEN n < b THEN n ELSE n - b END / ((epoch_us(day) - epoch_us(t)) / 1e6) AS rate FROM w WHERE b IS NOT NULL""")
def q_counter_rates(spark: SparkSession, d: str) -> DataFrame:
    """A shop's events by day read as a counter: falls are restarts, rates are by second of the time since the last sample."""
    daily = _events(spark, d).groupBy("tenant_id", F.date_trunc("day", "ts").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return evidence.increase(daily, ["tenant_id"], "at", "n").where("increase IS NOT NULL").select("tenant_id", F.date_format("at", "yyyy-MM-dd").alias("day"), "n", "increase", "rate")


class _Crash(Exception):
    pass


@case(_E + """, n AS (SELECT count(*) AS all_rows, count(*) FILTER (event_id % 2 = 0) AS even FROM e)
    SELECT 'after the crash' AS step, even AS raw, even AS rolled FROM n UNION ALL SELECT 'merged', even, even FROM n UNION ALL SELECT 'repeated', all_rows, all_rows FROM n UNION ALL SELECT 'again', all_rows, all_rows FROM n""")
def q_crash_between_writes(spark: SparkSession, d: str) -> DataFrame:
    """A block whose rows were written when its states failed: readers and merges don't see it; its repetition counts once."""
    at = scratch(spark, "crash")
    e = _events(spark, d).select(F.col("ts").alias("event_time"), "tenant_id", "event_type", "user_id", "revenue", (F.col("event_id") % 1000).alias("duration_ms"), "event_id")
    even, odd = (e.where(F.col("event_id") % 2 == i).drop("event_id") for i in (0, 1))

    class Failing(Rollup):
        def states_of(self, block: DataFrame) -> DataFrame:
            raise _Crash

    roll, out = Rollup(spark, at), []
    note = lambda step: out.append((step, roll.raw().count(), roll.states().agg(F.sum("events")).first()[0]))
    roll.write(even, "even")
    try:
        Failing(spark, at).write(odd, "odd")
    except _Crash:
        note("after the crash")
    roll.compact("raw")
    roll.compact()
    note("merged")
    for step in ("repeated", "again"):
        roll.write(odd, "odd")
        note(step)
    return spark.createDataFrame(out, "step string, raw long, rolled long")


@case("""SELECT layout, o_orderkey, o_custkey, status, note FROM (SELECT o_orderkey, o_custkey, o_orderstatus AS status, '' AS note FROM orders WHERE o_custkey BETWEEN 10 AND 40 OR o_orderkey IN (7, 100, 101)), (VALUES ('sorted'), ('altered'), ('moved')) v(layout)""")
def q_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of the sort key and single keys from a table by month with bloom filters, then in an altered sort order with packed columns, then with an eighth of its months in another table; the declared column that no row brings holds its default."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), "o_orderdate")
    schema = StructType([*o.schema.fields, StructField("note", o.schema["status"].dataType)])
    at = scratch(spark, "layouts")
    t = tables.Table(f"{at}/t", schema, order=("o_custkey",), by_month="o_orderdate", bloom=("o_orderkey",))
    t.append(o)
    altered = t.like(f"{at}/altered", order=("o_orderkey",), bloom=("o_custkey",), options=tables.encodings(delta=("o_orderkey",)))
    moved, rest = t.like(f"{at}/moved"), t.like(f"{at}/rest")
    altered.append(o)
    altered.alter(spark)
    rest.append(o)
    for p in rest.partitions(spark)[::8]:
        rest.move(spark, p, moved)
    wanted = F.col("o_custkey").between(10, 40) | F.col("o_orderkey").isin(7, 100, 101)
    reads = {"sorted": t.read(spark), "altered": altered.read(spark), "moved": moved.read(spark).unionByName(rest.read(spark))}
    rows = [df.where(wanted).select(F.lit(name).alias("layout"), "o_orderkey", "o_custkey", "status", "note") for name, df in reads.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@case("SELECT strftime(o_orderdate, '%Y%m') AS partition, 3::BIGINT AS parts, count(*) AS rows FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) = 3")
def q_parts_pressure(spark: SparkSession, d: str) -> DataFrame:
    """Months of over two files, after three appends."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    t = tables.Table(scratch(spark, "pressure"), o.schema, by_month="o_orderdate")
    for i in range(3):
        t.append(o.where(F.col("o_orderkey") % 3 == i).coalesce(1))
    return tables.parts_pressure(t.parts(spark), ["partition"], 2).select("partition", "parts", "rows")
