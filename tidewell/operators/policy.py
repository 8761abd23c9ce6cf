"""Data-protection policies: model and validation, approval, signed bundles, decisions as joins, enforcement, audit."""

from __future__ import annotations

import functools
import hashlib
import hmac
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import mapped
from ..functions.spans import barrier
from .detect import SOURCES
from .policy_checks import FIELDS, unmet, violations


@dataclass(frozen=True)
class Condition:
    field: str
    equals: str | None = None
    contains: str | None = None

    def holds(self) -> Column:
        """On a request row with columns named after the fields (dots as underscores); a missing value holds nothing."""
        c = F.col(self.field.replace(".", "_"))
        if FIELDS[self.field]:
            return F.coalesce(F.array_contains(c, self.contains), F.lit(False))
        return c.eqNullSafe(F.lit(self.equals))


@dataclass(frozen=True)
class Statement:
    id: str
    enforced_by: str
    action: str = ""
    on_check_failure: str = ""
    detect: tuple[str, ...] = ()
    applies_when: tuple[Condition, ...] = ()
    unless: tuple[Condition, ...] = ()

    @property
    def needs_service(self) -> bool:
        return needs_service(self.detect)

    def applies(self) -> Column:
        """On a request row: all conditions hold and no exemption does."""
        out = F.lit(True)
        for c in self.applies_when:
            out = out & c.holds()
        for c in self.unless:
            out = out & ~c.holds()
        return out


@dataclass(frozen=True)
class Policy:
    policy_id: str
    version: str
    approvers: tuple[str, ...]
    statements: tuple[Statement, ...]
    sha256: str = ""

    @property
    def gateway(self) -> tuple[Statement, ...]:
        return tuple(s for s in self.statements if s.enforced_by == "gateway")

    @property
    def package(self) -> str:
        return self.policy_id.lower().replace("-", "_")

    @property
    def revision(self) -> str:
        return f"{self.policy_id}@{self.version}+{self.sha256[:8]}"


@dataclass(frozen=True)
class Runtime:
    """Exceptions (policy, statement, app, expires in RFC 3339) and rollout modes by (app, policy)."""

    exceptions: tuple[dict[str, str], ...] = ()
    rollout: dict[tuple[str, str], str] = field(default_factory=dict)


class PolicyError(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


def needs_service(types: tuple[str, ...] | list[str]) -> bool:
    return any(SOURCES.get(t) == "pii-service" for t in types)


def parse_policy(raw: bytes | str) -> Policy:
    import yaml

    raw = raw.encode() if isinstance(raw, str) else raw
    doc = yaml.safe_load(raw)
    conditions = lambda xs: tuple(Condition(x.get("field", ""), x.get("equals"), x.get("contains")) for x in xs or [])
    statements = tuple(Statement(str(s.get("id", "")), s.get("enforced_by", ""), s.get("action", ""), s.get("on_check_failure", ""), tuple(s.get("detect") or ()), conditions(s.get("applies_when")), conditions(s.get("unless"))) for s in doc.get("statements") or [])
    return Policy(doc.get("policy_id", ""), str(doc.get("version") or ""), tuple(doc.get("approvers") or ()), statements, hashlib.sha256(raw).hexdigest())


def parse_runtime(raw: bytes | str) -> Runtime:
    import yaml

    doc = yaml.safe_load(raw) or {}
    modes = {(app, policy): mode for app, by in (doc.get("rollout") or {}).items() for policy, mode in by.items()}
    return Runtime(tuple({k: str(x[k]) for k in ("policy_id", "statement", "app", "expires")} for x in doc.get("exceptions") or []), modes)


@functools.lru_cache(maxsize=1024)
def _broken(raw: bytes) -> tuple[str, ...]:
    """What is wrong with a policy's text, found once for each text."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return tuple(" ".join(x for x in (r["policy_id"], r["statement"], r["part"], r["message"]) if x) for r in violations(spark, [parse_policy(raw)]).collect())


def compiled(raw: bytes | str, approval: dict[str, Any] | None = None) -> Policy:
    """The policy if it is valid and, where an approval is given, approved; else PolicyError with all that is wrong."""
    p = parse_policy(raw)
    found = list(_broken(raw if isinstance(raw, bytes) else raw.encode()))
    found += [f"the approval lacks {what} {value}" for what, value in unmet(p, approval)] if approval is not None else []
    if found:
        raise PolicyError(found)
    return p


def signed_bundle(p: Policy, runtime: Runtime, key: bytes) -> bytes:
    body = json.dumps({"policy": p.package, "revision": p.revision, "sha256": p.sha256, "needs_pii_service": any(s.needs_service for s in p.gateway), "statements": [{"id": s.id, "action": s.action, "detect": s.detect, "on_check_failure": s.on_check_failure, "needs_pii_service": s.needs_service} for s in p.gateway], "exceptions": runtime.exceptions, "rollout": [[*k, v] for k, v in sorted(runtime.rollout.items())]}, sort_keys=True)
    return json.dumps({"body": body, "alg": "HS256", "signature": hmac.new(key, body.encode(), hashlib.sha256).hexdigest()}).encode()


def verified_bundle(raw: bytes, key: bytes, service: bool = True) -> dict[str, Any]:
    """The bundle's body; PolicyError on another key, or if it needs the detection service and there is none."""
    doc = json.loads(raw)
    if not hmac.compare_digest(hmac.new(key, doc["body"].encode(), hashlib.sha256).hexdigest(), doc["signature"]):
        raise PolicyError(["the bundle's signature doesn't fit the key"])
    body = json.loads(doc["body"])
    if body["needs_pii_service"] and not service:
        raise PolicyError(["the bundle needs the detection service"])
    return body


# -- relational part

REQUEST_FIELDS = {"app_id": "string", "app_risk_tier": "string", "app_approved_for": "array<string>", "destination_hosting": "string", "destination_provider": "string"}


def complete(requests: DataFrame) -> DataFrame:
    """Adds request fields that aren't there, as nulls."""
    return requests.select("*", *[F.lit(None).cast(t).alias(c) for c, t in REQUEST_FIELDS.items() if c not in requests.columns])


def with_app(requests: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Looks up the caller by key; an unknown key rejects the row with status 401. A status that the row has already stays, save that 401 comes first."""
    out = requests.join(F.broadcast(keys.withColumn("_known", F.lit(True))), key, "left")  # keys are configuration, a row per application
    before = F.col("status") if "status" in requests.columns else F.lit(None).cast("int")
    return out.withColumn("status", F.when(F.col("_known").isNull(), 401).otherwise(before)).drop("_known")


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # rows of a policy file


def decisions(requests: DataFrame, findings: DataFrame, policies: list[Policy], runtime: Runtime, as_of: str, excepted_too: bool = False) -> DataFrame:
    """(request_id, policy_id, policy_version, statement, action, mode, finding_ids, finding_types): one row per request and statement that fires.

    requests: request_id and REQUEST_FIELDS; findings: request_id, id, type. A statement fires if its conditions hold, no
    exemption does, no exception is active at ``as_of``, and a finding has one of its types. ``excepted_too``: those under an
    active exception stay, marked by ``exception_used``. Findings are joined with the statements of their type first, so
    requests without any never shuffle."""
    spark = requests.sparkSession
    statements = [(p, s) for p in policies for s in p.gateway]
    wanted = _small(spark, [(p.policy_id, p.version, s.id, s.action, t, i) for i, (p, s) in enumerate(statements) for t in s.detect], "policy_id string, policy_version string, statement string, action string, type string, _n int")
    fires = F.lit(False)
    for i, (_, s) in reversed(list(enumerate(statements))):
        fires = F.when(F.col("_n") == i, s.applies()).otherwise(fires)
    hit = findings.select("request_id", "id", "type").join(wanted, "type").join(complete(requests).select("request_id", *REQUEST_FIELDS), "request_id").where(fires)
    active = [(x["policy_id"], x["statement"], x["app"], x["expires"]) for x in runtime.exceptions]
    excepted = _small(spark, active, "policy_id string, statement string, app_id string, expires string").where(F.to_timestamp("expires") > F.to_timestamp(F.lit(as_of))).select("policy_id", "statement", "app_id", F.lit(True).alias("exception_used")).distinct()
    modes = _small(spark, [(a, p, m) for (a, p), m in runtime.rollout.items()], "app_id string, policy_id string, _mode string")
    out = hit.join(excepted, ["policy_id", "statement", "app_id"], "left" if excepted_too else "left_anti").join(modes, ["app_id", "policy_id"], "left")
    used = [F.coalesce("exception_used", F.lit(False)).alias("exception_used")] if excepted_too else []
    by = out.groupBy("request_id", "policy_id", "policy_version", "statement", "action", F.coalesce("_mode", F.lit("enforce")).alias("mode"), *used)
    return by.agg(F.array_sort(F.collect_set("id")).alias("finding_ids"), F.array_sort(F.collect_list("type")).alias("finding_types"))


SKIPPED = "array<struct<policy_id:string,policy_version:string,statement:string,action:string,check_status:string>>"


def failing_open(requests: DataFrame, policies: list[Policy]) -> DataFrame:
    """Requests whose check has an ``error`` go on without it, their error cleared, where a statement applies to them and every one that does says ``on_check_failure: open``; ``checks_skipped`` then lists those statements. Any other failed check stays one."""
    statements = [(p, s) for p in policies for s in p.gateway]
    df = complete(requests)
    own = F.array_compact(F.array(*[F.when(s.applies(), F.struct(*[F.lit(v).alias(n) for n, v in (("policy_id", p.policy_id), ("policy_version", p.version), ("statement", s.id), ("action", s.action))], F.concat(F.lit("skipped: "), "error").alias("check_status"), F.lit(s.on_check_failure == "open").alias("open"))) for p, s in statements])) if statements else F.array()
    step = barrier(df, _own=own.cast(SKIPPED.replace("check_status:string", "check_status:string,open:boolean")))
    goes = F.col("error").isNotNull() & (F.size("_own") > 0) & F.forall("_own", lambda x: x["open"])
    listed = F.when(goes, F.transform("_own", lambda x: x.dropFields("open"))).otherwise(F.array().cast(SKIPPED))
    return step.select(*[F.when(~goes, F.col("error")).alias("error") if c == "error" else F.col(c) for c in requests.columns], listed.alias("checks_skipped"))


def skip_records(requests: DataFrame) -> DataFrame:
    """(request_id, policy_id, policy_version, statement, action, skipped, check_status): a record for each skipped check."""
    return requests.select("request_id", F.inline("checks_skipped")).withColumn("skipped", F.lit(True))


# What each outcome's error body says; {} is the statement that blocked, with its policy.
MESSAGES = {
    400: "invalid JSON",
    401: "unknown gateway key",
    403: "request blocked by {}",
    502: "upstream unavailable",
    503: "pii detection unavailable",
}
OUTCOMES = {400: "reject", 401: "reject", 403: "block", 502: "failed", 503: "unchecked"}


def enforced(requests: DataFrame, made: DataFrame) -> DataFrame:
    """Each request with its one ``status``: what it came with (400, 401), else 503 if its check has an ``error``, 403 if an enforced decision blocks, 502 if ``upstream_error`` says that sending it on failed, 200. With ``action``, the statement that blocked, the finding ids to redact and the error body. Monitored decisions change nothing, any enforced block wins, the ids of all enforced redactions are applied at once."""
    live = F.col("mode") == "enforce"
    per = made.groupBy("request_id").agg(
        F.min(F.when(live & (F.col("action") == "block"), F.struct("statement", "policy_id"))).alias("_block"),
        F.array_distinct(F.flatten(F.collect_list(F.when(live & (F.col("action") == "redact"), F.col("finding_ids"))))).alias("_ids"),
        F.max(~live).alias("_monitored"),
    )
    out = requests.join(per, "request_id", "left")
    out = out.withColumnRenamed("status", "_came")
    has = lambda c: F.col("_came" if c == "status" else c) if c in requests.columns else F.lit(None)
    status = F.coalesce(has("status").cast("int"), F.when(has("error").isNotNull(), 503).when(F.col("_block").isNotNull(), 403).when(has("upstream_error").isNotNull(), 502).otherwise(200))
    out = barrier(out, status=status)
    s = F.col("status")
    passed = F.when(F.size(F.coalesce("_ids", F.array())) > 0, "redact").when(F.col("_monitored"), "monitor").otherwise("pass")
    action = F.coalesce(mapped(OUTCOMES, s), passed)
    blocked = F.when(s == 403, F.col("_block.statement"))
    message = F.replace(mapped(MESSAGES, s), F.lit("{}"), F.coalesce(F.concat_ws(" statement ", "_block.policy_id", "_block.statement"), F.lit("")))
    body = F.when(s != 200, F.to_json(F.struct(F.struct(message.alias("message"), F.lit("policy_violation").alias("type"), blocked.alias("statement")).alias("error"))))
    return out.select(*[c for c in requests.columns if c != "status"], "status", action.alias("action"), blocked.alias("blocked_by"), F.when((s == 200) & (action == "redact"), F.col("_ids")).otherwise(F.array().cast("array<string>")).alias("redact_ids"), body.alias("error_body"))


def audit(made: DataFrame, requests: DataFrame, revision: str) -> DataFrame:
    """One record per decision: types with counts, never a value."""
    counts = F.map_from_entries(F.transform(F.array_distinct("finding_types"), lambda t: F.struct(t, F.size(F.filter("finding_types", lambda x: x == t)))))
    redacted = F.when((F.col("mode") == "enforce") & (F.col("action") == "redact"), F.size("finding_ids")).otherwise(0)
    return made.join(complete(requests).select("request_id", "app_id", "destination_provider"), "request_id").select("request_id", F.col("app_id").alias("app"), F.col("destination_provider").alias("destination"), "policy_id", "policy_version", "statement", "action", "mode", F.lit(revision).alias("bundle_revision"), counts.alias("finding_types"), redacted.alias("redacted"))
