"""Checks of policies over a relation of their parts: a row each for the policy, its statements, and each statement's detectors,
conditions and exemptions. Violations, missing signatures and test cases are all read off these rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .detect import SOURCES

if TYPE_CHECKING:
    from .policy import Policy

# What a policy may name. Fields: whether they hold lists.
ACTIONS = ("block", "redact")
FIELDS = {
    "destination.hosting": False,
    "destination.provider": False,
    "app.id": False,
    "app.risk_tier": False,
    "app.approved_for": True,
}

PART = "policy_id string, version string, signers int, statement string, uses int, enforced_by string, action string, failure string, detectors int, part string, name string, equals string, contains string"

#: part, when it is wrong, what to say; both in SQL over a part with ``known`` (its name is in the catalogue) and ``many`` (its field holds a list).
RULES = (
    ("policy", "policy_id NOT RLIKE '^POL-[A-Z]+-[0-9]{3}$'", "'the id ' || policy_id || ' has another form than POL-AI-003'"),
    ("policy", "version = ''", "'no version'"),
    ("policy", "signers = 0", "'no approvers'"),
    ("statement", "statement NOT RLIKE '^[0-9]+([.][0-9]+)*$'", "'an id is numbers joined by dots'"),
    ("statement", "uses > 1", "'the id is used ' || uses || ' times'"),
    ("statement", "enforced_by NOT IN ('gateway', 'workflow', 'attestation')", "'nothing called ' || enforced_by || ' enforces statements'"),
    ("statement", "gated AND NOT known", "'there is no action ' || action"),
    ("statement", "gated AND failure NOT IN ('open', 'closed')", "'on_check_failure says neither open nor closed'"),
    ("statement", "gated AND detectors = 0", "'no detector is named'"),
    ("detector", "gated AND NOT known", "'there is no detector ' || name || ', only ' || catalogue"),
    ("field", "gated AND NOT known", "'there is no field ' || name || ', only ' || catalogue"),
    ("field", "gated AND known AND many AND (coalesce(contains, '') = '' OR equals IS NOT NULL)", "name || ' is a list: compare by contains'"),
    ("field", "gated AND known AND NOT many AND (coalesce(equals, '') = '' OR contains IS NOT NULL)", "name || ' is one value: compare by equals'"),
)


def parts(p: Policy) -> list[tuple]:
    """The policy's rows (PART)."""
    uses = Counter(s.id for s in p.statements)
    rows: list[tuple] = [(p.policy_id, p.version, len(p.approvers), None, 0, "", "", "", 0, "policy", p.policy_id, None, None)]
    for s in p.statements:
        own = (p.policy_id, p.version, len(p.approvers), s.id, uses[s.id], s.enforced_by, s.action, s.on_check_failure, len(s.detect))
        rows.append((*own, "statement", s.action, None, None))
        rows += [(*own, "detector", d, None, None) for d in s.detect]
        rows += [(*own, part, c.field, c.equals, c.contains) for part, cs in (("condition", s.applies_when), ("exemption", s.unless)) for c in cs]
    return rows


def violations(spark: SparkSession, policies: Iterable[Policy]) -> DataFrame:
    """(policy_id, statement, part, name, message): every rule that a part of a policy breaks."""
    return broken_rules(spark.createDataFrame([r for p in policies for r in parts(p)], PART))


def broken_rules(df: DataFrame) -> DataFrame:
    """The same of a relation of parts (PART), of however many policies: one pass, nothing is shuffled."""
    of = F.when(F.col("part").isin("condition", "exemption"), "field").otherwise(F.col("part"))
    catalogues = {"statement": ACTIONS, "detector": tuple(sorted(SOURCES)), "field": tuple(sorted(FIELDS))}
    known = F.lit(False)
    listed = F.lit("")
    for kind, names in catalogues.items():
        known = F.when(of == kind, F.coalesce(F.col("name").isin(*names), F.lit(False))).otherwise(known)
        listed = F.when(of == kind, ", ".join(names)).otherwise(listed)
    df = df.select("*", of.alias("of"), known.alias("known"), listed.alias("catalogue"), F.col("name").isin(*[f for f, many in FIELDS.items() if many]).alias("many"), (F.col("enforced_by") == "gateway").alias("gated"))
    broken = F.array_compact(F.array(*[F.when((F.col("of") == part) & F.expr(wrong), F.expr(say)) for part, wrong, say in RULES]))
    return df.select("policy_id", "statement", "part", "name", broken.alias("messages")).where(F.size("messages") > 0).select("policy_id", "statement", "part", "name", F.explode("messages").alias("message"))


def unmet(p: Policy, approval: dict[str, Any]) -> list[tuple[str, str]]:
    """What the approval would have to hold and doesn't: the policy's id, version and content, and a signature of each approver's role."""
    due = {("policy_id", p.policy_id), ("version", p.version), ("content_sha256", p.sha256), *(("role", r) for r in p.approvers)}
    held = {(k, approval.get(k)) for k in ("policy_id", "version", "content_sha256")} | {("role", a.get("role")) for a in approval.get("approvals") or ()}
    return sorted(due - held)


def unsigned(policies: DataFrame, approvals: DataFrame) -> DataFrame:
    """(policy_id, version, content_sha256, role, lacks): signatures that policies still need.

    ``policies`` holds policy_id, version, content_sha256 and the roles of its approvers; ``approvals`` a signature a row: policy_id,
    version, content_sha256, role. ``lacks`` says what is missing: a signature of the role at all, one of this version, or one of
    this content. Repeated signatures and roles count once; a null in a signature signs nothing; policies without approvers need none."""
    due = policies.select("policy_id", "version", "content_sha256", F.explode(F.array_distinct("approvers")).alias("role")).distinct()
    held = approvals.select("policy_id", "role", F.col("version").alias("_version"), F.col("content_sha256").alias("_content")).dropna().distinct()
    of = F.col("_version") == F.col("version")
    best = F.max(F.when(of & (F.col("_content") == F.col("content_sha256")), 3).when(of, 2).when(F.col("_version").isNotNull(), 1).otherwise(0))
    lacks = F.when(F.col("_best") == 0, "role").when(F.col("_best") == 1, "version").when(F.col("_best") == 2, "content_sha256")
    found = due.join(held, ["policy_id", "role"], "left").groupBy("policy_id", "version", "content_sha256", "role").agg(best.alias("_best"))
    return found.where("_best < 3").select("policy_id", "version", "content_sha256", "role", lacks.alias("lacks"))


def cases(p: Policy) -> list[dict[str, Any]]:
    """A test case for each part of a gateway statement. A detector's: data of its type fires the statement. The statement's own: data that nothing detects doesn't. An exemption's: nor does detected data under it. Conditions make up the request of them all."""
    rows = [dict(zip([c.split()[0] for c in PART.split(", ")], r, strict=True)) for r in parts(p)]
    rows = [r for r in rows if r["enforced_by"] == "gateway"]
    column = lambda r: r["name"].replace(".", "_")
    value = lambda r: [r["contains"]] if FIELDS[r["name"]] else r["equals"]
    base = {"app_id": "an-app", "app_approved_for": [], "destination_provider": "a-provider", "destination_hosting": "a-host"}
    out = []
    for r in rows:
        if r["part"] == "condition":
            continue
        same = [x for x in rows if x["statement"] == r["statement"]]
        request = {**base, **{column(x): value(x) for x in same if x["part"] == "condition"}}
        kind = next(x["name"] for x in same if x["part"] == "detector")
        if r["part"] == "exemption":
            request[column(r)] = value(r)
        sent = {"detector": r["name"], "statement": "undetected", "exemption": kind}[r["part"]]
        out.append({"name": f"{p.policy_id} {r['statement']} {r['part']} {r['name']}", "statement": r["statement"], "type": sent, "request": request, "action": r["action"] if r["part"] == "detector" else None})
    return out
