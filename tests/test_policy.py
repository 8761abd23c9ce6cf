import json

import pytest
from pyspark.sql import functions as F

from tidewell.operators import detect, evidence, policy, policy_checks, redact
from tidewell.queries import POLICY, RUNTIME

TEXT = "Customer jane.doe@example.com (phone +1 415-555-0134) says her refund is late. Jane's backup email is jane.doe@example.com."
CARD = "Charge card 4111 1111 1111 1111 for the order"
ROWS = [
    (1, "sales-copilot", [], "external", TEXT, None),
    (2, "support-bot", [], "external", TEXT, None),
    (3, "hr-assistant", ["personal-data"], "external", TEXT, None),
    (4, "claims-assistant", [], "external", TEXT, None),
    (5, "sales-copilot", [], "self-hosted", TEXT, None),
    (6, "hr-assistant", ["personal-data"], "external", CARD, None),
    (7, "sales-copilot", [], "external", "nothing", "Timeout"),
]


@pytest.fixture(scope="module")
def run(spark):
    df = spark.createDataFrame(ROWS, "request_id int, app_id string, app_approved_for array<string>, destination_hosting string, text string, error string")
    found = detect.with_findings(df)
    p = policy.compiled(POLICY)
    made = policy.decisions(df, found.select("request_id", F.inline("findings")), [p], RUNTIME, "2026-12-01T00:00:00Z").persist()
    return p, df, found, made


def test_enforcement(run):
    _, df, found, made = run
    out = policy.enforced(found, made)
    got = {r["request_id"]: (r["status"], r["action"]) for r in out.collect()}
    assert got == {1: (200, "redact"), 2: (200, "monitor"), 3: (200, "pass"), 4: (200, "pass"), 5: (200, "pass"), 6: (403, "block"), 7: (503, "unchecked")}
    text = redact.redacted(out.where("request_id = 1"), ids=F.col("redact_ids")).first()["redacted_text"]
    assert "[EMAIL_1]" in text and "[PHONE_1]" in text and "[EMAIL_2]" not in text
    body = json.loads(out.where("request_id = 6").first()["error_body"])
    assert body["error"]["type"] == "policy_violation" and body["error"]["statement"] == "1.2"


def test_audit_has_counts_and_no_values(run):
    p, df, _, made = run
    records = policy.audit(made, df, p.revision)
    first = records.where("request_id = 1").first()
    assert first["finding_types"] == {"pii.email": 2, "pii.phone": 1} and first["redacted"] == 3
    assert not any("jane" in json.dumps(r.asDict(), default=str) for r in records.collect())


def test_exception_ends(run):
    p, df, found, _ = run
    later = policy.decisions(df, found.select("request_id", F.inline("findings")), [p], RUNTIME, "2027-02-01T00:00:00Z")
    assert later.where("request_id = 4").count() == 1


def test_generated_tests_hold(spark, run):
    p = run[0]
    cases = policy_checks.cases(p)
    assert len(cases) == 8
    df = spark.createDataFrame([(i, c["request"]["app_id"], c["request"]["app_approved_for"], c["request"]["destination_hosting"], c["request"]["destination_provider"]) for i, c in enumerate(cases)], "request_id int, app_id string, app_approved_for array<string>, destination_hosting string, destination_provider string")
    f = spark.createDataFrame([(i, "f1", c["type"]) for i, c in enumerate(cases)], "request_id int, id string, type string")
    got = {(r["request_id"], r["statement"]): r["action"] for r in policy.decisions(df, f, [p], policy.Runtime(), "2026-01-01T00:00:00Z").collect()}
    for i, c in enumerate(cases):
        assert got.get((i, c["statement"])) == c["action"], c["name"]


def test_validation_names_all_problems():
    bad = POLICY.replace("pii.email", "pii.passport").replace("action: block", "action: burn").replace("POL-DEMO-001", "X1")
    with pytest.raises(policy.PolicyError) as e:
        policy.compiled(bad)
    assert len(e.value.errors) == 3 and "pii.passport" in str(e.value)


def test_approval_and_bundle():
    p = policy.compiled(POLICY)
    ok = {"policy_id": p.policy_id, "version": p.version, "content_sha256": p.sha256, "approvals": [{"role": "security", "user": "u", "signed_at": "2026-01-01T00:00:00Z"}]}
    assert policy.compiled(POLICY, ok).revision.startswith("POL-DEMO-001@1.0+")
    for change in ({"version": "2"}, {"content_sha256": "0"}, {"approvals": []}):
        with pytest.raises(policy.PolicyError):
            policy.compiled(POLICY, {**ok, **change})
    raw = policy.signed_bundle(p, RUNTIME, b"key")
    assert policy.verified_bundle(raw, b"key")["needs_pii_service"] is False
    with pytest.raises(policy.PolicyError):
        policy.verified_bundle(raw, b"other")
    names = policy.compiled(POLICY.replace("pii.email", "pii.name"))
    assert names.gateway[0].needs_service
    with pytest.raises(policy.PolicyError):
        policy.verified_bundle(policy.signed_bundle(names, RUNTIME, b"k"), b"k", service=False)


def test_unknown_key_is_rejected(spark):
    keys = spark.createDataFrame([("gw-1", "sales-copilot")], "key string, app_id string")
    got = {r["key"]: r["status"] for r in policy.with_app(spark.createDataFrame([("gw-1",), ("gw-x",)], "key string"), keys).collect()}
    assert got == {"gw-1": None, "gw-x": 401}


def test_all_outcomes_have_one_status(spark):
    rows = [(1, "gw-1", None, None, None), (2, "gw-x", None, None, None), (3, "gw-1", 400, None, None), (4, "gw-x", 400, None, None), (5, "gw-1", None, "Timeout", None), (6, "gw-1", None, None, "refused"), (7, "gw-1", None, None, "refused")]
    keys = spark.createDataFrame([("gw-1", "sales-copilot")], "key string, app_id string")
    df = policy.with_app(spark.createDataFrame(rows, "request_id int, key string, status int, error string, upstream_error string"), keys)
    made = spark.createDataFrame([(7, "POL-DEMO-001", "1.2", "block", "enforce", ["f1"]), (3, "POL-DEMO-001", "1.2", "block", "enforce", ["f1"])], "request_id int, policy_id string, statement string, action string, mode string, finding_ids array<string>")
    out = policy.enforced(df, made)
    assert out.columns.count("status") == 1
    got = {r["request_id"]: (r["status"], r["action"], json.loads(r["error_body"])["error"] if r["error_body"] else None) for r in out.collect()}
    error = lambda m, **x: {"message": m, "type": "policy_violation", **x}
    assert got == {
        1: (200, "pass", None), 2: (401, "reject", error("unknown gateway key")), 3: (400, "reject", error("invalid JSON")), 4: (401, "reject", error("unknown gateway key")),
        5: (503, "unchecked", error("pii detection unavailable")), 6: (502, "failed", error("upstream unavailable")), 7: (403, "block", error("request blocked by POL-DEMO-001 statement 1.2", statement="1.2")),
    }


def test_every_rule_can_be_broken(spark):
    raw = """policy_id: pol-1
approvers: []
statements:
  - {id: "1.x", enforced_by: nobody}
  - {id: "2", enforced_by: gateway, action: burn, on_check_failure: maybe, detect: []}
  - {id: "2", enforced_by: workflow, action: anything}
  - {id: "3", enforced_by: gateway, action: block, on_check_failure: open, detect: [pii.passport, pii.email], applies_when: [{field: app.colour, equals: x}, {field: app.id, contains: x}], unless: [{field: app.approved_for, equals: x}]}
"""
    found = policy_checks.violations(spark, [policy.parse_policy(raw)]).collect()
    got = sorted((r["statement"] or "", r["part"]) for r in found)
    assert got == sorted([("", "policy")] * 3 + [("1.x", "statement")] * 2 + [("2", "statement")] * 5 + [("3", "detector"), ("3", "condition"), ("3", "condition"), ("3", "exemption")])
    said = " ".join(r["message"] for r in found)
    assert "pii.passport" in said and "pii.bank_account" in said and "app.colour" in said


def test_hash_chain(spark):
    df = spark.createDataFrame([("a", i, f"p{i}") for i in range(5)] + [("b", 0, None)], "chain string, n int, payload string")
    rows = sorted(evidence.hash_chained(df, "chain", "n", "payload").collect(), key=lambda r: (r["chain"], r["n"]))
    assert all(y["prev_hash"] == x["hash"] for x, y in zip(rows[:4], rows[1:5], strict=True)) and rows[5]["prev_hash"] == ""


def test_alert_holds_without_a_break(spark):
    rows = [("s", i, v) for i, v in enumerate([1, 400, 400, 400, 1, 400])]
    df = spark.createDataFrame(rows, "s string, m int, v int").select("s", F.timestamp_seconds(F.col("m") * 180).alias("at"), "v")
    assert [r["v"] for r in evidence.alerts(df, ["s"], "at", F.col("v") > 300).collect()] == [400]
    assert evidence.increase(df, ["s"], "at", "v").where("increase = 399").count() == 2


def test_checks_that_fail_open(spark):
    def policy_of(*modes):
        return policy.Policy("p", "1", (), tuple(policy.Statement(str(i), "gateway", "redact", m, ("pii.name",), (policy.Condition("app.id", equals="a"),) if i else ()) for i, m in enumerate(modes)))

    rows = [(1, "a", "Timeout"), (2, "b", "Timeout"), (3, "a", None)]
    df = spark.createDataFrame(rows, "request_id int, app_id string, error string")

    def outcome(*modes):
        out = policy.failing_open(df, [policy_of(*modes)] if modes else [])
        return {r["request_id"]: (r["error"], [(x["statement"], x["check_status"]) for x in r["checks_skipped"]]) for r in out.collect()}

    skipped = lambda *ids: (None, [(i, "skipped: Timeout") for i in ids])
    assert outcome("open", "open") == {1: skipped("0", "1"), 2: skipped("0"), 3: (None, [])}
    assert outcome("open", "closed") == {1: ("Timeout", []), 2: skipped("0"), 3: (None, [])}
    assert outcome("closed") == outcome() == {1: ("Timeout", []), 2: ("Timeout", []), 3: (None, [])}


def test_a_request_goes_on_without_a_check_that_fails_open(spark):
    from tidewell.operators import gateway

    def down(text):
        raise TimeoutError

    raw = json.dumps({"messages": [{"role": "user", "content": "write a@b.io"}]})
    requests = spark.createDataFrame([(1, "k", raw)], "request_id int, key string, raw string")
    keys = spark.createDataFrame([("k", "sales-copilot", "external")], "key string, app_id string, destination_hosting string")
    for mode, status, action in (("open", 200, "redact"), ("closed", 503, "unchecked")):
        p = policy.compiled(POLICY.replace("on_check_failure: closed", f"on_check_failure: {mode}"))
        r = gateway.passed(requests, keys, [p], RUNTIME, "2026-12-01T00:00:00Z", down).first()
        assert (r["status"], r["action"], len(r["checks_skipped"])) == (status, action, 2 if mode == "open" else 0)
        assert ("[EMAIL_1]" in r["forwarded"]) if mode == "open" else r["forwarded"] is None
