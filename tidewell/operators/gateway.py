"""Chat requests from caller's key to upstream: parsed, checked, decided, redacted, rewritten, with one outcome each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import barrier, by_start
from ..sources.files import chat_requests, rewritten
from . import detect, policy, redact


def passed(requests: DataFrame, keys: DataFrame, policies: list[policy.Policy], runtime: policy.Runtime, as_of: str, service: Callable[[str], list[dict]] | None = None) -> DataFrame:
    """(request_id, app_id, status, action, blocked_by, error_body, forwarded, vault, checks_skipped) for every request.

    requests: request_id (unique), key, raw (JSON) and, where known, upstream_error. ``service``: a further detector; if it fails on a
    message, its request is unchecked (503), unless all statements that apply to it fail open: then it goes on with the other findings, and ``checks_skipped`` says so. Findings count on through a request's messages; equal values have equal
    placeholders in all of them. ``forwarded`` is null unless the status is 200 or 502."""
    parsed = chat_requests(requests, "raw").drop("model")
    parsed = parsed.withColumn("status", F.when(F.col("error").isNotNull(), 400)).drop("error")
    known = policy.complete(policy.with_app(parsed, keys))
    messages = known.where(F.col("status").isNull()).select("request_id", F.posexplode("messages").alias("message", "_m")).select("request_id", "message", F.col("_m.content").alias("text"))
    found = detect.with_findings(messages.where(F.length("text") > 0))
    if service:
        own = detect.detected_by(found.withColumnRenamed("findings", "_own"), service).withColumnRenamed("findings", "_more")
        more = F.transform("_more", lambda f: F.struct(F.lit("").alias("id"), *[f[c].alias(c) for c in ("type", "start", "end", "byte_start", "byte_end", "value")]))
        found = own.select("request_id", "message", "text", "error", detect.merged_findings(F.col("_own"), more).alias("findings"))
    else:
        found = found.withColumn("error", F.lit(None).cast("string"))
    found = detect.numbered_across_messages(found, "request_id", "message")
    per = found.groupBy("request_id").agg(F.max("error").alias("error"), F.array_sort(F.collect_list(F.struct("message", "findings"))).alias("_found"))
    checked = policy.failing_open(known.join(per, "request_id", "left"), policies)
    made = policy.decisions(checked, checked.where("error is null").select("request_id", F.explode("_found.findings").alias("f")).select("request_id", F.inline("f")), policies, runtime, as_of)
    done = policy.enforced(checked, made)
    chosen = F.transform("_found", lambda m: F.struct(m["message"].alias("message"), by_start(F.filter(m["findings"], lambda f: F.array_contains(F.col("redact_ids"), f["id"]))).alias("findings")))
    step = barrier(done, _chosen=F.coalesce(chosen, F.array().cast(f"array<struct<message:int,findings:array<{detect.FINDING}>>>")))
    step = barrier(step, _seen=redact.numbered(F.flatten(F.transform("_chosen", lambda m: m["findings"]))))

    def text(m, i):
        own = F.get(F.filter("_chosen", lambda c: c["message"] == i), 0)["findings"]
        return F.when(F.size(own) > 0, redact.spliced(m["content"], own, F.col("_seen"))).otherwise(m["content"])

    sent = F.when(F.col("status").isin(200, 502), rewritten(F.col("raw"), F.transform("messages", text)))
    return step.select("request_id", "app_id", "status", "action", "blocked_by", "error_body", sent.alias("forwarded"), redact.vault_of(F.col("_seen")).alias("vault"), "checks_skipped")
