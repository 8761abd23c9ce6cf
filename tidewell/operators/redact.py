"""Placeholders for findings: stable numbering, a vault per text, restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import mapped
from ..functions.spans import barrier, by_start

# Placeholder labels by finding type; unknown types are REDACTED.
LABELS = {
    "pii.email": "EMAIL",
    "pii.phone": "PHONE",
    "pii.national_id": "NATIONAL_ID",
    "pii.name": "NAME",
    "pii.address": "ADDRESS",
    "pii.bank_account": "BANK_ACCOUNT",
    "secret.password": "PASSWORD",
}
_SEEN = "array<struct<value:string,label:string,placeholder:string>>"


def label_of(kind: Column, style: str = "gateway") -> Column:
    """``gateway``: the fixed table; ``suffix``: what follows the type's last dot, in capitals."""
    return mapped(LABELS, kind, "REDACTED") if style == "gateway" else F.upper(F.substring_index(kind, ".", -1))


def numbered(findings: Column, style: str = "gateway", numbering: str = "forward") -> Column:
    """Each distinct value with its placeholder, numbered per label by first occurrence (``reverse``: from the last finding backwards)."""
    order = F.reverse(findings) if numbering == "reverse" else findings

    def step(acc: Column, f: Column) -> Column:
        label = label_of(f["type"], style)
        n = F.size(F.filter(acc, lambda y: y["label"] == label)) + 1
        entry = F.struct(f["value"].alias("value"), label.alias("label"), F.concat(F.lit("["), label, F.lit("_"), n.cast("string"), F.lit("]")).alias("placeholder"))
        return F.when(F.exists(acc, lambda y: y["value"] == f["value"]), acc).otherwise(F.concat(acc, F.array(entry)))

    return F.aggregate(order, F.array().cast(_SEEN), step)


def _in_gap(gap: Column, seen: Column) -> Column:
    longest = F.array_sort(seen, lambda a, b: F.when(F.length(a["value"]) > F.length(b["value"]), -1).when(F.length(a["value"]) < F.length(b["value"]), 1).otherwise(F.lit(0)))
    return F.aggregate(longest, gap, lambda t, v: F.replace(t, v["value"], v["placeholder"]))


def spliced(source: Column, chosen: Column, seen: Column, everywhere: bool = True) -> Column:
    """The text with each chosen finding (in order of start) replaced by its value's placeholder."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def gap(a: Column, n: Column) -> Column:
        g = F.substring(source, a + 1, n)
        return _in_gap(g, seen) if everywhere else g

    def step(acc: Column, f: Column) -> Column:
        mark = F.element_at(F.filter(seen, lambda y: y["value"] == f["value"]), 1)["placeholder"]
        return F.struct(f["end"].alias("at"), F.concat(acc["out"], gap(acc["at"], f["start"] - acc["at"]), mark).alias("out"))

    return F.aggregate(chosen, start, step, lambda a: F.concat(a["out"], gap(a["at"], F.char_length(source) - a["at"])))


def vault_of(seen: Column) -> Column:
    return F.map_from_arrays(F.transform(seen, lambda y: y["placeholder"]), F.transform(seen, lambda y: y["value"]))


def redacted(df: DataFrame, text: str = "text", findings: str = "findings", ids: Column | None = None, style: str = "gateway", numbering: str = "forward", everywhere: bool = True) -> DataFrame:
    """Adds ``redacted_text``, ``vault`` (placeholder -> value) and ``redacted`` (count of findings). ``ids``: an array of finding ids to redact, all by default. ``everywhere``: also other occurrences of a known value, between placeholders."""
    chosen = F.col(findings) if ids is None else F.filter(F.col(findings), lambda f: F.array_contains(ids, f["id"]))
    step1 = barrier(df, _chosen=by_start(chosen))
    step2 = barrier(step1, _seen=numbered(F.col("_chosen"), style, numbering))
    whole = spliced(F.coalesce(F.col(text), F.lit("")), F.col("_chosen"), F.col("_seen"), everywhere)
    return step2.select(*df.columns, F.when(F.size("_chosen") > 0, whole).otherwise(F.col(text)).alias("redacted_text"), vault_of(F.col("_seen")).alias("vault"), F.size("_chosen").alias("redacted"))


def restored(text: Column | str, vault: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.aggregate(F.map_entries(vault), text, lambda t, e: F.replace(t, e["key"], e["value"]))
