"""Detectors of personal data and secrets as Column expressions, merged by priority without overlaps."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ascii_boundaries, literal_matches, mapped, passes_threshold
from ..functions.spans import accepted, barrier, by_length_stable, by_score_stable, by_score_then_length, by_start, large_chunks, located, matches, rebased

# The detectors in order of priority.
PATTERNS = {
    "secret.api_key": r"\b(?:sk-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16})\b",
    "pci.card_number": r"\b(?:\d[ -]?){13,19}\b",
    "pii.national_id": r"\b\d{3}-\d{2}-\d{4}\b",
    "pii.email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "pii.phone": r"\+?\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3,4}[ -]?\d{3,4}\b",
}

# Finding types and the component that finds them.
SOURCES = {
    "pii.email": "gateway",
    "pii.phone": "gateway",
    "pii.national_id": "gateway",
    "pci.card_number": "gateway",
    "secret.api_key": "gateway",
    "pii.name": "pii-service",
    "pii.address": "pii-service",
    "pii.bank_account": "pii-service",
    "secret.password": "pii-service",
}

# Model labels and their finding types.
MODEL_LABELS = {
    "person": "pii.name",
    "email": "pii.email",
    "phone_number": "pii.phone",
    "street_address": "pii.address",
    "national_id_number": "pii.national_id",
    "passport_number": "pii.national_id",
    "iban": "pii.bank_account",
    "bank_account": "pii.bank_account",
    "card_number": "pci.card_number",
    "api_key": "secret.api_key",
    "password": "secret.password",
}

# Entity types of the recognisers and their finding types.
ENTITY_LABELS = {
    "PERSON": "pii.name",
    "EMAIL_ADDRESS": "pii.email",
    "PHONE_NUMBER": "pii.phone",
    "LOCATION": "pii.address",
    "US_SSN": "pii.national_id",
    "US_PASSPORT": "pii.national_id",
    "US_DRIVER_LICENSE": "pii.national_id",
    "US_ITIN": "pii.national_id",
    "US_MBI": "pii.national_id",
    "US_NPI": "pii.national_id",
    "UK_NHS": "pii.national_id",
    "UK_NINO": "pii.national_id",
    "UK_PASSPORT": "pii.national_id",
    "UK_DRIVING_LICENCE": "pii.national_id",
    "UK_VEHICLE_REGISTRATION": "pii.national_id",
    "UK_POSTCODE": "pii.address",
    "AU_TFN": "pii.national_id",
    "AU_MEDICARE": "pii.national_id",
    "AU_DRIVER_LICENCE": "pii.national_id",
    "AU_ABN": "pii.national_id",
    "AU_ACN": "pii.national_id",
    "IBAN_CODE": "pii.bank_account",
    "US_BANK_NUMBER": "pii.bank_account",
    "ABA_ROUTING_NUMBER": "pii.bank_account",
    "CREDIT_CARD": "pci.card_number",
    "API_KEY": "secret.api_key",
}
# Least scores by label.
THRESHOLDS = {"PERSON": 0.6, "LOCATION": 0.6, "PHONE_NUMBER": 0.4, "API_KEY": 0.4}
DEFAULT_THRESHOLD = 0.5

# Licence patterns with base scores, and the words that support them.
LICENCE_PATTERNS = (
    (r"\b(?:NSW|VIC|QLD|WA|SA|TAS|NT|ACT)\s?[A-Z]{0,2}\d{5,10}\b", 0.4),
    (r"\b[A-Z]{1,2}\d{5,9}\b", 0.2),
    (r"\b\d{6,10}\b", 0.2),
)
LICENCE_CONTEXT = ("licence", "license", "driver", "drivers", "driving", "dl")
# Key patterns with their scores.
KEY_PATTERNS = ((r"\bsk-[A-Za-z0-9_-]{20,}\b", 0.8), (r"\bAKIA[0-9A-Z]{16}\b", 0.9))
# What matches of these patterns begin with.
LICENCE_FIRSTS, KEY_FIRSTS = ("NVQWSTA", "A-Z", "0-9"), ("s", "A")
CONTEXT_BOOST, CONTEXT_CHARS = 0.35, 60  # ours: the library that holds the rule isn't part of the job

#: What a text must hold for a pattern to match at all (a cheap scan), and the characters that a match may begin with.
GUARDS: dict[str, tuple[Callable[[Column], Column], str | None]] = {
    "secret.api_key": (lambda t: t.contains("sk-") | t.contains("AKIA"), "sA"),
    "pci.card_number": (lambda t: t.rlike("[0-9][0-9 -]{12}"), "0-9"),
    "pii.national_id": (lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), "0-9"),
    "pii.email": (lambda t: t.contains("@"), None),
    "pii.phone": (lambda t: t.rlike("[0-9][0-9() -]{8}"), None),
}

FINDING = "struct<id:string,type:string,start:int,end:int,byte_start:int,byte_end:int,value:string>"
SPAN = "struct<type:string,start:int,end:int,value:string>"
PLACED = "struct<type:string,start:int,end:int,byte_start:int,byte_end:int,value:string>"


def luhn(value: Column) -> Column:
    """At least 13 digits and a right check digit; separators don't count."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (F.length(digits) >= 13) & F.call_function("luhn_check", digits)


def match_counts(text: Column | str) -> dict[str, Column]:
    """Raw matches of each pattern, before checks and overlaps."""
    return {t: F.regexp_count(text, F.lit(as_run(t, p))) for t, p in PATTERNS.items()}


def as_run(kind: str, pattern: str) -> str:
    """The pattern with the same matches, for an engine that backtracks: where it can begin is seen at once, and a run of an email's local characters is read once, from its first or from where the match before ended, however long it is."""
    full = ascii_boundaries(pattern)
    if pattern != PATTERNS.get(kind):
        return full
    first = GUARDS[kind][1]
    if kind == "pii.email":
        local, rest = full.split("+@")
        return rf"(?:(?<!{local})|\G){local}++@{rest}"
    return (f"(?=[{first}])" if first else "") + full


def _typed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))


def _placed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("type"), *[x[n].alias(n) for n in ("start", "end", "byte_start", "byte_end", "value")]))


def _checked(spans: Column, check: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda x: check(x["value"]))


def with_findings(df: DataFrame, text: str = "text", patterns: Mapping[str, str] = PATTERNS, valid: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Adds ``findings`` (FINDING, ids f1.. in order of acceptance): each detector's matches in order of priority, less those that fail their check or overlap an accepted one. Null text: none."""
    valid = valid if valid is not None else {"pci.card_number": luhn}
    t = F.coalesce(F.col(text), F.lit(""))
    full, guards = {}, {}
    for i, (kind, p) in enumerate(patterns.items()):
        full[kind] = as_run(kind, p)
        guards[f"_g{i}"] = GUARDS[kind][0](t) if p == PATTERNS.get(kind) else t.rlike(full[kind])
    cols = {}
    for i, p in enumerate(full.values()):
        cols[f"_p{i}"], cols[f"_h{i}"] = F.when(F.col(f"_g{i}"), F.split(t, p, -1)), F.when(F.col(f"_g{i}"), F.regexp_extract_all(t, F.lit(p), 0))
    cut = barrier(barrier(df, **guards), **cols)
    spans = []
    for i, kind in enumerate(full):
        hits = _placed(located(F.coalesce(F.col(f"_p{i}"), F.array()), F.coalesce(F.col(f"_h{i}"), F.array())), kind)
        check = valid.get(kind)
        spans.append(hits if check is None else _checked(hits, check))
    found = barrier(cut, _found=F.concat(*spans))
    kept = barrier(found, _kept=accepted(F.col("_found"), PLACED))
    findings = F.transform(F.col("_kept"), lambda x, i: F.struct(F.concat(F.lit("f"), (i + 1).cast("string")).alias("id"), x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["byte_start"].alias("byte_start"), x["byte_end"].alias("byte_end"), x["value"].alias("value")))
    return kept.select(*df.columns, findings.cast(f"array<{FINDING}>").alias("findings"))


def numbered_across_messages(df: DataFrame, request: str, message: str) -> DataFrame:
    """Ids that count on through a request's messages."""
    before = F.coalesce(F.sum(F.size("findings")).over(Window.partitionBy(request).orderBy(message).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_before", before).withColumn("findings", F.transform("findings", lambda f, i: f.withField("id", F.concat(F.lit("f"), (F.col("_before") + i + 1).cast("string"))))).drop("_before")


def merged_findings(own: Column, other: Column) -> Column:
    """Detector findings first; another source's only where they overlap none, their ids counting on."""
    extra = F.filter(other, lambda x: ~F.exists(own, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return F.concat(own, F.transform(extra, lambda x, i: x.withField("id", F.concat(F.lit("f"), (F.size(own) + i + 1).cast("string")))))


def scored_matches(text: Column, patterns: tuple[tuple[str, float], ...], label: str, firsts: tuple[str, ...] | None = None) -> Column:
    """array<struct<label, start, end, value, score>> of constant-score patterns; ``firsts`` are the characters that their matches begin with."""
    return _scored(matches(text, _tried(patterns, firsts)), label, patterns)


def _tried(patterns: tuple[tuple[str, float], ...], firsts: tuple[str, ...] | None) -> list[tuple[str, str | None]]:
    return [(p, firsts[i] if firsts else None) for i, (p, _) in enumerate(patterns)]


def _scored(spans: Column, label: str, patterns: tuple[tuple[str, float], ...], boosted: Callable[[Column, Column], Column] | None = None) -> Column:
    scores = F.array(*[F.lit(score) for _, score in patterns])

    def one(x: Column) -> Column:
        score = F.get(scores, x["i"])
        return F.struct(F.lit(label).alias("label"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), (boosted(x, score) if boosted else score).alias("score"))

    return F.transform(spans, one)


def api_keys(text: Column) -> Column:
    return scored_matches(text, KEY_PATTERNS, "API_KEY", KEY_FIRSTS)


def driver_licences(text: Column) -> Column:
    """Licence-like numbers of which a context word stands within CONTEXT_CHARS characters; without one they stay under the threshold."""
    near = ascii_boundaries(r"(?i)\b(?:" + "|".join(LICENCE_CONTEXT) + r")\b")
    found = _scored(matches(text, _tried(LICENCE_PATTERNS, LICENCE_FIRSTS), CONTEXT_CHARS), "AU_DRIVER_LICENCE", LICENCE_PATTERNS, lambda x, score: F.round(F.when(x["around"].rlike(near), score + CONTEXT_BOOST).otherwise(score), 3))
    return F.filter(found, lambda x: passes_threshold(x["label"], x["score"], THRESHOLDS, DEFAULT_THRESHOLD))


def grounded(text: Column, label: str, value: str) -> Column:
    """Every occurrence of a value that a model named; blank values, unknown labels and values not in the text give none."""
    kind = MODEL_LABELS.get(label)
    if not kind or not value.strip():
        return F.array().cast(f"array<{SPAN}>")
    hits = literal_matches(text, value)
    parts = F.split(text, "\\Q" + value.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    return _typed(located(parts, hits), kind)


def detected_by(df: DataFrame, detector: Callable[[str], list[dict]], text: str = "text") -> DataFrame:
    """Adds ``findings`` of a plugged-in detector (a model, a service): text -> dicts of type, start, end (characters), score. An error marks the row instead of passing it on unchecked."""
    kind = "struct<error:string,findings:array<struct<type:string,start:int,end:int,byte_start:int,byte_end:int,value:string,score:double>>>"

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            t = t or ""
            try:
                found = detector(t) if t else []
                if any(not 0 <= f["start"] <= f["end"] <= len(t) for f in found):
                    raise ValueError("a span lies outside its text")
                rows.append((None, [{"type": f["type"], "start": f["start"], "end": f["end"], "byte_start": len(t[:f["start"]].encode()), "byte_end": len(t[:f["end"]].encode()), "value": t[f["start"]:f["end"]], "score": float(f.get("score", 1.0))} for f in found]))
            except Exception as e:  # the row fails closed
                rows.append((type(e).__name__, []))
        return pd.DataFrame(rows, columns=["error", "findings"])

    return barrier(df, _d=run(F.col(text))).select("*", F.col("_d.error").alias("error"), by_start(F.col("_d.findings")).alias("findings")).drop("_d")


def detected_in_chunks(df: DataFrame, key: str, detector: Callable[[str], list[dict]], text: str = "text") -> DataFrame:
    """(key, error, findings): texts are cut into chunks, each is detected on its own with its overlaps resolved by score, and
    spans move to the whole text's offsets; chunks aren't compared with each other. One bad chunk fails its row. Texts without
    findings have an empty array."""
    chunks = df.select(key, F.explode_outer(large_chunks(F.col(text))).alias("c")).select(key, F.col("c.offset").alias("_o"), F.col("c.byte_offset").alias("_b"), F.col("c.chunk").alias("chunk"))
    found = detected_by(chunks, detector, "chunk")
    kind = "struct<type:string,start:int,end:int,byte_start:int,byte_end:int,value:string,score:double>"
    own = barrier(found, _kept=accepted(by_score_stable(F.col("findings")), kind))
    moved = own.select(key, "error", "_o", rebased(F.col("_kept"), F.coalesce("_o", F.lit(0)), F.coalesce("_b", F.lit(0))).alias("f"))
    return moved.groupBy(key).agg(F.max("error").alias("error"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", "f"))), lambda x: x["f"])).alias("all")).select(key, "error", F.when(F.col("error").isNull(), by_start(F.col("all"))).otherwise(F.array().cast(f"array<{kind}>")).alias("findings"))


def recognised(df: DataFrame, entities: str = "entities", text: str = "text") -> DataFrame:
    """Adds ``findings`` from recognisers' entities (array of struct label, start, end in characters, score): those of a known label that reach its threshold, as findings, best score first and longest on ties where they overlap."""
    t = F.coalesce(F.col(text), F.lit(""))
    good = F.filter(entities, lambda e: mapped(ENTITY_LABELS, e["label"]).isNotNull() & passes_threshold(e["label"], e["score"], THRESHOLDS, DEFAULT_THRESHOLD))
    spans = F.transform(good, lambda e: F.struct(mapped(ENTITY_LABELS, e["label"]).alias("type"), e["start"].alias("start"), e["end"].alias("end"), F.substring(t, e["start"] + 1, e["end"] - e["start"]).alias("value"), e["score"].alias("score")))
    step = barrier(df, _spans=by_score_then_length(F.coalesce(spans, F.array())))
    step = barrier(step, _kept=accepted(F.col("_spans"), "struct<type:string,start:int,end:int,value:string,score:double>"))
    return step.select(*df.columns, by_start(F.col("_kept")).alias("findings"))


def grounded_entities(df: DataFrame, entities: str = "entities", text: str = "text") -> DataFrame:
    """Adds ``findings``: all occurrences of values that a model named (array of struct label, value) in the whole text, longest first where they overlap. Blank values, unknown labels and values that aren't in the text give none."""

    @F.pandas_udf(f"array<{SPAN}>")
    def run(texts: pd.Series, named: pd.Series) -> pd.Series:
        out = []
        for t, es in zip(texts, named, strict=True):
            t, spans = t or "", []
            for label, value in dict.fromkeys((e["label"], e["value"]) for e in (es if es is not None else [])):
                kind, at = MODEL_LABELS.get(label), -1
                while kind and value and value.strip() and (at := t.find(value, at + 1 if at < 0 else at + len(value))) >= 0:
                    spans.append({"type": kind, "start": at, "end": at + len(value), "value": value})
            out.append(spans)
        return pd.Series(out)

    step = barrier(df, _spans=run(F.col(text), F.col(entities)))
    return barrier(step, _kept=accepted(by_length_stable(F.col("_spans")), SPAN)).select(*df.columns, by_start(F.col("_kept")).alias("findings"))


def grounded_in_chunks(df: DataFrame, key: str, namer: Callable[[str], list[tuple[str, str]]], text: str = "text") -> DataFrame:
    """(key, error, findings): a model names (label, value) in each chunk of a text; the distinct ones of all its chunks are
    looked for in the whole text, longest first where they overlap. One bad chunk fails its row, which then has no findings.
    Keys are distinct."""

    @F.pandas_udf("struct<error:string,named:array<struct<label:string,value:string>>>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            try:
                rows.append((None, [{"label": label, "value": value} for label, value in namer(t)] if t else []))
            except Exception as e:  # the row fails closed
                rows.append((type(e).__name__, []))
        return pd.DataFrame(rows, columns=["error", "named"])

    chunks = df.select(key, F.explode(F.transform(large_chunks(F.col(text)), lambda c: c["chunk"])).alias("_chunk"))
    named = barrier(chunks, _d=run(F.col("_chunk"))).groupBy(F.col(key).alias("_key")).agg(F.max("_d.error").alias("error"), F.array_distinct(F.flatten(F.collect_set("_d.named"))).alias("_named"))
    met = df.select(key, text).join(named, F.col(key) == F.col("_key"), "left").withColumn("_named", F.when(F.col("error").isNull(), F.array_sort(F.coalesce("_named", F.array()))).otherwise(F.array()))
    return grounded_entities(met, "_named", text).select(key, "error", "findings")
