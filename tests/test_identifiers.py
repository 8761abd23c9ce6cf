"""Issued numbers: published examples, check digits against plain arithmetic, thresholds, and many literal values in one pass."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell import whole
from tidewell.functions import spans
from tidewell.operators import detect, identifiers, named_values

CHECKS = {r.label: r.check for r in identifiers.RECOGNISERS if r.check}
# Examples that issuers and standards publish.
VALID = [
    ("AU_ABN", "51 824 753 556"), ("AU_ABN", "53004085616"), ("AU_ACN", "004 085 616"), ("AU_ACN", "000 000 019"), ("AU_TFN", "123 456 782"), ("AU_MEDICARE", "2123 45670 1"),
    ("ABA_ROUTING_NUMBER", "121000358"), ("ABA_ROUTING_NUMBER", "0210-0002-1"), ("US_NPI", "1234567893"), ("US_NPI", "1245319599"),
    ("IBAN_CODE", "GB82 WEST 1234 5698 7654 32"), ("IBAN_CODE", "DE89370400440532013000"), ("IBAN_CODE", "NO9386011117947"),
]
SHAPES = [("US_MBI", "mbi 1EG4-TE5-MK72"), ("UK_NINO", "AB 12 34 56 C"), ("UK_PASSPORT", "passport AB1234567"), ("UK_DRIVING_LICENCE", "MORGA657054SM9IJ"), ("UK_POSTCODE", "address: SW1A 1AA"), ("UK_VEHICLE_REGISTRATION", "plate AB51 CDE")]
NO_SHAPES = ["SW1A 1AA", "plain AB51 CDE here", "BG 12 34 56 C", "AB1234567", "1SG4-TE5-MK72 mbi", "GB82 WEST 1234 5698 7654 33", "51 824 753 557", "a51824753556", "518247535561"]


def test_published_numbers(spark):
    for label in CHECKS:
        own = [v for k, v in VALID if k == label]
        wrong = [v[:-1] + str((int(v[-1]) + 1) % 10) for v in own if label != "AU_MEDICARE"] + ["1", ""]
        got = spark.createDataFrame([(v, True) for v in own] + [(v, False) for v in wrong], "v string, want boolean").select("v", "want", F.coalesce(CHECKS[label](F.col("v")), F.lit(False)).alias("got")).collect()
        assert all(r["got"] == r["want"] for r in got), (label, got)


def plain(label, v):
    d = [int(c) for c in v if c.isdigit()]
    dot = lambda w, d=d: sum(a * b for a, b in zip(w, d, strict=False))
    if label == "AU_ABN":
        return dot(identifiers.ABN_WEIGHTS, [d[0] - 1, *d[1:]]) % 89 == 0
    if label == "AU_ACN":
        return -dot(identifiers.ACN_WEIGHTS) % 10 == d[8]
    if label == "AU_TFN":
        return dot(identifiers.TFN_WEIGHTS) % 11 == 0
    if label == "AU_MEDICARE":
        return 2 <= d[0] <= 6 and dot(identifiers.MEDICARE_WEIGHTS) % 10 == d[8]
    if label == "ABA_ROUTING_NUMBER":
        return dot(identifiers.ROUTING_WEIGHTS) % 10 == 0
    if label == "US_NPI":
        e = [8, 0, 8, 4, 0, *d][::-1]
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(e)) % 10 == 0
    code = v[4:] + v[:4]
    return int("".join(str(int(c, 36)) for c in code)) % 97 == 1


@pytest.mark.parametrize(("label", "size"), [("AU_ABN", 11), ("AU_ACN", 9), ("AU_TFN", 9), ("AU_MEDICARE", 10), ("ABA_ROUTING_NUMBER", 9), ("US_NPI", 10), ("IBAN_CODE", 18)])
def test_check_digits_against_plain_arithmetic(spark, label, size):
    rng = random.Random(size)
    values = ["".join(rng.choice("0123456789") for _ in range(size)) for _ in range(600)]
    if label == "IBAN_CODE":
        values = [f"GB{v[:2]}WEST{v[4:]}" for v in values]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", CHECKS[label](F.col("v")).alias("ok")).collect()
    assert {r["v"]: r["ok"] for r in got} == {v: plain(label, v) for v in values}


def test_shapes_and_context(spark):
    rows = [(label, t) for label, t in SHAPES] + [(None, t) for t in NO_SHAPES] + [(None, ""), (None, None)]
    got = identifiers.with_entities(spark.createDataFrame(rows, "want string, text string")).collect()
    for r in got:
        labels = {e["label"] for e in r["entities"]}
        assert (r["want"] in labels) if r["want"] else not labels, r
        assert all(r["text"][e["start"]:e["end"]] == e["value"] for e in r["entities"])


def test_a_context_word_far_away_does_not_count(spark):
    near, far = "passport" + " " * 52 + "AB1234567", "passport" + " " * 53 + "AB1234567"
    got = [r["entities"] for r in identifiers.with_entities(spark.createDataFrame([(near,), (far,)], "text string")).collect()]
    assert [[e["score"] for e in es] for es in got] == [[0.55], []]


def test_findings_follow_from_entities(spark):
    text = "é call about tfn 123 456 782 or GB82 WEST 1234 5698 7654 32"
    df = identifiers.with_entities(spark.createDataFrame([(text,)], "text string"))
    assert [(f["type"], f["value"]) for f in detect.recognised(df).first()["findings"]] == [("pii.national_id", "123 456 782"), ("pii.bank_account", "GB82 WEST 1234 5698 7654 32")]


def test_texts_are_searched_in_one_pass(spark):
    """All shapes in one pass: the plan matches no text again to split it; places as a plain search has them, with what stands around."""
    rows = [(i, t) for i, t in enumerate([None, "", "é 123 456 782", "123456782 " * 30, "x1234567890 😀 GB82 WEST 1234 5698 7654 32 AB51 CDE", "_123456782 123456782_ 1234567821 12345678"])]
    df = spark.createDataFrame(rows, "k int, text string")
    plan = identifiers.with_entities(df)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_extract_all" not in plan and plan.count("arrowevalpython") == 1
    chosen = [(r.pattern, r.first) for r in identifiers.RECOGNISERS] + [(r"\b\d+", None)]
    got = df.select("k", F.inline(spans.matches("text", chosen, 7))).collect()
    want = [(k, i, *m.span(), m.group(), t[max(m.start() - 7, 0):max(m.start() - 7, 0) + len(m.group()) + 14]) for k, t in rows for i, (p, _) in enumerate(chosen) for m in re.finditer(p, t or "", re.ASCII)]
    assert [tuple(r) for r in got] == want and len(want) > 50


def test_issued_numbers_by_label_read_texts_once(spark):
    out = whole.q_issued_numbers_by_label(spark, "/root/testdata/sf0.001")
    assert not [f for f in out.inputFiles() if "documents" in f]


# -- named values


def brute(texts, values):
    out = set()
    for k, t in texts:
        for v in {v for v in values if v and v.strip()}:
            at = t.find(v) if t else -1
            while at >= 0:
                out.add((k, at, at + len(v), v))
                at = t.find(v, at + len(v))
    return out


@pytest.mark.parametrize("part_chars", [1 << 20, 40])
def test_values_in_one_pass(spark, part_chars):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abé😀 ") for _ in range(n))
    texts = [(i, word(rng.randint(0, 300))) for i in range(40)] + [(40, None), (41, ""), (42, "a" * 1000)]
    values = [word(rng.randint(1, 4)) for _ in range(60)] + ["aa", "aaa", " ", "", None, "aa", "\t\n", "zzz"]
    frames = spark.createDataFrame(texts, "k long, text string").repartition(3), spark.createDataFrame([(v,) for v in values], "value string")
    got = [tuple(r) for r in named_values.found(*frames, "k", part_chars=part_chars).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(texts, values)


def test_thousands_of_values(spark):
    texts = spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("x name-"), F.col("id") * 97, F.lit(" name-"), F.col("id"), F.lit(".")).alias("text"))
    values = spark.range(20_000).select(F.concat(F.lit("name-"), "id").alias("value"))
    kept = named_values.longest_first(named_values.found(texts, values, "k"), "k")
    assert {(r["k"], r["value"]) for r in kept.collect()} == {(k, f"name-{n}") for k in range(50) for n in (97 * k, k)}
    assert named_values.found(texts, values.limit(0), "k").count() == 0


def test_grounding_of_chunks(spark):
    body = "filler words " * 300
    text = f"Margarethe {body} met Margarethes friend {body} Margarethe"
    def namer(chunk):
        if "boom" in chunk:
            raise RuntimeError
        return [("person", "Margarethe")] * ("Margarethe " in chunk) + [("person", "Margarethes")] * ("Margarethes" in chunk) + [("planet", "filler"), ("person", " ")]
    rows = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (4, "no one", 0), (5, "x " * 3000 + "boom", 0)], "k long, text string, error int")
    got = {r["k"]: r for r in detect.grounded_in_chunks(rows.drop("error"), "k", namer).collect()}
    assert [(f["value"], text[f["start"]:f["end"]] == f["value"]) for f in got[1]["findings"]] == [("Margarethe", True), ("Margarethes", True), ("Margarethe", True)]
    assert got[5]["error"] == "RuntimeError" and got[1]["error"] is None
    assert all(got[k]["findings"] == [] for k in (2, 3, 4, 5))
