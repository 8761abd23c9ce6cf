"""Numbers and codes that countries and banks issue, recognised by shape, check digits and the words around them.

A match that has check digits counts fully if they are right and not at all if they are wrong. One without keeps its shape's
score, raised where a context word stands near. All checks are Column folds over a value's digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ascii_boundaries, passes_threshold
from ..functions.spans import bound, matches
from .detect import CONTEXT_BOOST, CONTEXT_CHARS, DEFAULT_THRESHOLD, THRESHOLDS

ENTITY = "struct<label:string,start:int,end:int,value:string,score:double>"

# The weights of the public check-digit rules.
ABN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
ACN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 1)
TFN_WEIGHTS = (1, 4, 3, 7, 5, 8, 6, 9, 10)
MEDICARE_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9)
ROUTING_WEIGHTS = (3, 7, 1, 3, 7, 1, 3, 7, 1)
NPI_PREFIX = "80840"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def digit(digits: Column, i: int) -> Column:
    return F.ascii(F.substring(digits, i, 1)) - 48


def weighted(digits: Column, weights: Iterable[int]) -> Column:
    """The sum of the first digits, each times its weight."""
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total = total + digit(digits, i) * w
    return total


def abn(value: Column) -> Column:
    """Eleven digits: the weighted sum, the first digit less one, is a multiple of 89."""
    return bound(digits_of(value), lambda d: (F.length(d) == 11) & ((weighted(d, ABN_WEIGHTS) - ABN_WEIGHTS[0]) % 89 == 0))


def acn(value: Column) -> Column:
    """Nine digits: the last completes the others' weighted sum to a multiple of ten."""
    return bound(digits_of(value), lambda d: (F.length(d) == 9) & ((weighted(d, ACN_WEIGHTS) + digit(d, 9)) % 10 == 0))


def tfn(value: Column) -> Column:
    return bound(digits_of(value), lambda d: (F.length(d) == 9) & (weighted(d, TFN_WEIGHTS) % 11 == 0))


def medicare(value: Column) -> Column:
    """Ten digits, the first from 2 to 6: the ninth is the weighted sum's last digit."""
    return bound(digits_of(value), lambda d: (F.length(d) == 10) & digit(d, 1).between(2, 6) & (weighted(d, MEDICARE_WEIGHTS) % 10 == digit(d, 9)))


def routing(value: Column) -> Column:
    return bound(digits_of(value), lambda d: (F.length(d) == 9) & (weighted(d, ROUTING_WEIGHTS) % 10 == 0))


def npi(value: Column) -> Column:
    """Ten digits that pass the Luhn check behind the issuer's prefix."""
    return bound(digits_of(value), lambda d: (F.length(d) == 10) & F.call_function("luhn_check", F.concat(F.lit(NPI_PREFIX), d)))


def iban(value: Column) -> Column:
    """The account moved before country and check digits, letters as 10 to 35: the remainder by 97 is 1."""
    def step(rest: Column, c: Column) -> Column:
        n = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(n > 9, 100).otherwise(10) + n) % 97

    def checked(code: Column) -> Column:
        turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
        return F.length(code).between(15, 34) & (F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1)

    return bound(F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", "")), checked)


@dataclass(frozen=True)
class Recogniser:
    """``score`` is the shape's own; ``check`` settles it; a match begins with one of ``first``, the only places where it is tried."""

    label: str
    pattern: str
    score: float
    context: tuple[str, ...]
    check: Callable[[Column], Column] | None = None
    first: str | None = "0-9"


# Shapes by the issuers' public formats. Scores and context words are ours.
RECOGNISERS = (
    Recogniser("AU_ABN", r"\b\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{3}\b", 0.1, ("abn", "business number"), abn),
    Recogniser("AU_ACN", r"\b\d{3}[ ]?\d{3}[ ]?\d{3}\b", 0.1, ("acn", "company number"), acn),
    Recogniser("AU_TFN", r"\b\d{3}[ ]?\d{3}[ ]?\d{3}\b", 0.1, ("tfn", "tax file"), tfn),
    Recogniser("AU_MEDICARE", r"\b[2-6]\d{3}[ ]?\d{5}[ ]?\d\b", 0.1, ("medicare",), medicare),
    Recogniser("ABA_ROUTING_NUMBER", r"\b[0123678]\d{3}-?\d{4}-?\d\b", 0.1, ("aba", "routing", "bank"), routing),
    Recogniser("US_NPI", r"\b[12]\d{3}[ -]?\d{3}[ -]?\d{3}\b", 0.1, ("npi", "provider"), npi),
    Recogniser("US_MBI", r"\b[1-9][AC-HJKMNP-RT-Y][0-9AC-HJKMNP-RT-Y]\d-?[AC-HJKMNP-RT-Y][0-9AC-HJKMNP-RT-Y]\d-?[AC-HJKMNP-RT-Y]{2}\d{2}\b", 0.3, ("mbi", "beneficiary", "medicare")),
    Recogniser("UK_NINO", r"\b(?:[ACEHJLMOPRSWXY][A-CEGHJ-NPR-TW-Z]|B[A-CEHJ-NPR-TW-Z]|G[ACEGHJ-NPR-TW-Z]|K[A-CEGHJ-MPR-TW-Z]|N[A-CEGHJLMNPRSW-Z]|T[A-CEGHJ-MPR-TW-Z]|Z[A-CEGHJ-NPR-TW-Y])[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]\b", 0.5, ("nino", "national insurance"), first="A-Z"),
    Recogniser("UK_PASSPORT", r"\b[A-Z]{2}\d{7}\b", 0.2, ("passport",), first="A-Z"),
    Recogniser("UK_DRIVING_LICENCE", r"\b[A-Z9]{5}\d(?:0[1-9]|1[0-2]|5[1-9]|6[0-2])(?:0[1-9]|[12]\d|3[01])\d[A-Z9]{2}[A-Z0-9]{3}\b", 0.5, ("licence", "driving", "dvla"), first="A-Z9"),
    Recogniser("UK_POSTCODE", r"\b(?:GIR[ ]?0AA|[A-PR-UWYZ](?:\d{1,2}|[A-HK-Y]\d[0-9A-Z]?|\d[A-HJKPSTUW])[ ]?\d[ABD-HJLNP-UW-Z]{2})\b", 0.2, ("postcode", "address"), first="A-Z"),
    Recogniser("UK_VEHICLE_REGISTRATION", r"\b[A-HJ-PR-Y]{2}(?:0[2-9]|[12]\d|5[1-9]|[67]\d)[ ]?[A-HJ-PR-Z]{3}\b", 0.2, ("vehicle", "registration", "plate"), first="A-Z"),
    Recogniser("IBAN_CODE", r"\b[A-Z]{2}\d{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?\b", 0.1, ("iban", "account"), iban, "A-Z"),
)


def with_entities(df: DataFrame, text: str = "text", recognisers: Iterable[Recogniser] = RECOGNISERS) -> DataFrame:
    """Adds ``entities`` (ENTITY): matches of each recogniser in its order and then by place, each scored, those under their threshold left out. Entities of different labels may overlap; ``detect.recognised`` settles that. Null text: none."""
    recognisers = tuple(recognisers)
    found = df.withColumn("_m", matches(F.col(text), [(r.pattern, r.first) for r in recognisers], CONTEXT_CHARS))
    labels = F.array(*[F.lit(r.label) for r in recognisers])

    def scored(x: Column) -> Column:
        score = F.lit(None).cast("double")
        for i, r in reversed(list(enumerate(recognisers))):
            score = F.when(x["i"] == i, _score(x, r)).otherwise(score)
        return F.struct(F.get(labels, x["i"]).alias("label"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), score.alias("score"))

    return found.select(*df.columns, F.filter(F.transform("_m", scored), lambda e: passes_threshold(e["label"], e["score"], THRESHOLDS, DEFAULT_THRESHOLD)).cast(f"array<{ENTITY}>").alias("entities"))


def _score(x: Column, r: Recogniser) -> Column:
    """A match's score; null if its check digits are wrong."""
    if r.check:
        return F.when(r.check(x["value"]), F.lit(1.0))
    near = ascii_boundaries(r"(?i)\b(?:" + "|".join(r.context) + r")\b")
    return F.when(x["around"].rlike(near), F.lit(round(r.score + CONTEXT_BOOST, 3))).otherwise(F.lit(round(r.score, 3)))
