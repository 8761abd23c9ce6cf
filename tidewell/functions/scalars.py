"""Scalar helpers as Column builders: buckets, readable sizes, tiers, deterministic ids, offsets, thresholds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .city import number_hash, unsigned_mod

#: A word boundary over ASCII word characters only, whatever the regex engine's own rule is.
ASCII_B = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def ascii_boundaries(pattern: str) -> str:
    return pattern.replace(r"\b", ASCII_B)


def start_of(unit: str, ts: Column | str) -> Column:
    """The bucket's first moment, still without a time zone."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def yyyymm(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyyMM").cast("int")


def seconds_between(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))).cast("double") / 1e6


def readable_size(n: Column | str) -> Column:
    """Bytes as B, KiB, MiB, GiB or TiB with two decimals."""
    n = (F.col(n) if isinstance(n, str) else n).cast("double")
    out = F.format_string("%.2f B", n)
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024.0**i, F.format_string(f"%.2f {unit}", n / 1024.0**i)).otherwise(out)
    return out


def multi_if(*rules: tuple[Column, object], otherwise: object) -> Column:
    """The first rule that holds decides."""
    out = F
    for when, value in rules:
        out = out.when(when, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def pick(values: list[str], index: Column) -> Column:
    """values[index], from 0, for an index already reduced modulo the length."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def hash_uuid(*cols: Column | object) -> Column:
    """A reproducible id in UUID form."""
    h = F.md5(F.concat_ws("|", *[(c if isinstance(c, Column) else F.lit(c)).cast("string") for c in cols]))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def shard_number(key: Column | str, shards: int, whole: bool = True) -> Column:
    """1..shards by the key's hash: the city hash of whole numbers, else Spark's own."""
    return ((unsigned_mod(number_hash(key), shards) if whole else F.pmod(F.xxhash64(key), F.lit(shards))) + 1).cast("int")


def byte_offset(text: Column, chars: Column) -> Column:
    """UTF-8 bytes before a character offset."""
    return F.octet_length(F.substring(text, F.lit(1), chars.cast("int")))


def has_token(text: Column | str, token: str) -> Column:
    return F.array_contains(F.split(text, r"[^0-9A-Za-z_]+"), token)


def literal_matches(text: Column | str, value: str) -> Column:
    """All occurrences of a literal string."""
    return F.regexp_extract_all(text, F.lit("\\Q" + value.replace("\\E", "\\E\\\\E\\Q") + "\\E"), 0)


def fenced_json(text: Column | str, schema: str) -> Column:
    """The JSON object in a reply that may wrap it in prose or fences; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


def package_name(policy_id: Column | str) -> Column:
    return F.lower(F.replace(policy_id, F.lit("-"), F.lit("_")))


def mapped(values: Mapping[str, object], key: Column, default: object = None) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def passes_threshold(label: Column, score: Column, thresholds: Mapping[str, float], default: float) -> Column:
    return score >= mapped(thresholds, label, default)


def capacity_bytes(rows_per_day: Column, bytes_per_row: Column, days: Column, replicas: Column) -> Column:
    """Disk to plan for, with 30 % to spare."""
    return rows_per_day * bytes_per_row * days * replicas * F.lit(1.3)


def ratio(a: Column, b: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(a, b), digits)
