"""The public 64-bit city hash of whole numbers, alone or chained with others, as Column arithmetic.

A number's hash mixes its 64 bits; a chain folds each next number's hash into the one before. Hashes are the unsigned 64 bits
in a signed long; ``unsigned_mod`` takes remainders of the unsigned value. Nulls give null."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The hash's constants.
SALT = 0x4CF2D2BAAE6DA887
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53
FOLD = 0x9DDFEA08EB382D69

#: Steps as (kind, operand): xor with a constant or, without one, with the next number's hash; xor with itself shifted; product.
NUMBER = (("xor", SALT), ("shift", 33), ("times", MIX_1), ("shift", 33), ("times", MIX_2), ("shift", 33))
CHAIN = (("xor", None), ("times", FOLD), ("shift", 47), ("xor", None), ("times", FOLD), ("shift", 47), ("times", FOLD))

_LOW = 0xFFFFFFFF


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def times(x: Column, c: int) -> Column:
    """x * c modulo 2^64: partial products of 32 by 16 bits, which a long always holds."""
    c0, c1, c2, c3 = (c >> s & 0xFFFF for s in (0, 16, 32, 48))
    low, high = x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32)
    upper = lambda p: F.shiftleft(p.bitwiseAND(F.lit(0xFFFF)), 16)
    first, second = low * F.lit(c0), low * F.lit(c1)
    word = first.bitwiseAND(F.lit(_LOW)) + upper(second)
    rest = F.shiftrightunsigned(first, 32) + F.shiftrightunsigned(second, 16) + F.shiftrightunsigned(word, 32)
    rest = rest + low * F.lit(c2) + upper(low * F.lit(c3)) + high * F.lit(c0) + upper(high * F.lit(c1))
    return F.shiftleft(rest, 32).bitwiseOR(word.bitwiseAND(F.lit(_LOW)))


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[Callable[[Column, int], Column]]:
    """A product that wraps, for frames made inside: their arithmetic is bound to the mode that holds when they are made, and the session's own comes back."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield lambda x, c: x * F.lit(_signed(c))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _step(h: Column, kind: str, operand: int | None, other: int | None, product: Callable[[Column, int], Column] = times) -> Column:
    if kind == "shift":
        return h.bitwiseXOR(F.shiftrightunsigned(h, operand))
    if kind == "times":
        return product(h, operand)
    return h.bitwiseXOR(F.lit(_signed(other if operand is None else operand)))


def plain(*xs: int) -> int:
    """The unsigned hash of Python numbers."""
    out = None
    for x in xs:
        h = x % (1 << 64)
        for kind, c in NUMBER:
            h = h ^ c if kind == "xor" else h ^ h >> c if kind == "shift" else h * c % (1 << 64)
        if out is not None:
            for kind, c in CHAIN:
                out = out ^ (h if c is None else c) if kind == "xor" else out ^ out >> c if kind == "shift" else out * c % (1 << 64)
        out = h if out is None else out
    return out


def number_hash(x: Column | str) -> Column:
    """The hash of one whole number, as one expression."""
    h = (F.col(x) if isinstance(x, str) else x).cast("long")
    for kind, c in NUMBER:
        h = _step(h, kind, c, None)
    return h


def with_hashes(df: DataFrame, number: str, **seeds: int | None) -> DataFrame:
    """A column a keyword: the hash of ``number`` chained with the seed, or alone for None. A projection a step, so that no step is computed twice."""
    df = df.withColumn("_city", F.col(number).cast("long"))
    chained = {name: plain(seed) for name, seed in seeds.items() if seed is not None}
    with wrapping(df.sparkSession) as product:
        for kind, c in NUMBER:
            df = df.withColumn("_city", _step(F.col("_city"), kind, c, None, product))
        df = df.withColumns({name: F.col("_city") for name in seeds}).drop("_city")
        for kind, c in CHAIN if chained else ():
            df = df.withColumns({name: _step(F.col(name), kind, c, other, product) for name, other in chained.items()})
    return df


def unsigned_mod(h: Column | str, m: int) -> Column:
    """The remainder of the unsigned value; m below 2^61."""
    h = F.col(h) if isinstance(h, str) else h
    return (F.shiftrightunsigned(h, 1) % F.lit(m) * F.lit(2) + h.bitwiseAND(F.lit(1))) % F.lit(m)


def hash_sql(rows: str, number: str, seeds: tuple[int, ...] = ()) -> str:
    """DuckDB rows of ``rows`` with h, the unsigned hash of the number; for seeds, a row and ``seed`` each."""

    def mixed(q: str, col: str, steps: tuple) -> str:
        for kind, c in steps:
            x = {"xor": f"xor({col}, {'g' if c is None else f'{c}::UBIGINT'})", "shift": f"xor({col}, {col} >> {c})", "times": f"(({col}::UHUGEINT * {c}::UHUGEINT) % {1 << 64}::UHUGEINT)::UBIGINT"}[kind]
            q = f"SELECT * REPLACE ({x} AS {col}) FROM ({q})"
        return q

    q = mixed(f"SELECT *, ({number})::UBIGINT AS h FROM ({rows})", "h", NUMBER)
    if seeds:
        listed = mixed(f"SELECT seed, seed::UBIGINT AS g FROM (SELECT unnest([{', '.join(map(str, seeds))}]) AS seed)", "g", NUMBER)
        q = mixed(f"SELECT a.*, b.* FROM ({q}) a CROSS JOIN ({listed}) b", "h", CHAIN)
    return q
