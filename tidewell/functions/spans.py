"""Spans in text: regex matches with offsets, greedy overlap rules, chunkers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def barrier(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns behind a generator, so that expressions which use them several times don't compute them several times."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once for each row, however often and deep inside lambdas it is used."""
    return F.transform(F.array(value), use)[0]


#: Spans that one fold copies with each step; longer arrays go in blocks of so many.
BLOCK = 128


def located(parts: Column, hits: Column) -> Column:
    """array<struct<start, end, value, byte_start, byte_end>> from a text split at its matches and the matches themselves, in characters and UTF-8 bytes. Blocks of matches begin where the lengths before them end, so that the work is about linear."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,byte_start:int,byte_end:int>>")
    pairs = F.arrays_zip(F.slice(parts, 1, F.greatest(F.size(hits), F.lit(1))).alias("gap"), hits.alias("hit"))

    def place(chars: Column, octets: Column) -> Column:
        return F.struct(chars.alias("at"), octets.alias("byte"))

    def step(acc: Column, x: Column) -> Column:
        start, byte = acc["at"] + F.char_length(x["gap"]), acc["byte"] + F.octet_length(x["gap"])
        end, byte_end = start + F.char_length(x["hit"]), byte + F.octet_length(x["hit"])
        own = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"), byte.alias("byte_start"), byte_end.alias("byte_end"))
        return F.struct(end.alias("at"), byte_end.alias("byte"), F.concat(acc["out"], F.array(own)).alias("out"))

    def block(own: Column, at: Column) -> Column:
        return F.aggregate(own, F.struct(at["at"].alias("at"), at["byte"].alias("byte"), none.alias("out")), step, lambda a: a["out"])

    def long(own: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda i: F.slice(own, i * BLOCK + 1, F.lit(BLOCK)))
        return bound(cut, begun)

    def begun(cut: Column) -> Column:
        sizes = F.transform(cut, lambda c: F.aggregate(c, place(F.lit(0), F.lit(0)), lambda n, x: place(n["at"] + F.char_length(x["gap"]) + F.char_length(x["hit"]), n["byte"] + F.octet_length(x["gap"]) + F.octet_length(x["hit"]))))
        starts = F.aggregate(sizes, F.array(place(F.lit(0), F.lit(0))), lambda acc, n: F.concat(acc, F.array(place(F.element_at(acc, -1)["at"] + n["at"], F.element_at(acc, -1)["byte"] + n["byte"]))))
        return F.flatten(F.transform(F.arrays_zip(cut.alias("c"), F.slice(starts, 1, F.size(cut)).alias("at")), lambda x: block(x["c"], x["at"])))

    return F.when(F.size(hits) > BLOCK, bound(pairs, long)).when(F.size(hits) > 0, block(pairs, place(F.lit(0), F.lit(0)))).otherwise(none)


def matches(text: Column | str, patterns: Iterable[tuple[str, str | None]], margin: int = 0) -> Column:
    """array<struct<i, start, end, value, around>>: matches of each pattern, number ``i``, in its order and then by place, in characters. Each pattern comes with the characters (a class's inside) that a match begins with, or None: only such places are tried, and each text is decoded once for all patterns. ``around`` is the value with ``margin`` characters on both sides; where fewer lie before it, more after it. Boundaries and classes are those of ASCII. Null text: none."""
    runs = [p if first is None else f"[{first}](?<=(?=({p})).)" for p, first in patterns]
    whole = [first is None for _, first in patterns]

    @F.arrow_udf("array<struct<i:int,start:int,end:int,value:string,around:string>>")
    def run(texts: pa.Array) -> pa.Array:
        found = [re.compile(r, re.ASCII | re.DOTALL) for r in runs]
        bounds, rows = [0], ([], [], [], [], [])
        for raw in texts.cast(pa.large_binary()):
            t = (raw.as_py() or b"").decode("utf-8", "replace")
            for i, r in enumerate(found):
                last = 0
                for m in r.finditer(t):
                    a, z = m.span() if whole[i] else m.span(1)
                    if a >= last:  # places inside a match don't begin another
                        last = z
                        for c, x in zip(rows, (i, a, z, t[a:z], t[max(a - margin, 0):max(a - margin, 0) + z - a + 2 * margin]), strict=True):
                            c.append(x)
            bounds.append(len(rows[0]))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["i", "start", "end", "value", "around"]))

    return run(text)


def overlaps(a: Column, b: Column) -> Column:
    """Half-open spans share a place; touching ones don't."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def accepted(candidates: Column, kind: str) -> Column:
    """Greedy fold in the array's order: a span that overlaps an accepted one goes, and nothing is looked for again. Long arrays go in blocks: the accepted spans lie sorted by place, where a search by halves finds the only one that a candidate can overlap. An order given as an expression is computed once, not with each block."""
    return bound(candidates, lambda c: _accepted(c, kind))


def _accepted(candidates: Column, kind: str) -> Column:
    def fold(spans: Column, kind: str) -> Column:
        return F.aggregate(spans, F.array().cast(f"array<{kind}>"), lambda acc, x: F.when(F.exists(acc, lambda y: overlaps(x, y)), acc).otherwise(F.concat(acc, F.array(x))))

    place = "struct<start:int,end:int,i:int>"

    def meets(kept: Column, x: Column) -> Column:
        """Whether the last kept span that begins before x's end reaches beyond x's start."""
        steps = F.array(*[F.lit(1 << k) for k in range(27, -1, -1)])
        last = F.aggregate(steps, F.lit(0), lambda at, n: F.when((at + n <= F.size(kept)) & (F.get(kept, at + n - 1)["start"] < x["end"]), at + n).otherwise(at))
        return F.coalesce(F.get(kept, last - 1)["end"] > x["start"], F.lit(False))

    def step(kept: Column, i: Column) -> Column:
        own = F.transform(F.slice(candidates, i * BLOCK + 1, F.lit(BLOCK)), lambda x, j: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), (i * BLOCK + j).alias("i")))
        return F.array_sort(F.concat(kept, fold(F.filter(own, lambda x: ~meets(kept, x)), place)))

    kept = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(candidates) - 1) / BLOCK).cast("int")), F.array().cast(f"array<{place}>"), step)
    long = F.transform(F.array_sort(F.transform(kept, lambda x: x["i"])), lambda i: F.get(candidates, i))
    return F.when(F.size(candidates) > BLOCK, long).otherwise(fold(candidates, kind))


def by_score_then_length(spans: Column) -> Column:
    """Highest score first, longer first on ties."""
    def order(a: Column, b: Column) -> Column:
        la, lb = a["end"] - a["start"], b["end"] - b["start"]
        return F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(la > lb, -1).when(la < lb, 1).otherwise(F.lit(0))

    return F.array_sort(spans, order)


def _stable(spans: Column, value) -> Column:
    """Sorted by a descending value, equal ones in their old order."""
    indexed = F.transform(spans, lambda x, i: F.struct(i.alias("i"), x.alias("x")))

    def order(a: Column, b: Column) -> Column:
        u, v = value(a["x"]), value(b["x"])
        return F.when(u > v, -1).when(u < v, 1).when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(F.lit(0))

    return F.transform(F.array_sort(indexed, order), lambda p: p["x"])


def by_score_stable(spans: Column) -> Column:
    return _stable(spans, lambda x: x["score"])


def by_length_stable(spans: Column) -> Column:
    return _stable(spans, lambda x: x["end"] - x["start"])


def by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(F.lit(0)))


def _pieces(text: str, most: int, marks: str, past: float) -> np.ndarray:
    """Bounds, in characters, of pieces of at most ``most`` UTF-8 bytes. A piece ends after its last mark, if that lies past the given share of the piece, else where the bytes run out."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = np.concatenate([[0], np.cumsum(1 + sum((code >= c).astype(np.int64) for c in (0x80, 0x800, 0x10000)))])
    after = np.flatnonzero(np.isin(code, [ord(c) for c in marks])) + 1
    bounds = [0]
    while bounds[-1] < len(code):
        a = bounds[-1]
        full = max(int(np.searchsorted(size, size[a] + most, "right")) - 1, a + 1)
        mark = int(after[np.searchsorted(after, full, "right") - 1]) if len(after) and after[0] <= full else 0
        usable = full < len(code) and mark - 1 > a + int((full - a) * past)
        bounds.append(mark if usable else full)
    return np.array(bounds)


def cut_small(text: str, most: int = 1024) -> list[str]:
    """Pieces of at most ``most`` bytes, cut after the last newline or space of a piece if there is one."""
    bounds = _pieces(text, most, "\n ", 0).tolist()
    return [text[a:z] for a, z in zip(bounds, bounds[1:], strict=False)]


def cut_large(text: str, most: int = 2048) -> list[tuple[int, str]]:
    """(character offset, piece) of at most ``most`` bytes, cut at white space only past a piece's middle."""
    bounds = _pieces(text, most, " \n\t", 0.5).tolist()
    return [(a, text[a:z]) for a, z in zip(bounds, bounds[1:], strict=False)]


def small_chunks(text: Column | str, most: int = 1024) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: cut_small(t or "", most))

    return run(text)


def large_chunks(text: Column | str, most: int = 2048) -> Column:
    @F.pandas_udf("array<struct<offset:int,byte_offset:int,chunk:string>>")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            at, out = 0, []
            for offset, chunk in cut_large(t or "", most):
                out.append({"offset": offset, "byte_offset": at, "chunk": chunk})
                at += len(chunk.encode())
            return out

        return s.map(one)

    return run(text)


def rebased(findings: Column, offset: Column, byte_offset: Column) -> Column:
    """Chunk offsets moved to the whole text's, in characters and in bytes."""
    return F.transform(findings, lambda f: f.withField("start", f["start"] + offset).withField("end", f["end"] + offset).withField("byte_start", f["byte_start"] + byte_offset).withField("byte_end", f["byte_end"] + byte_offset))


def refound(text: Column, span: Column) -> Column:
    """The span if its value stands there, else moved to the value's first occurrence, else null."""
    here = F.substring(text, span["start"] + 1, F.char_length(span["value"])) == span["value"]
    at = F.instr(text, span["value"]) - 1
    return F.when(here, span).when(at >= 0, span.withField("start", at).withField("end", at + F.char_length(span["value"])))
