"""Thousands of literal values found in texts in one pass over each text (an Aho-Corasick automaton)."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import accepted, barrier, by_length_stable, by_start

PART_CHARS = 8 << 20  # characters of the values of one automaton: about a gigabyte of a worker at most
SPAN = "struct<label:string,start:int,end:int,value:string>"


@functools.lru_cache(maxsize=1)
def _automaton(values: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for v in values:
        out.add_word(v, len(v))
    out.make_automaton()
    return out


def occurrences(automaton, text: str) -> list[tuple[int, int]]:
    """(start, end) of every occurrence of every value; of one value's those that don't overlap the one before."""
    free: dict[str, int] = {}
    out = []
    for last, size in automaton.iter(text):
        start, end = last + 1 - size, last + 1
        value = text[start:end]
        if start >= free.get(value, 0):
            free[value] = end
            out.append((start, end))
    return out


def found(texts: DataFrame, values: DataFrame, key: str, text: str = "text", value: str = "value", part_chars: int = PART_CHARS) -> DataFrame:
    """(key, start, end, value): every occurrence of every distinct value that isn't blank, in characters. The values are counted first: up to ``part_chars`` characters of them make one automaton, which goes to every worker; more are dealt by hash into so many parts that each is below that, and the texts are read once for each part. Texts without an occurrence, and null ones, have no row."""
    named = values.where(F.trim(F.regexp_replace(value, r"\s", "")) != "").select(F.col(value).alias("v")).distinct()
    chars = named.agg(F.sum(F.char_length("v")).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(chars * 1.25 / part_chars)) if chars > part_chars else 1
    if parts > 1:
        named = named.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts))).persist()
    kind = texts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start int, end int, value string"
    out = None
    for i in range(parts):
        own = tuple(sorted(r["v"] for r in (named.where(F.col("part") == i) if parts > 1 else named).select("v").collect()))  # below part_chars
        got = _in_texts(texts, own, key, text, schema) if own else texts.sparkSession.createDataFrame([], schema)
        out = got if out is None else out.unionByName(got)
    named.unpersist()
    return out


def _in_texts(texts: DataFrame, own: tuple[str, ...], key: str, text: str, schema: str) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value)
        for batch in batches:
            at, starts, ends, said = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for start, end in occurrences(automaton, t) if t else ():
                    at.append(i)
                    starts.append(start)
                    ends.append(end)
                    said.append(t[start:end])
                if len(at) > 100_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(said, pa.string())], ["k", "s", "e", "v"])
                    at, starts, ends, said = [], [], [], []

    return texts.select(key, text).mapInArrow(run, schema)


def longest_first(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end, value): of one text's spans the longest first, by place where they are of a length, and none that shares a place with one taken before."""
    each = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("_all"))
    step = barrier(each, _long=by_length_stable(F.col("_all")))
    kept: Column = accepted(F.col("_long"), "struct<start:int,end:int,value:string>")
    return barrier(step, _kept=kept).select(key, F.inline(by_start(F.col("_kept"))))
