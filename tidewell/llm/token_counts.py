"""Token counts by section: whole documents are encoded once, token character spans meet section spans, boundary-crossing tokens follow a rule.

Sections are consecutive character spans that cover the text (by default its lines, each with its newline). A token's span
is known from the lengths of its bytes: the characters of which it holds a byte, so that tokens which share a character's
bytes both span it. Rules for a token that crosses boundaries: ``start`` (where it begins), ``end`` (where it ends),
``majority`` (most characters, the earlier section on ties), ``split`` (shared by characters).

Defined cases: null or empty texts have one empty section of no tokens; an empty section has no tokens; repeated rows and
ids give rows of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import encode, encoding, rank_file
from .common import table

RULES = ("start", "end", "majority", "split")


def lines(text: str) -> np.ndarray:
    """Ends of a text's lines in characters."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def character_spans(text: str, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends, in characters, of tokens of these widths in bytes."""
    b = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(widths)
    if len(b) == len(text):
        return ends - widths, ends
    begun = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])  # characters that begin before each byte
    begins = ends - widths
    return begun[np.minimum(begins + 1, len(b))] - 1, begun[ends]


def allocated(begins: np.ndarray, ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section under the rule, and tokens of each section that cross one of its boundaries; all in characters."""
    n = len(section_ends)
    first = np.searchsorted(section_ends, begins, "right")
    last = np.searchsorted(section_ends, ends, "left")
    cross = np.flatnonzero(last > first)
    single = np.bincount(first[last <= first], minlength=n).astype(float)
    crossing = np.zeros(n, np.int64)
    starts = np.concatenate([[0], section_ends[:-1]])
    for t in cross.tolist():
        s = np.arange(first[t], last[t] + 1)
        inside = np.minimum(section_ends[s], ends[t]) - np.maximum(starts[s], begins[t])
        crossing[s[inside > 0]] += 1
        if rule == "split":
            single[s] += inside / inside.sum()
        else:
            single[{"start": s[0], "end": s[-1], "majority": s[int(np.argmax(inside))]}[rule]] += 1
    return single, crossing


def counted(docs: DataFrame, ranks: bytes, pattern: str, rule: str = "majority", sections: Callable[[str], np.ndarray] = lines, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, start_char, end_char, n_tokens double, n_crossing): a row per section, a narrow map."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, pattern)
        width = np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                take, out = [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    text = text or ""
                    chars = sections(text)
                    begins, ends = character_spans(text, width[encode(enc, text)] if text else np.zeros(0, np.int64))
                    tokens, crossing = allocated(begins, ends, chars, rule)
                    take += [row] * len(chars)
                    out.append((np.arange(len(chars)), np.concatenate([[0], chars[:-1]]), chars, tokens, crossing))
                if out:
                    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "section", "a", "z", "n", "x"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, section int, start_char long, end_char long, n_tokens double, n_crossing long")


def op5_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents"), *rank_file("byte_bpe_50k.tiktoken"))
