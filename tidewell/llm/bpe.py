"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut before encoding at safe boundaries: where a space or newline follows a character that isn't white
space. No match of the pattern spans such a place and none looks back over it, so the ids equal those of the whole text.

Defined cases: null texts count as empty (no tokens), texts without any safe boundary stay whole, repeated ids and rows
give a row each, other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

CUT = regex.compile(r"(?<=\S)(?<![\x1c-\x1f])[ \n]")
PIECE = 32_768


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """Parts of a text of about ``most`` characters, cut at safe boundaries only."""
    begin = 0
    while len(text) - begin > most and (m := CUT.search(text, begin + most)):
        yield text[begin:m.start()]
        begin = m.start()
    yield text[begin:]


def encode(enc, text: str, most: int = PIECE) -> list[int]:
    if len(text) <= most:
        return enc.encode_ordinary(text)
    return [i for part in pieces(text, most) for i in enc.encode_ordinary(part)]


def tokenized(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, ids array<int>, decoded binary) or, with ``digests``, (id, n_tokens, ids_sha256, decoded_sha256) without shipping the ids. A narrow map; no shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # the size of the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                for text in part.column(1):
                    ids = encode(enc, text.as_py() or "")
                    raw = enc.decode_bytes(ids)
                    out.append((len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()) if digests else (ids, raw))
                kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["id", *"abc"[:len(kinds)]])

    kind = docs.schema[id_col].dataType.simpleString()
    names = ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {names}")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"), *rank_file(), digests=True)
