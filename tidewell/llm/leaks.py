"""Benchmark decontamination by latent semantic retrieval.

The corpus is read as overlapping passages of 2 * HALF plain words. One pass counts the passages that hold each word of the
benchmark's vocabulary; words of over STOP of all passages are stop words (but an item keeps its rarest words if too few are
left). A randomised SVD of the TF-IDF matrix A takes a second pass: each task adds A'(A Omega) for its passages, and the sums
give the leading right singular vectors (Nystroem form). In a third pass every passage is compared by cosine in the latent
space with every benchmark item, and candidates are checked where they are found: the longest common subsequence of words and
the share of the item's answer, in places of at most twice the item's words.

The gate of the cosine is far below what an accepted pair has as a rule (the README gives the recall measured); each candidate's
surroundings are bounded by signatures of their words before any subsequence is computed. Since no cosine of a fixed rank is low
enough for all that the check accepts, ``Rule(exact=True)`` also takes the places that hold as many of an item's rarest words as
any accepted match must (Demand), at any cosine.

The benchmark is the stated query set: its texts go to every task in blocks of at most BLOCK_ITEMS items, and its words span
the matrix. A benchmark of over MOST_WORDS distinct words is searched in several turns, each with a matrix of its own.

Defined cases: null or wordless texts and items match nothing; items of under SHORT words match only when whole; repeated
rows and ids give a row each; ids are of any type, null ones included; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import table
from .words import PLAIN, slices, word_hashes

U64 = np.uint64
HALF, SHORT, PIECE = 16, 8, 64
STOP, LEAST_WORDS = 0.005, 5
BLOCK_ITEMS, MOST_WORDS = 20_000, 100_000


@dataclass(frozen=True)
class Rule:
    """Least cosine of a candidate; least share of the item in common order; the lower share that does if the answer is there; least share of the answer; share of the passages from which on a word is a stop word of the retrieval (1: none is); words of a place, in times the item's; whether places that hold enough of an item's rarest words are candidates too, at any cosine, so that no accepted pair can be lost."""

    cosine: float = 0.3
    common: float = 0.7
    with_answer: float = 0.6
    answer: float = 0.8
    stop: float = STOP
    span: int = 2
    exact: bool = False

    def least(self, n: int) -> int:
        """Words that a match of an item of n words has in common with it at least."""
        return n if n < SHORT else math.ceil(min(self.common, self.with_answer) * n - 1e-9)


def plain_words(text: str | None) -> np.ndarray:
    b = np.frombuffer((text or "").encode(), np.uint8)
    return word_hashes(b, np.array([0, len(b)]), PLAIN)[0]


class Vocabulary:
    def __init__(self, words: np.ndarray):
        self.words = np.unique(words)
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.words & U64((1 << 20) - 1)).astype(np.int64)] = True

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known words in h, and their ids."""
        maybe = np.flatnonzero(self.near[(h & U64((1 << 20) - 1)).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        x = np.minimum(np.searchsorted(self.words, h[maybe]), len(self.words) - 1)
        hit = self.words[x] == h[maybe]
        return maybe[hit], x[hit]


def halves(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half passages: the index of each document's first one (and the total), from the bounds of its words; a document of words has at least two."""
    n = np.diff(at)
    return np.concatenate([[0], np.cumsum(np.where(n > 0, np.maximum(2, -(-n // HALF)), 0))]), n


def half_of(places: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    doc = np.searchsorted(at, places, "right") - 1
    return first[doc] + (places - at[doc]) // HALF


def summed(values: np.ndarray, index: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    """Sums of values[index] by target index; the rows are gathered once, in the targets' order."""
    out = np.zeros((size, values.shape[1]), values.dtype)
    if len(to):
        if (to[1:] < to[:-1]).any():
            order = np.argsort(to, kind="stable")
            to, index = to[order], index[order]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        out[to[first]] = np.add.reduceat(values[index], first, axis=0)
    return out


class Demand:
    """The rarest words of each item, and how many places of a match they fill at least: a match lacks at most n - least(n) of the item's n words."""

    def __init__(self, items: list[np.ndarray], vocabulary: Vocabulary, df: np.ndarray, most: float, rule: Rule):
        words, owners, least = [], [], []
        for k, own in enumerate(items):
            ids = vocabulary.ids(own)[1]
            ids = ids[np.lexsort((ids, df[ids]))]
            lacking = len(own) - rule.least(len(own))
            size = min(len(own), max(lacking + LEAST_WORDS, int((df[ids] <= most).sum())))
            words.append(np.unique(ids[:size]))
            owners.append(np.full(len(words[-1]), k))
            least.append(size - lacking)
        word, owner = np.concatenate(words), np.concatenate(owners)
        self.owner = owner[np.argsort(word, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(vocabulary.words)))])
        self.least, self.span = np.array(least), np.array([rule.span * len(own) for own in items])

    def met(self, place: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, items and first places of the spans of twice an item that hold enough of its rarest words."""
        n = self.first[ids + 1] - self.first[ids]
        some = np.flatnonzero(n)
        n, size = n[some], max(1, int(at[-1]))
        code = self.owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[ids[some]], n)] * size + np.repeat(place[some], n)
        code.sort()
        item = code // size
        last = np.arange(len(code)) + self.least[item] - 1
        x = np.flatnonzero(last < len(code))
        x = x[(item[last[x]] == item[x]) & (code[last[x]] - code[x] < self.span[item[x]])]
        begin = code[x] % size
        doc = np.searchsorted(at, begin, "right") - 1
        same = code[last[x]] % size < at[doc + 1]
        return doc[same], item[x][same], begin[same]


class Bound:
    """How many words an item can have in common with the surroundings of a passage at most: known words set bits of their half passage, and each bit of the item that the surroundings lack is a word that they lack."""

    LANES, FAR = 8, 32  # 64-bit lanes of a signature; halves around a passage up to which it is asked

    def __init__(self, items: list[np.ndarray], vocabulary: Vocabulary, rule: Rule):
        self.size = np.array([len(own) for own in items])
        self.least = np.array([rule.least(n) for n in self.size.tolist()])
        self.reach = -(-self.size // HALF)
        self.bits = self.set(np.repeat(np.arange(len(items)), self.size), np.concatenate([vocabulary.ids(own)[1] for own in items]), len(items))
        self.own = np.bitwise_count(self.bits).sum(1, dtype=np.int64)

    def set(self, row: np.ndarray, ids: np.ndarray, rows: int) -> np.ndarray:
        bit = (ids.astype(U64) * U64(0x9E3779B97F4A7C15) >> U64(55)).astype(np.int64)  # 512 of them
        out = np.zeros((rows, self.LANES), U64)
        for begin in range(0, rows, 65_536):  # rows ascend
            a, z = np.searchsorted(row, [begin, begin + 65_536])
            flags = np.zeros((min(65_536, rows - begin), self.LANES * 64), bool)
            flags[row[a:z] - begin, bit[a:z]] = True
            out[begin:begin + 65_536] = np.packbits(flags, axis=1, bitorder="little").view(U64)
        return out

    def possible(self, halves_: np.ndarray, passage: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Of the candidates (passage, item) those whose surroundings may hold enough of the item's words; halves_ are the signatures of all half passages of a slice."""
        out = np.ones(len(passage), bool)
        reach, around, to = self.reach[item], halves_.copy(), 0
        around[:-1] |= halves_[1:]
        for r in np.unique(reach[reach <= self.FAR]).tolist():
            while to < r:
                to += 1
                around[to:] |= halves_[:-to]
                around[:-to - 1] |= halves_[to + 1:]
            own = np.flatnonzero(reach == r)
            k = item[own]
            met = np.bitwise_count(around[passage[own]] & self.bits[k]).sum(1, dtype=np.int64)
            out[own] = self.size[k] - (self.own[k] - met) >= self.least[k]
        return out


def passage_counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """Half passages that hold each word, and their number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    m = len(vocabulary.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, df, passages = shared.value, np.zeros(m, np.int64), 0
        for batch in batches:
            for _, _, buf, offsets in slices(batch.column(0), 1 << 20):
                words, at = word_hashes(buf, offsets, PLAIN)
                first, _ = halves(at)
                passages += int(first[-1])
                place, ids = vocabulary.ids(words)
                if len(place):
                    df += np.bincount(np.unique(half_of(place, at, first) * m + ids) % m, minlength=m)
        known = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *known.tolist()], pa.int32()), pa.array([passages, *df[known].tolist()], pa.int64())], ["i", "n"])

    found = {r["i"]: r["n"] for r in docs.select("text").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}  # a row per word of the vocabulary
    df = np.zeros(m)
    for i, n in found.items():
        if i >= 0:
            df[i] = n
    return df, max(1, found.get(-1, 1))


def latent(docs: DataFrame, vocabulary: Vocabulary, items: list[np.ndarray], rank: int = 128, more: int = 16, seed: int = 7, counts: tuple[np.ndarray, int] | None = None, stop: float = STOP) -> np.ndarray:
    """Projection (words x rank: idf times right singular vectors) of TF-IDF passages, by a randomised SVD."""
    spark = docs.sparkSession
    m = len(vocabulary.words)
    df, passages = counts or passage_counts(docs, vocabulary)
    use = df <= stop * passages
    for words in items:
        ids = np.unique(vocabulary.ids(words)[1])
        if use[ids].sum() < LEAST_WORDS:
            use[ids[np.argsort(df[ids], kind="stable")[:2 * LEAST_WORDS]]] = True
    idf = np.where(use, np.log((passages + 1) / (df + 1)) + 0.1, 0)
    omega = np.random.default_rng(seed).standard_normal((m, rank + more))
    shared = spark.sparkContext.broadcast((vocabulary, (idf[:, None] * omega).astype(np.float32), use))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weighted, use = shared.value
        total = np.zeros(weighted.shape)
        for batch in batches:
            for _, _, buf, offsets in slices(batch.column(0), 1 << 20):
                words, at = word_hashes(buf, offsets, PLAIN)
                first, _ = halves(at)
                place, ids = vocabulary.ids(words)
                place, ids = place[use[ids]], ids[use[ids]]
                if not len(place):
                    continue
                half = half_of(place, at, first)
                y = summed(weighted, ids, half, int(first[-1]) + 2)
                # passage k is halves k and k + 1 of one document
                last = np.zeros(len(y), bool)
                last[first[1:][np.diff(first) > 0] - 1] = True
                p = y[:-1] + y[1:]
                p[last[:-1]] = 0
                p[1:] += p[:-1].copy()  # of each half, the two passages that it is in
                total += summed(p, half, ids, m)
        known = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(known, pa.int32()), pa.array([r.tobytes() for r in total[known]], pa.binary())], ["i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                held[i] = held[i] + np.frombuffer(v) if i in held else np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["i", "v"])

    z = np.zeros((m, rank + more))
    for r in docs.select("text").mapInArrow(run, "i int, v binary").repartition(32, "i").mapInArrow(add, "i int, v binary").toLocalIterator():  # a row per word of the vocabulary
        z[r["i"]] = np.frombuffer(r["v"])
    shared.unpersist()
    z *= idf[:, None]
    core = omega.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(values.max(), 1e-12) * 1e-7
    half = z @ (vectors[:, keep] / np.sqrt(values[keep])) if keep.any() else np.zeros((m, 1))
    u = np.linalg.svd(half, full_matrices=False)[0][:, :rank]
    return (idf[:, None] * u).astype(np.float32)


def common_subsequence(item: np.ndarray, passage: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    return _common(_masks(item.tolist()), len(item), passage.tolist())


def _masks(item: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def _common(masks: dict[int, int], n: int, passage: list[int]) -> int:
    full = (1 << n) - 1
    v = full
    for w in passage:
        if m := masks.get(w, 0):
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


def best_place(own: np.ndarray, answer: np.ndarray, near: np.ndarray, rule: Rule) -> tuple[bool, int, int]:
    """Of all places of at most ``span`` times the item within near: whether the rule accepts it, and the words in common with the item and with the answer."""
    n, least, best = len(own), rule.least(len(own)), (False, 0, 0)
    there = set(near.tolist())
    if sum(w in there for w in own.tolist()) < least:  # a bound of the common subsequence
        return best
    known = np.isin(near, own)
    seen = np.concatenate([[0], np.cumsum(known)])
    begin = np.flatnonzero(known)  # nothing is lost before a place's first word of the item
    most = seen[np.minimum(begin + rule.span * n, len(near))] - seen[begin]
    order = np.argsort(-most, kind="stable")
    masks, ends, listed = _masks(own.tolist()), _masks(answer.tolist()), near.tolist()
    for b, bound in zip(begin[order].tolist(), most[order].tolist(), strict=True):
        if bound < max(least, best[1]):
            break
        part = listed[b:b + rule.span * n]
        got = _common(masks, n, part)
        if got < max(least, best[1] if best[0] else 0):
            continue
        answers = _common(ends, len(answer), part)
        share = got / n
        fits = share >= (1 if n < SHORT else rule.common) or (n >= SHORT and share >= rule.with_answer and answers / max(1, len(answer)) >= rule.answer)
        best = max(best, (fits, got, answers))
        if best == (True, n, len(answer)):
            break
    return best


def leaked(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), rank: int = 128, answer_col: str | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, common_share, answer_share): pairs in which the document holds the item. Without an answer column the item's last six words stand for its answer."""
    items = [(r[0], plain_words(r[1]), plain_words(r[2]) if answer_col else plain_words(r[1])[-6:]) for r in benchmark.select("item_id", "text", *([answer_col] if answer_col else [])).toLocalIterator()]
    items = [x for x in items if len(x[1])]
    kinds = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("item_id", benchmark.schema["item_id"].dataType), *(StructField(c, DoubleType()) for c in ("cosine", "common_share", "answer_share"))])
    found = [_leaked(docs, turn, rule, rank, kinds) for turn in _turns(items)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], kinds)


def _turns(items: list) -> list[list]:
    """Runs of items of at most MOST_WORDS distinct words (an item alone may have more)."""
    out: list[list] = []
    seen: set[int] = set()
    for x in items:
        own = set(x[1].tolist())
        if not out or len(seen | own) > MOST_WORDS:
            out.append([])
            seen = set()
        out[-1].append(x)
        seen |= own
    return out


def _leaked(docs: DataFrame, items: list, rule: Rule, rank: int, kinds: StructType) -> DataFrame:
    vocabulary = Vocabulary(np.concatenate([x[1] for x in items]))
    counts = passage_counts(docs, vocabulary)
    project = latent(docs, vocabulary, [x[1] for x in items], rank, counts=counts, stop=rule.stop)
    blocks = [items[i:i + BLOCK_ITEMS] for i in range(0, len(items), BLOCK_ITEMS)]
    return reduce(DataFrame.unionByName, [_searched(docs, block, vocabulary, project, Demand([x[1] for x in block], vocabulary, counts[0], rule.stop * counts[1], rule) if rule.exact else None, rule, kinds) for block in blocks])


def _searched(docs: DataFrame, items: list, vocabulary: Vocabulary, project: np.ndarray, demand: Demand | None, rule: Rule, kinds: StructType) -> DataFrame:
    pieces = [(k, w[i:i + PIECE]) for k, (_, w, _) in enumerate(items) for i in range(0, len(w), PIECE)]
    q = np.stack([project[vocabulary.ids(w)[1]].sum(0) for _, w in pieces])
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    owner = np.array([k for k, _ in pieces])
    bound = Bound([own for _, own, _ in items], vocabulary, rule)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, project, q.astype(np.float32), owner, items, demand, bound))  # bounded by MOST_WORDS and BLOCK_ITEMS
    arrow = [to_arrow_type(f.dataType) for f in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, project, q, owner, items, demand, bound = shared.value
        use = project.any(1)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for i, _, buf, offsets in slices(batch.column(1), 1 << 20):
                words, at = word_hashes(buf, offsets, PLAIN)
                first, _ = halves(at)
                place, known = vocabulary.ids(words)
                if not len(place):
                    continue
                regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for d, item, g in zip(*(x.tolist() for x in demand.met(place, known, at)), strict=True) if demand else ():
                    n = rule.span * len(items[item][1])
                    regions.setdefault((d, item), []).append((g - n + 1 - int(at[d]), g + n - int(at[d])))
                half = half_of(place, at, first)
                signs = bound.set(half, known, int(first[-1]) + 1)
                known, half = known[use[known]], half[use[known]]
                y = summed(project, known, half, int(first[-1]) + 1)
                p = y[:-1] + y[1:]
                p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
                for b in range(0, len(p), 8192):
                    c = p[b:b + 8192] @ q.T
                    x, k = np.nonzero(c >= rule.cosine)
                    x, item = x + b, owner[k]
                    good = bound.possible(signs, x, item)
                    x, item = x[good], item[good]
                    doc = np.searchsorted(first, x, "right") - 1
                    for w, d, item in zip(x.tolist(), doc.tolist(), item.tolist(), strict=True):
                        if w + 1 < first[d + 1]:
                            n, h = len(items[item][1]), (w - int(first[d])) * HALF
                            regions.setdefault((d, item), []).append((h - n, h + 2 * HALF + n))
                for (d, item), found in regions.items():
                    _, own, answer = items[item]
                    text = words[at[d]:at[d + 1]]
                    best, joined = (False, 0, 0), []
                    for a, z in sorted(found):
                        if joined and a <= joined[-1][1]:
                            joined[-1][1] = max(z, joined[-1][1])
                        else:
                            joined.append([a, z])
                    for a, z in joined:
                        best = max(best, best_place(own, answer, text[max(0, a):z], rule))
                    if best[0]:
                        cosine = float((p[first[d]:first[d + 1] - 1] @ q[owner == item].T).max())
                        out.append((ids[i + d], items[item][0], cosine, best[1] / len(own), best[2] / max(1, len(answer))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), arrow, strict=True)], ["doc_id", "item_id", "cosine", "common_share", "answer_share"])

    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def op8_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
