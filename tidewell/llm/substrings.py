"""Repeated-substring removal by longest-previous-factor arrays over truncated suffix orders.

A byte goes if it lies in a string of ``length`` bytes that also starts elsewhere (or, keeping the first copy, starts
earlier). For every place of a text the longest factor that also starts elsewhere, and the longest that starts earlier, is
computed up to ``length`` bytes, if it has at least ``least``. One global suffix array is not needed: each window of
``least`` bytes is assigned to its smallest 64-byte gram, so equal windows meet in one part, and only windows whose gram
occurs twice leave their document.

1. texts become classes (equal texts); a copy of at least ``length`` bytes is covered as a whole;
2. window-minimum grams are counted in one message shuffle;
3. slices around shared grams go to the gram's part (equal slices of a batch as one) with ``length`` bytes after each start;
4. there the starts are put in suffix order with their common prefixes; the neighbours in that order give the longest match
   anywhere, the previous and next smaller position in it the longest previous factor;
5. spans return to the documents.

Defined cases: null texts count as empty; texts under ``least`` bytes match nothing, texts under ``length`` bytes lose
nothing; repeated rows (equal ids and texts) are copies like any others, save that keeping the first keeps all rows of the
smallest id; rows with a null id come after all ids; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions_for, saved, spread_keys, table
from .messages import SCHEMA, dealt, gathered, shared
from .words import fmix, slices

U64 = np.uint64
GRAM = 64
FINE = 8  # a part's slices are ordered in so many turns
HOT_SHARE = 1000  # a class of over one in so many rows is hot; there are fewer of them than that
_P = U64(0x9E3779B97F4A7C15)
_LOW = (1 << 24) - 1
_PAD = 0xFF  # no byte of UTF-8
_LAST = (1 << 63) - 1


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Fingerprints of all GRAM-byte strings, by doubling."""
    h, p, n = b.astype(U64) + U64(1), _P, 1
    while n < GRAM:
        h = h[:-n] * p + h[n:]
        with np.errstate(over="ignore"):
            p = p * p
        n *= 2
    return fmix(h)


def window_runs(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share their smallest gram (the rightmost on ties): 40-bit grams, first and last start."""
    none = np.zeros(0, np.int64)
    if len(b) < length:
        return none.astype(U64), none, none
    h = gram_hashes(b)
    h &= U64(~_LOW & 0xFFFFFFFFFFFFFFFF)
    h |= U64(_LOW) - (np.arange(len(h), dtype=U64) & U64(_LOW))
    w = length - GRAM + 1
    n = len(h) - w + 1
    padded = np.full(-(-len(h) // w) * w, U64(0xFFFFFFFFFFFFFFFF))
    padded[:len(h)] = h
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:n], ahead[w - 1:w - 1 + n])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return low[first] >> U64(24), first, np.append(first[1:], n) - 1


def _eights(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number."""
    v = np.zeros(max(0, len(b) - 7), U64)
    for j in range(8):
        v = (v << U64(8)) | b[j:len(b) - 7 + j].astype(U64)
    return v


def _steps(a: int, z: int, by: int) -> list[int]:
    """Places from which strings of ``by`` bytes cover the bytes a..z."""
    return [*range(a, z - by, by), z - by] if z > a else []


def _common(v: np.ndarray, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the strings at p and at q, up to ``most``."""
    out, open_ = np.zeros(len(p), np.int64), np.arange(len(p))
    for at in range(0, most, 8):
        x = v[p[open_] + at] ^ v[q[open_] + at]
        same = x == 0
        apart = open_[~same]
        bits = np.zeros(len(apart), np.int64)
        y = x[~same]
        for shift in (32, 16, 8):
            low = (y >> U64(64 - shift)) == 0
            bits += np.where(low, shift, 0)
            y = np.where(low, y << U64(shift), y)
        out[apart] = at + bits // 8
        open_ = open_[same]
    out[open_] = most
    return np.minimum(out, most)


def _nearest_smaller(t: np.ndarray, lcp: np.ndarray, widest: int) -> np.ndarray:
    """Common prefix with the nearest element before each one whose t is smaller (0: none). lcp[i] is that of i - 1 and i."""
    lows, prefixes, size = [t], [lcp], 1
    while 2 * size <= widest:  # minima over the last 2, 4, 8.. elements
        low, pre = lows[-1].copy(), prefixes[-1].copy()
        low[size:] = np.minimum(low[size:], lows[-1][:-size])
        pre[size:] = np.minimum(pre[size:], prefixes[-1][:-size])
        lows.append(low)
        prefixes.append(pre)
        size *= 2
    at, m = np.arange(len(t)) - 1, lcp.copy()
    for low, pre in zip(reversed(lows), reversed(prefixes), strict=True):
        go = (at - size + 1 >= 0) & (m > 0)
        go[go] = low[at[go]] > t[go]
        m[go] = np.minimum(m[go], pre[at[go]])
        at[go] -= size
        size //= 2
    found = (at >= 0) & (m > 0)
    found[found] = t[at[found]] < t[found]
    return np.where(found, m, 0)


def factors(b: np.ndarray, start: np.ndarray, rest: np.ndarray, order: np.ndarray, least: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start (a place in b with ``length`` + 8 bytes after it, of which ``rest`` belong to its text, then padding):
    the longest prefix that another start has too, and that a start earlier in ``order`` has (its longest previous factor).
    Up to ``length``; under ``least`` counts as 0. Starts meet by fingerprint; all lengths are compared by bytes."""
    longest, previous = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    h = gram_hashes(b)

    def code(a: int, z: int, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), U64)
        for s in _steps(a, z, GRAM):
            out = fmix(out * _P + h[at + s])
        return out

    head = code(0, least, start)
    by = np.argsort(head)
    same = head[by][1:] == head[by][:-1]
    kept = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(by) else by
    if not len(kept):
        return longest, previous
    # equal strings of ``length`` bytes: one stands for all, the earliest
    tail = code(length - GRAM if length - least < GRAM else least, length, start[kept]) if length > least else head[kept]
    kept = kept[np.lexsort((order[kept], tail, head[kept]))]
    tail = code(length - GRAM if length - least < GRAM else least, length, start[kept]) if length > least else head[kept]
    v = _eights(b)
    twin = (head[kept][1:] == head[kept][:-1]) & (tail[1:] == tail[:-1])
    pair = np.flatnonzero(twin)
    twin[pair] = _common(v, start[kept[pair]], start[kept[pair + 1]], length) == length
    copy = np.concatenate([[False], twin])
    longest[kept[copy | np.concatenate([twin, [False]])]] = length
    previous[kept[copy]] = length
    r = kept[~copy]
    # suffix order of the rest: groups of equal heads, then eight bytes after eight
    g = head[r]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    for at in _steps(least, length, 8):
        group = np.cumsum(new) - 1
        sub = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(sub):
            break
        w, gs = v[start[r[sub]] + at], group[sub]
        o = np.lexsort((w, gs))
        r[sub], w = r[sub][o], w[o]
        new[sub[1:]] |= (gs[1:] == gs[:-1]) & (w[1:] != w[:-1])
    g = head[r]
    lcp = np.zeros(len(r) + 1, np.int64)  # lcp[i]: of i - 1 and i
    near = np.flatnonzero(g[1:] == g[:-1]) + 1
    lcp[near] = np.minimum(_common(v, start[r[near - 1]], start[r[near]], length), np.minimum(rest[r[near - 1]], rest[r[near]]))
    lcp[lcp < least] = 0
    longest[r] = np.maximum(longest[r], np.maximum(lcp[:-1], lcp[1:]))
    widest = int(np.bincount(np.cumsum(np.concatenate([[True], g[1:] != g[:-1]]))).max())
    before = _nearest_smaller(order[r], lcp[:-1], widest)
    after = _nearest_smaller(order[r][::-1], lcp[1:][::-1], widest)[::-1]
    previous[r] = np.maximum(before, after)
    return np.minimum(longest, rest), np.minimum(previous, rest)


def _tokens(grams: np.ndarray, parts: int) -> np.ndarray:
    h = fmix(grams)
    return (((h >> U64(32)) * U64(parts)) >> U64(32)) << U64(40) | (h & U64((1 << 40) - 1))


def spans(docs: DataFrame, length: int = 400, keep_first: bool = False, least: int | None = None) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, text, key = xxhash64(text)): classes (key, rep, copies), and of each class's text (key, found array<binary of int64 pairs>: the covered spans, longest, previous: its longest factors)."""
    least = least or length
    count = partitions_for(docs, 8)
    parts = spread_keys(count)
    classes = saved(docs.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "texts")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, int, np.ndarray]]:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for i, _, buf, offsets in slices(batch.column(1)):
                    for d in range(len(offsets) - 1):
                        g, n = np.unique(window_runs(buf[offsets[d]:offsets[d + 1]], least)[0], return_counts=True)
                        if len(g):
                            yield keys[i + d], 0, fmix(g)
                            yield keys[i + d] ^ (1 << 62), 1, fmix(g[n > 1])  # twice in this text: a match of its own

        yield from dealt(each(), parts)

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, key, own in gathered(batches):
            at, _, _ = shared(h, key)
            at = at[own[at] == 0]
            if len(at):
                at = at[np.argsort(key[at], kind="stable")]
                k = key[at]
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                t = h[at] | U64(part << 40)
                yield pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array([x.tobytes() for x in np.split(t, first[1:])], pa.binary())], ["key", "tokens"])

    found = docs.select("key", "text").mapInArrow(grams, SCHEMA).repartition(count, "part").mapInArrow(twice, "key long, tokens binary")
    wanted = found.groupBy("key").agg(F.collect_list("tokens").alias("tokens")).join(classes, "key")
    texts = docs.join(wanted.select(F.col("key").alias("k"), "rep", "tokens"), (F.col("key") == F.col("k")) & docs["doc_id"].eqNullSafe(F.col("rep")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, int], list] = {}
        done: list[tuple[int, int, int]] = []
        n = 0
        for batch in batches:
            keys, reps, tokens = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for i, _, buf, offsets in slices(batch.column(2)):
                for d in range(len(offsets) - 1):
                    own = buf[offsets[d]:offsets[d + 1]]
                    grams, first, last = window_runs(own, least)
                    t = _tokens(grams, count)
                    take = np.isin(t, np.concatenate([np.frombuffer(x, U64) for x in tokens[i + d]]))
                    fine = ((fmix(grams[take]) >> U64(32)) * U64(count * FINE)) >> U64(32)
                    key, rep, raw = keys[i + d], reps[i + d], own.tobytes()
                    rep = _LAST if rep is None else rep
                    for a, z, part in zip(first[take].tolist(), last[take].tolist(), fine.tolist(), strict=True):
                        content = raw[a:z + length], z - a + 1
                        entry = [rep, key, a, part, 0]
                        before = held.get(content)
                        if before is None:
                            held[content] = entry
                            n += len(content[0])
                        elif before[:3] != entry[:3]:
                            if entry[:3] < before[:3]:
                                held[content], before, entry = entry, entry, before
                            before[4] = 1
                            done.append((entry[1], entry[2], entry[2] + len(content[0])))
                if n > 12 << 20:
                    yield packed(held, done)
                    held, done, n = {}, [], 0
        if held:
            yield packed(held, done)

    def packed(held: dict[tuple[bytes, int], list], done: list) -> pa.RecordBatch:
        rows: dict[int, list] = {}
        for (content, starts), entry in held.items():
            rows.setdefault(entry[3], []).append((content, starts, entry))
        out = []
        for part, own in rows.items():
            out.append((parts[part // FINE], part, b"".join(c for c, _, _ in own), np.array([len(c) for c, _, _ in own], np.int64).tobytes(), np.array([[*e[:3], e[4], n] for _, n, e in own], np.int64).tobytes()))
        for i in range(0, len(done), 50_000):
            out.append((parts[i // 50_000 % count], 0, b"", b"", np.array(done[i:i + 50_000], np.int64).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "at", "contents", "sizes", "entries"])

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, contents, sizes, entries in zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True):
                if contents:
                    held.setdefault(part, []).append((contents, np.frombuffer(sizes, np.int64), np.frombuffer(entries, np.int64).reshape(-1, 5)))
                else:  # later copies of a batch's slices
                    key, a, z = np.frombuffer(entries, np.int64).reshape(-1, 3).T
                    m = np.minimum(z - a, length)
                    yield from returned(key, a, z, z - a >= length, m, m)
        for part in list(held):
            yield from turn(held.pop(part))

    def turn(rows: list) -> Iterator[pa.RecordBatch]:
        entries, sizes = np.concatenate([r[2] for r in rows]), np.concatenate([r[1] for r in rows])
        raw = np.frombuffer(b"".join(r[0] for r in rows), np.uint8)
        one = np.lexsort((-entries[:, 3], entries[:, 2], entries[:, 1], entries[:, 0]))  # repeated rows send their slices again
        e = entries[one]
        one = one[np.concatenate([[True], (e[1:, :3] != e[:-1, :3]).any(axis=1)])]
        at = (np.cumsum(sizes) - sizes)[one]
        entries, sizes = entries[one], sizes[one]
        room = entries[:, 4] + length - 1
        end = np.cumsum(room)
        b = np.full(int(end[-1]) + 8, _PAD, np.uint8)
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        b[np.repeat(end - room, sizes) + inside] = raw[np.repeat(at, sizes) + inside]
        starts = entries[:, 4]
        entry = np.repeat(np.arange(len(starts)), starts)
        inside = np.arange(len(entry)) - np.repeat(np.cumsum(starts) - starts, starts)
        start = entries[entry, 2] + inside
        text = np.cumsum(np.concatenate([[0], (np.diff(entries[:, 0]) != 0) | (np.diff(entries[:, 1]) != 0)]))
        rest = np.minimum(sizes[entry] - inside, length)
        longest, previous = factors(b, (end - room)[entry] + inside, rest, text[entry] * (int(start.max()) + 1) + start, least, length)
        longest = np.where(entries[entry, 3] == 1, rest, longest)
        hit = np.flatnonzero(longest)
        gone = (previous if keep_first else longest)[hit] == length
        yield from returned(entries[entry[hit], 1], start[hit], start[hit] + length, gone, longest[hit], previous[hit])

    def returned(key: np.ndarray, a: np.ndarray, b: np.ndarray, gone: np.ndarray, longest: np.ndarray, previous: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        by = np.lexsort((a, key))
        key, a, b, gone = key[by], a[by], b[by], gone[by]
        own = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        most = [np.maximum.reduceat(x[by], own) for x in (longest, previous)]
        keys = key[own]
        key, a, b = key[gone], a[gone], b[gone]
        found = [b""] * len(keys)
        if len(key):
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (a[1:] > b[:-1])]))  # merged() joins the rest
            pairs, k = np.column_stack([a[first], np.maximum.reduceat(b, first)]), key[first]
            cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            for i, x in zip(np.searchsorted(keys, k[cuts]).tolist(), np.split(pairs, cuts[1:]), strict=True):
                found[i] = x.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found, pa.binary()), *map(pa.array, most)], ["key", "found", "longest", "previous"])

    sent = texts.select("key", "rep", "text", "tokens").mapInArrow(cut, "part int, at int, contents binary, sizes binary, entries binary")
    back = sent.repartition(count, "part").mapInArrow(ordered, "key long, found binary, longest long, previous long")
    return classes, back.groupBy("key").agg(F.collect_list(F.when(F.length("found") > 0, F.col("found"))).alias("found"), F.max("longest").alias("longest"), F.max("previous").alias("previous"))


def merged(found: list[bytes] | None) -> np.ndarray:
    """Disjoint maximal spans, in order."""
    if not found:
        return np.zeros((0, 2), np.int64)
    x = np.concatenate([np.frombuffer(f, np.int64).reshape(-1, 2) for f in found])
    x = x[np.argsort(x[:, 0], kind="stable")]
    end = np.maximum.accumulate(x[:, 1])
    first = np.flatnonzero(np.concatenate([[True], x[1:, 0] > end[:-1]]))
    return np.column_stack([x[first, 0], np.maximum.reduceat(x[:, 1], first)])


def whole_characters(x: np.ndarray, b: bytes) -> np.ndarray:
    """Spans shrunk to whole UTF-8 characters."""
    out = []
    for a, z in x.tolist():
        while a < z and b[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(b) and b[z] & 0xC0 == 0x80:
            z -= 1
        if a < z:
            out.append((a, z))
    return np.array(out, np.int64).reshape(-1, 2)


def _met(docs: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """docs with rep, copies, found, longest and previous of their class. Rows of hot classes learn their class from a broadcast of fewer than HOT_SHARE rows; only their representative goes to the class's key for the rest."""
    rows = classes.agg(F.sum("copies").alias("n")).first()["n"] or 0
    hot = classes.where(F.col("copies") > max(rows // HOT_SHARE, 1)).select(F.col("key").alias("hot_key"), F.col("rep").alias("hot_rep"), F.col("copies").alias("hot_copies"))
    info = classes.join(found.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left").drop("k").where((F.col("copies") > 1) | F.col("longest").isNotNull())
    info = info.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left")
    at = F.when(F.col("hot_key").isNull(), F.col("key"))
    info = info.select(F.coalesce(at, F.xxhash64("key", "rep")).alias("meet"), F.col("key").alias("class"), "rep", "copies", "found", "longest", "previous")
    docs = docs.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left").withColumn("meet", F.coalesce(at, F.xxhash64("key", "doc_id")))
    out = docs.join(info.withColumnRenamed("meet", "met"), (F.col("meet") == F.col("met")) & (F.col("key") == F.col("class")), "left")
    return out.withColumn("rep", F.coalesce("rep", "hot_rep")).withColumn("copies", F.coalesce("copies", "hot_copies", F.lit(1)))


def removed(docs: DataFrame, length: int = 400, keep_first: bool = False, texts: bool = False, least: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, longest_match, longest_previous) for every row; the last two are the lengths of its text's longest factor that also starts elsewhere, and of its longest previous factor (at most ``length``, 0 under ``least``). With ``texts`` also ``kept``, the text without the spans (shrunk to whole characters), and ``row``, a struct of all the row's columns."""
    least = least or length
    kind = docs.schema["doc_id"].dataType.simpleString()
    row = [F.struct(*docs.columns).alias("row")] if texts else []
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *row)
    docs = docs.withColumn("key", F.xxhash64("text"))
    classes, found = spans(docs, length, keep_first, least)
    joined = _met(docs, classes, found).select("doc_id", "text", "rep", "copies", "found", "longest", "previous", *["row"] * texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for doc, text, rep, copies, spans, longest, previous in zip(*(part.column(c).to_pylist() for c in range(7)), strict=True):
                    b = text.encode()
                    later = copies > 1 and doc != rep
                    whole = copies > 1 and len(b) >= length and (not keep_first or later)
                    x = np.array([[0, len(b)]]) if whole else merged(spans)
                    if texts:
                        x = whole_characters(x, b)
                    kept, last = [], 0
                    for a, z in x.tolist():
                        kept.append(b[last:a])
                        last = z
                    kept = b"".join([*kept, b[last:]])
                    own = min(len(b), length) if len(b) >= least else 0
                    longest, previous = max(longest or 0, own if copies > 1 else 0), max(previous or 0, own if later else 0)
                    out.append((len(b), int((x[:, 1] - x[:, 0]).sum()), len(x), hashlib.sha256(kept).hexdigest(), longest, previous, *([kept.decode()] if texts else [])))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    own = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *own, *([part.column(7)] if texts else [])], ["doc_id", *"abcdefg"[:len(own)], *["row"] * texts])

    more = f", kept string, row {docs.schema['row'].dataType.simpleString()}" if texts else ""
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, longest_match long, longest_previous long{more}")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors from 200 bytes on are reported (about 30 words), strings of 400 bytes removed."""
    return removed(table(spark, sf_dir, "documents"), 400, least=200)
