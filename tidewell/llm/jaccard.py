"""Jaccard similarity join of word shingles, size-aware: light sets meet in the buckets of their two-element subsets, heavy
sets scan inverted lists, and the boundary between the two is chosen by estimated cost.

At scale the join runs inside blocks that are proven to hold every linked pair:
1. equal sets become one class, known by its digest (its smallest id stands for it in the result);
2. a class can only link if enough of its shingles occur in another class; the rest leave after one message shuffle;
3. the remaining classes' rarest shared shingles (the prefix that any linked pair must meet in) give candidate blocks;
4. each block, cut into pairs of bounded sub-blocks where it is large, runs the size-aware join and returns a spanning
   forest of its links, never all pairs.

Defined cases: null or wordless texts have no shingles and link with nothing; rows with a null id get a null component
and link with nothing; repeated rows get a row each; rows of one id with different texts link each by its own text; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions_for, saved, spread_keys, table, with_class
from .links import components
from .messages import SCHEMA, dealt, gathered, local_components, shared
from .words import fmix, shingle_sets, slices

U64 = np.uint64
BLOCK = 2_000_000  # shingles of a (sub-)block in one task


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set at that similarity."""
    return -(-n * percent // 100)


def digest(h: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = np.add.reduce(fmix(h ^ U64(0x5851F42D4C957F2D)), dtype=U64)
        b = np.add.reduce(fmix(h ^ U64(0x14057B7EF767814F)), dtype=U64)
    return int(np.int64(a)), int(np.int64(b))


# seconds for a subset, a checked pair, an inverted-list entry, and a scan's start
SUBSET_S, CHECK_S, ENTRY_S, SCAN_S = 4e-7, 2.5e-5, 2e-9, 6e-5


def size_aware_pairs(sets: list[np.ndarray], percent: int = 75, group: list[int] | None = None) -> list[tuple[int, int]]:
    """Spanning links (i, j) among sorted distinct uint64 sets at Jaccard >= percent/100. With ``group`` (0 or 1 for each set) only pairs across groups are looked at."""
    if len(sets) < 2:
        return []
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    keep = df[token] >= 2
    owner, token = owner[keep], rank[token[keep]]
    order = np.lexsort((token, owner))
    owner, token = owner[order], token[order]
    at = np.searchsorted(owner, np.arange(len(sets) + 1))
    need = -(-size * percent // 100)
    prefix = np.diff(at) - need + 1  # below 1: too little left to link with
    live = np.flatnonzero((prefix >= 1) & (size > 1))
    if len(live) < 2:
        return []
    # inverted lists of the sets that may link
    mine = np.isin(owner, live)
    by_token = np.argsort(token[mine], kind="stable")
    lists, entries = owner[mine][by_token], token[mine][by_token]
    ends = np.searchsorted(entries, np.arange(len(df) + 1))
    length = np.diff(ends)
    light = np.array([SUBSET_S * (prefix[i] + 1) * prefix[i] / 2 + CHECK_S * length[token[at[i]:at[i] + prefix[i]]].max() for i in live])
    heavy = np.array([SCAN_S + ENTRY_S * (length[token[at[i]:at[i + 1]]].sum() + len(sets)) for i in live])
    by_size = np.argsort(size[live], kind="stable")
    total = np.concatenate([[0], np.cumsum(light[by_size])]) + np.concatenate([np.cumsum(heavy[by_size][::-1])[::-1], [0]])
    sizes = size[live][by_size]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(sizes)) + 1, [len(sizes)]])  # sets of one size stay on one side
    cut = int(cuts[np.argmin(total[cuts])])
    boundary = int(sizes[cut - 1]) if cut else 0
    label, links = np.arange(len(sets)), []
    across = np.array(group) if group is not None else None

    def join(i: int, j: int) -> None:
        links.append((min(i, j), max(i, j)))
        u, v = sorted((label[i], label[j]))
        label[label == v] = u

    for i in live[size[live] > boundary].tolist():  # heavy: the overlap with every set at once
        near = np.concatenate([lists[ends[t]:ends[t + 1]] for t in token[at[i]:at[i + 1]].tolist()])
        common = np.bincount(near, minlength=len(sets))
        hit = common * 100 >= percent * (size[i] + size - common)
        hit[i] = False
        if across is not None:
            hit &= across != across[i]
        found = np.flatnonzero(hit)
        if len(found):
            for r in np.unique(label[found], return_index=True)[1].tolist():
                if label[found[r]] != label[i]:
                    join(i, int(found[r]))
    buckets: dict[tuple[int, int], list[int]] = {}
    for i in live[size[live] <= boundary].tolist():  # light: two of the prefix and one more must meet
        own = token[at[i]:at[i] + prefix[i] + 1].tolist()
        for x in range(len(own)):
            for y in range(x + 1, len(own)):
                buckets.setdefault((own[x], own[y]), []).append(i)
    failed: set[tuple[int, int]] = set()
    for members in buckets.values():
        for y in range(1, len(members)):
            i = members[y]
            for j in members[:y]:
                if label[i] == label[j] or (j, i) in failed or (across is not None and across[i] == across[j]):
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common * 100 >= percent * (size[i] + size[j] - common):
                    join(j, i)
                else:
                    failed.add((j, i))
    return links


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, buf, offsets in slices(column):
        yield from shingle_sets(buf, offsets, k)


def linked(docs: DataFrame, percent: int = 75, k: int = 5, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id) for every row; ids are integers. With ``row_col``, a long that tells rows of one id apart, that column too."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(row_col).alias("_row")] if row_col else []))
    own = ", _row long" if row_col else ""
    count = partitions_for(docs, 6)
    parts = spread_keys(count)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(h), *digest(h)) for h in _sets(batch.column(1), k)]
            if rows:
                n, a, b = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), n, a, b, *batch.columns[2:]], ["doc_id", "n", "a", "b", *batch.schema.names[2:]])

    rows = saved(docs.mapInArrow(measured, "doc_id long, n long, a long, b long" + own), "sets")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))

    # half of a class's shingles, those smallest by fingerprint, are enough to see that it shares too few
    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, int, np.ndarray]]:
            for batch in batches:
                for h in _sets(batch.column(1), k):
                    if len(h):
                        yield digest(h)[0], len(h), fmix(np.sort(fmix(h))[:-(-len(h) // 2)])

        yield from dealt(each(), parts)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, key, _ in gathered(batches):
            at, _, _ = shared(h, key)
            own, n = np.unique(key[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n.astype(np.int64))], ["a", "n_shared"])

    seen = docs.mapInArrow(halves, SCHEMA).repartition(count, "part").mapInArrow(counted, "a long, n_shared long").groupBy("a").agg(F.sum("n_shared").alias("n_shared"))
    # linked sets r, s share at least a quarter of the smaller one's size within both halves, and sizes differ by 3/4 at most
    least = (percent - 50) / 100 * percent / 100
    left = classes.join(seen, "a").where(F.col("n_shared") >= F.ceil(F.col("n") * least)).select("rep")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for h in _sets(batch.column(1), k) if len(h)]  # an id may have a wordless text too
            yield pa.RecordBatch.from_arrays([pa.array([digest(h)[0] for h in found], pa.int64()), pa.array([len(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], ["id", "n", "shingles"])

    sets = saved(docs.join(left, docs["doc_id"] == left["rep"], "left_semi").mapInArrow(whole, "id long, n long, shingles binary"), "shingles")
    blocks = components(_candidates(sets, percent))
    edges = _block_links(sets, blocks, percent)
    found = saved(components(edges).join(classes.select(F.col("a").alias("node"), "rep"), "node"), "linked")
    smallest = found.groupBy("component").agg(F.min("rep").alias("least"))
    named = found.join(smallest, "component").select("node", "least")
    info = classes.join(named.withColumnRenamed("node", "a"), "a", "left").select("n", "a", "b", "copies", F.coalesce("least", "rep").alias("least"))
    out = with_class(rows, info, ["n", "a", "b"], "copies", F.col("n") > 0)
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), mine.alias("component_id"), *([F.col("_row").alias(row_col)] if row_col else []))


def _candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) between sets that meet in the prefixes of their shared shingles, rarest first, as stars."""
    count = partitions_for(sets, 8)
    parts = spread_keys(count)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from dealt(((i, n, np.frombuffer(x, U64)) for batch in batches for i, n, x in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)), parts)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, key, size in gathered(batches):
            at, run, n = shared(h, key)
            if not len(at):
                continue
            order = np.argsort(key[at], kind="stable")
            token, df, own, sizes = (h[at] | U64(part << 40))[order].view(np.int64), n[run][order].astype(np.int32), key[at][order], size[at][order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            ends = np.append(first[1:], len(own)).tolist()
            first = first.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(own[first]), pa.array(sizes[first]), pa.array([token[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()), pa.array([df[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())], ["id", "n", "tokens", "df"])

    weighed = sets.mapInArrow(send, SCHEMA).repartition(count, "part").mapInArrow(weigh, "id long, n long, tokens binary, df binary")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, int, np.ndarray]]:
            now, n, tokens, df = None, 0, [], []
            for batch in batches:
                for i, size, t, d in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    if i != now:
                        if now is not None:
                            yield now, n, prefix(n, tokens, df)
                        now, n, tokens, df = i, size, [], []
                    tokens.append(np.frombuffer(t, U64))
                    df.append(np.frombuffer(d, np.int32))
            if now is not None:
                yield now, n, prefix(n, tokens, df)

        def prefix(n: int, tokens: list, df: list) -> np.ndarray:
            t, d = np.concatenate(tokens), np.concatenate(df)
            return fmix(t[np.lexsort((t, d))][:max(0, len(t) - needed(n, percent) + 1)])

        yield from dealt(each(), parts)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, key, _ in gathered(batches):
            at, run, _ = shared(h, key)
            if len(at):
                first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
                u, v = local_components(key[at], key[at][first][run])
                yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    return weighed.repartition(count, "id").sortWithinPartitions("id").mapInArrow(prefixes, SCHEMA).repartition(count, "part").mapInArrow(stars, "u long, v long")


def _block_links(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Links within candidate blocks. A block of more than BLOCK shingles is first cut into levels of size, of which only neighbours can link, and what is still larger into sub-blocks of which each pair is a task's work."""
    held = sets.join(blocks.withColumnRenamed("node", "id"), "id")
    cuts = held.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("cuts"))
    if cuts.where("cuts > 1").limit(1).count():
        level = F.floor(F.log("n") / math.log(100 / percent) + 1e-9)  # linked sets' levels differ by one at most
        large = held.join(cuts, "component").withColumn("level", F.explode(F.when(F.col("cuts") > 1, F.array(level, level - 1)).otherwise(F.array(F.lit(0)))))
        held = large.withColumn("component", F.when(F.col("cuts") > 1, F.xxhash64("component", "level")).otherwise(F.col("component"))).drop("cuts", "level")
        cuts = held.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("cuts"))
    cut = held.join(cuts, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    lean = pairs.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        a, b = [], []

        def work() -> None:
            ids = sorted(held)
            group = [held[x][0] for x in ids] if now[1] != now[2] else None
            for x, y in size_aware_pairs([held[x][1] for x in ids], percent, group):
                a.append(ids[x])
                b.append(ids[y])

        for batch in batches:
            for c, i, j, own, key, x in zip(*(batch.column(n).to_pylist() for n in range(6)), strict=True):
                if (c, i, j) != now:
                    if held:
                        work()
                    now, held = (c, i, j), {}
                held[key] = (own, np.frombuffer(x, U64))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        if held:
            work()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lean.repartition(partitions_for(sets, 16), "component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(run, "a long, b long")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
