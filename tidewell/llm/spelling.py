"""Spelling variants of a corpus' words by letter-parity bitmasks.

A word's mask has a bit a letter, set where the letter occurs an odd number of times. An edit of one letter flips one bit
(insertion, deletion) or two (replacement). So of three bands of the mask at least one stays as it is for words of one length,
and two do for words whose lengths differ by one: words that share them, and lengths that fit, meet in a join whose condition
counts the differing bits and then verifies the edit. A group of words with one band's value and length that is larger than
GROUP is cut again by the same argument, as its words still differ in two of the remaining bits at most: those bits are split
into three bands too, up to LEVELS times, when the key holds 63 of the 90 bits. What is large then, a vocabulary of few letters, meets as it is. Only near pairs leave the
join. All of it is DataFrame functions.

Defined cases: null and empty texts have no words, rows without an id use the empty id in the checksum, repeated rows count
again, other columns are ignored; without words the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, saved, table

GROUP = 1_000  # rows of a band's group that meet each other in one join key
LEVELS = 3  # a row has 3 ** level keys

# The letters of a word, and those of A-Z from the most frequent on.
LETTERS = r"[A-Za-zÀ-ÿ]+"
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"

HALF = 45  # bits of each of a mask's two longs
#: Bits from the most frequent letter's on, so that every third of them makes bands of much the same spread.
BITS = [ord(c) - ord("a") for c in FREQUENT] + list(range(26, 2 * HALF))


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199) -> DataFrame:
    """(word): every run of letters of every text, A-Z lower-cased; of the runs whose crc32 of ``<id>:<run>`` ``every`` divides, without the letter of the checksum's place."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of the words of at least so many code points and occurrences."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def masked(words: DataFrame) -> DataFrame:
    """words with their length ``size`` and mask (``low``, ``high``): a-z have bits of their own, as have any 64 letters in a row; others share bits, which only adds candidates."""
    bits = F.transform(F.filter(F.split("word", ""), lambda c: c != ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).otherwise(26 + F.ascii(c) % 64))

    def half(begin: int) -> Column:
        own = F.filter(bits, lambda b: (b >= begin) & (b < begin + HALF))
        return F.aggregate(own, F.lit(0).cast("long"), lambda m, b: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b - begin)))

    return words.select("word", "n", F.length("word").alias("size"), half(0).alias("low"), half(HALF).alias("high"))


def _mask(bits: list[int]) -> tuple[int, int]:
    return sum(1 << b for b in bits if b < HALF), sum(1 << (b - HALF) for b in bits if b >= HALF)


class Bands:
    """The paths of one level: the bits fixed along each, and those left."""

    def __init__(self, fixed: list[list[int]], left: list[list[int]]):
        self.fixed, self.left = fixed, left

    @classmethod
    def start(cls) -> Bands:
        return cls([[]], [BITS])

    def below(self) -> Bands:
        """Each path in three: every third of its remaining bits is fixed too."""
        cut = [(f, r, r[j::3]) for f, r in zip(self.fixed, self.left, strict=True) for j in range(3)]
        return Bands([f + band for f, _, band in cut], [[b for b in r if b not in band] for _, r, band in cut])

    def children(self) -> Column:
        """For a row's ``path`` the three paths of this level below it, with their masks."""
        each = [F.struct(F.lit(i).alias("path"), *[F.lit(m).cast("long").alias(n) for n, m in zip(("of_low", "of_high"), _mask(f), strict=True)]) for i, f in enumerate(self.fixed)]
        return F.array(*[F.array(*each[i:i + 3]) for i in range(0, len(each), 3)])[F.col("path")]


KEY = ["path", "key_low", "key_high", "at"]


def _keyed(rows: DataFrame, fixed: Column) -> DataFrame:
    """rows once for each of ``fixed`` (array of path, of_low, of_high), with the mask's bits there as the key."""
    out = rows.select(*[c for c in rows.columns if c != "path"], F.explode(fixed).alias("c"))
    return out.select("*", "c.path", F.col("low").bitwiseAND(F.col("c.of_low")).alias("key_low"), F.col("high").bitwiseAND(F.col("c.of_high")).alias("key_high")).drop("c")


def _met(left: DataFrame, right: DataFrame, flips: int, ordered: bool) -> DataFrame:
    """(a, n_a, b, n_b): near pairs of rows that share their key. Bits are counted before any letter is looked at."""
    x = left.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    y = right.select(*KEY, F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    flipped = F.bit_count(F.col("low_a").bitwiseXOR(F.col("low_b"))) + F.bit_count(F.col("high_a").bitwiseXOR(F.col("high_b")))
    once = [F.col("a") < F.col("b")] if ordered else []
    return x.join(y, [*[x[f"_{k}"] == y[k] for k in KEY], flipped <= flips, *once, F.levenshtein(F.col("a"), F.col("b"), 1) == 1]).select("a", "n_a", "b", "n_b")


def _longer(rows: DataFrame) -> DataFrame:
    """Near pairs of which b is a letter longer: one bit differs, so two of three bands are the same."""
    bands = [BITS[j::3] for j in range(3)]
    fixed = F.array(*[F.struct(F.lit(j).alias("path"), *[F.lit(m).cast("long").alias(c) for c, m in zip(("of_low", "of_high"), _mask([b for i, band in enumerate(bands) if i != j for b in band]), strict=True)]) for j in range(3)])
    return _met(_keyed(rows.withColumn("at", F.col("size")), fixed), _keyed(rows.withColumn("at", F.col("size") - 1), fixed), 1, False)


def near_pairs(words: DataFrame, group: int | None = None) -> DataFrame:
    """(a, n_a, b, n_b) for every two of the distinct ``words`` (word, n) that are one inserted, deleted or replaced code point apart, once each."""
    group = group or GROUP
    rows = saved(masked(words), "masks")
    found, used = saved(_longer(rows), "pairs"), [rows]
    used.append(found)
    now, bands = rows.withColumn("at", F.col("size")).withColumn("path", F.lit(0)), Bands.start()
    for level in range(1, LEVELS + 1):
        bands = bands.below()
        dealt = _keyed(now, bands.children())
        sizes = dealt.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        dealt = saved(dealt.join(sizes.select(*KEY, ((F.col("rows") > group) & F.lit(level < LEVELS)).alias("large")), KEY), "bands")
        small = dealt.where(~F.col("large"))
        pairs = saved(_met(small, small, 2, True), "pairs")
        used += [dealt, pairs]
        found = found.unionByName(pairs)
        now = dealt.where("large").select("word", "n", "size", "low", "high", "at", "path")
        if now.isEmpty():
            break
    out = saved(found.distinct(), "near")
    forget(*used)
    return out


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of the distinct ``words`` (word, n): form is the near word of the largest n (ties: the smallest by code points) if that is at least ``times`` the word's, root the last form."""
    words = saved(words.select("word", "n"), "vocabulary")
    near = near_pairs(words)
    arcs = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = arcs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    whole = words.join(best, "word", "left")
    takes = -F.col("best.less") >= times * F.col("n")
    whole = saved(whole.select("word", F.when(takes, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, -F.col("best.less")).alias("form_n")), "forms")
    roots = saved(whole.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:  # n grows with each form, so that the pointers end; each round doubles their reach
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("after"))
        new = saved(roots.join(on, "root", "left").select("word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")), "roots")
        forget(roots)
        roots = new.select("word", "root")
        roots.saved_at = new.saved_at
        if new.where("moved").isEmpty():
            break
    return whole.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_parity_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted(words_of(table(spark, sf_dir, "documents"))))
