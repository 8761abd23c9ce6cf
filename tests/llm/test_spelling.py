"""Spelling variants against a plain version: random words, cut groups, nulls, long runs."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidewell.llm import spelling

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(words, times=5):
    by = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        if by[w]:
            b = min(by[w], key=lambda v: (-words[v], v))
            if words[b] >= times * n:
                form[w] = b

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(by[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def vocabulary(seed, letters, n):
    rng = random.Random(seed)
    words = {}
    for _ in range(n):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9)))
        words[w] = rng.randint(5, 3000)
        for _ in range(rng.randint(0, 3)):  # edits of edits
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]])
            words[w] = rng.randint(5, 300)
    return words


@pytest.mark.parametrize(("letters", "group"), [("abcdefghijklmnopqrstuvwxyzéßÿ×", None), ("abc", None), ("abé", 5), ("aß", 2)])
def test_variants(spark, letters, group, monkeypatch):
    if group:
        monkeypatch.setattr(spelling, "GROUP", group)
    words = vocabulary(len(letters), letters, 60)
    rows = [(w, n, 0) for w, n in words.items()]
    got = spelling.variants(spark.createDataFrame(rows, "word string, n long, size int"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(words)
    assert {tuple(r) for r in got.collect()} == want
    assert any(r[1] and r[1] != r[2] for r in want)


def test_letters_beyond_latin_share_bits(spark):
    words = {"привет": 100, "привет" + "ы": 9, "приве": 6, "превет": 5, "日本語日本語": 7, "日本語日本": 50, "мир": 5}
    assert {tuple(r) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()} == plain(words)


def counts(rows, every):
    n = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            n[r[:h % len(r)] + r[h % len(r) + 1:] if h % every == 0 else r] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


@pytest.mark.parametrize("every", [199, 2, 1])
def test_words(spark, every):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("aeiouRSTÉß÷n") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    rows = [(i, rng.choice([" ", "-", "1", "Ā"]).join(rng.choice(vocab) for _ in range(200))) for i in range(20)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (50, ""), (51, None), (52, "x" * 200_000), (53, "a " * 100_000 + "éééééé " * 7), (54, "\n")]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling.counted(spelling.words_of(docs, every=every))
    assert {r["word"]: r["n"] for r in got.collect()} == counts(rows, every)


def test_no_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.counted(spelling.words_of(none))).count() == 0
    assert spelling.variants(spark.createDataFrame([("single", 5)], "word string, n long")).collect()[0].asDict() == {"word": "single", "form": None, "root": "single", "n": 5, "n_near": 0, "form_n": None}


def test_a_group_meets_in_small_parts(spark):
    """Words of equal letters' parities in one band go on by further bands; no pair of a large group is lost."""
    words = {f"aaaaaa{x}{y}{z}": 5 + i for i, (x, y, z) in enumerate((x, y, z) for x in "bcdfgh" for y in "jklmnp" for z in "qrstvw")}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    whole = {frozenset((r["a"], r["b"])) for r in spelling.near_pairs(frame, 1 << 40).collect()}
    assert {frozenset((r["a"], r["b"])) for r in spelling.near_pairs(frame, 20).collect()} == whole
    assert len(whole) == 216 * 15 // 2
