"""The registered queries against brute force on a small fixture with copies, nulls, empty and long texts, clashing columns."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewell.llm import bpe, chat, jaccard, leaks, links, quality, sharding, substrings, suffix_tree, token_counts, vectors
from tidewell.llm.common import fold_mod
from tidewell.llm.queries import QUERIES, SQL

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def corpus():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("aeiourstn") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    base = [prose(rng.randint(20, 200)) for _ in range(25)]
    passage = prose(90)
    texts = [*base, base[0], base[0], base[1], *(base[2].replace(vocab[k], "zz") for k in (3, 7, 9)), prose(60) + passage + prose(40), passage + prose(30), "ab " * 900, "", None, " \n", "one two", "One two", "x" * 3000 + " é" * 300, base[3] + " tail words here"]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


ROWS = corpus()
SCHEMA = "doc_id long, text string, key string, rep string, n long"  # columns that clash with names used inside


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS + [ROWS[4], (None, "a null id's text " * 40, "en", "s", 0)], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard(docs, none):
    sets = {}
    for i, t, *_ in ROWS:
        w = words(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and len(a & b) * 100 >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = [r.asDict() for r in jaccard.linked(docs).collect()]
    assert len(got) == len(ROWS) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]))
    assert sum(find(i) != i for i in sets) >= 5
    assert jaccard.linked(none).count() == 0


def test_jaccard_cut_blocks(docs, monkeypatch):
    want = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard.linked(docs).collect())
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard.linked(docs).collect()) == want


def test_jaccard_one_id_two_texts(spark):
    rng = random.Random(2)
    prose = lambda: [f"w{rng.randint(0, 9999)}" for _ in range(80)]
    a, b = prose(), prose()
    rows = [(5, a), (5, b), (5, []), (7, [*a, "end"]), (8, [*b, "end"]), (3, ["start", *b]), (9, prose())]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.linked(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()}
    assert got == {(5, 76, 5), (5, 76, 3), (5, 0, 5), (7, 77, 5), (8, 77, 3), (3, 77, 3), (9, 76, 9)}


@pytest.mark.parametrize(("length", "first", "least"), [(400, False, 200), (400, True, 200), (200, False, 200), (200, True, 200)])
def test_substrings(docs, none, length, first, least):
    rows = ROWS if first else [*ROWS, ROWS[4], (None, "a null id's text " * 40, None, None, 0)]
    at = defaultdict(list)
    for k, (i, t, *_) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            at[b[p:p + length]].append((i is None, i or 0, k, p))
    digests = []
    for k, (i, t, *_) in enumerate(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            found = at[b[p:p + length]]
            if len(found) > 1 and (not first or min(found) < (i is None, i or 0, k, p)):
                gone[p:p + length] = b"\1" * length
        runs = len(re.findall(b"\1+", gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        digests.append((i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    factor = {}  # by the starts that share their first bytes, the longest prefix that two of them share
    heads = defaultdict(list)
    for k, (i, t, *_) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            heads[b[p:p + least]].append((i is None, i or 0, k, p, b[p:p + length]))
    for own in heads.values():
        own.sort()
        for x, one in enumerate(own):
            for before in own[:x]:
                n = len(one[4]) if one[4] == before[4] else len(os.path.commonprefix([one[4], before[4]]))
                if n <= factor.get((one[2], 1), 0) and n <= factor.get((before[2], 0), 0):
                    continue
                for k, which in ((one[2], 1), (one[2], 0), (before[2], 0)):
                    factor[k, which] = max(factor.get((k, which), 0), n)
    want = Counter((*x, factor.get((k, 0), 0), factor.get((k, 1), 0) if first else None) for k, x in enumerate(digests))
    chosen = docs.where("doc_id is not null").dropDuplicates(["doc_id"]) if first else docs
    out = substrings.removed(chosen, length, first, least=least)
    got = Counter((*tuple(r)[:-1], r["longest_previous"] if first else None) for r in out.collect())  # of equal rows none is first
    assert got == want and sum(x[2] > 0 for x in want) >= 5
    assert substrings.removed(none, length).count() == 0


def test_substring_texts_keep_columns(docs):
    out = substrings.removed(docs, 200, keep_first=True, texts=True).select("row.*", "kept", "n_removed")
    assert set(SCHEMA.replace(",", "").split()[::2]) <= set(out.columns) and out.count() == docs.count()


@pytest.mark.parametrize("entries", [400_000, 40])
def test_suffix_tree(docs, none, monkeypatch, entries):
    monkeypatch.setattr(suffix_tree, "TABLE", entries)  # few: most words and pairs aren't told apart
    out = suffix_tree.scored(docs, fold_mod("doc_id", 10) != 0, least_share=0.005).collect()
    assert len(out) == len(ROWS) + 2
    rows = [*ROWS, ROWS[4], (None, "a null id's text " * 40)]
    train = [words(r[1]) + [None] for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10]
    c = Counter(t for d in train for t in d)
    total = sum(c.values())
    tokens = {r[0]: words(r[1]) + [None] for r in rows}
    for r in out:
        t = tokens[r["doc_id"]]
        base = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (len(c) + 1))) for x in t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[x] > 0 for x in t), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] <= 0
    assert suffix_tree.scored(none, fold_mod("doc_id", 10) != 0).count() == 0


@pytest.mark.parametrize(("share", "gain", "penalty", "depth"), [(0.02, 2.0, 3.0, 3), (0.02, -1e9, 0.0, 2), (1e-9, 1.0, 0.5, 3), (0.9, 2.0, 1.0, 3), (0.004, 3.0, 1.0, 4)])
def test_suffix_tree_equals_plain_model(spark, share, gain, penalty, depth):
    """Counts, divergence test and smoothing in plain Python; hot contexts, cold ones and both; distributions sum to one."""
    rng = random.Random(4)
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randint(0, 60)):
            text.append("cy" if text[-1:] == ["ax"] and rng.random() < 0.7 else rng.choice("aaabcd") + rng.choice("xxy"))
        rows.append((i, " ".join(text)))
    rows += [(100 + i, rows[5][1]) for i in range(3)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = {i: [*t.split(), None] for i, t in rows}
    c, follow = Counter(), defaultdict(Counter)
    for i, t in tokens.items():
        if not held(i):
            c.update(t)
            for k, w in enumerate(t):
                for n in range(1, min(depth, k) + 1):
                    follow[tuple(t[k - n:k])][w] += 1
    total = sum(c.values())
    size = {s: sum(f.values()) for s, f in follow.items()}
    hot = {s for s in follow if size[s] >= share * total}

    def gained(s, q):
        return sum(n * math.log(n / size[s] / q(w)) for w, n in follow[s].items()) - penalty * (len(follow[s]) - 1)

    def of_suffix(s):
        return (lambda w: follow[s[1:]][w] / size[s[1:]]) if len(s) > 1 else (lambda w: c[w] / total)

    def with_suffixes(chosen, among):
        return {x for s in chosen for x in (s[k:] for k in range(len(s))) if x in among}

    cold = set(follow) - hot
    shortest = {s for s in cold if len(s) == 1 or s[1:] in hot}
    kept = with_suffixes({s for s in hot if gained(s, of_suffix(s)) >= gain}, hot)

    def p(context, w):
        if not context:
            return (c[w] + 0.1) / (total + 0.1 * (len(c) + 1))
        below = p(context[1:], w)
        if context not in kept:
            return below
        f = follow[context]
        return (f[w] + len(f) * below) / (size[context] + len(f))

    mine = {s for s in cold if size[s] >= 2 and gained(s, (lambda w, s=s: p(s[1:], w)) if s in shortest else of_suffix(s)) >= gain}
    kept |= with_suffixes(mine, cold)
    assert kept and (share < 0.01 or share == 0.9 or kept & hot)
    if gain > 0 and share < 0.9:
        assert len(kept) < len(follow)
    for s in sorted(kept)[::7]:
        assert sum(p(s, w) for w in [*c, "unseen"]) == pytest.approx(1)
    out = suffix_tree.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), fold_mod("doc_id", 10) != 0, share, gain, penalty, depth=depth)
    for r in out.collect():
        t = tokens[r["doc_id"]]
        want = 0
        for k, w in enumerate(t):
            context = tuple(t[max(0, k - depth):k])
            x = math.log10(p(context, w))
            want += x if not context or context in hot else round(x * suffix_tree.STEPS) / suffix_tree.STEPS
        assert r["score"] == pytest.approx(want, abs=2.1 / suffix_tree.STEPS)  # a tie may round either way


def test_suffix_tree_learns_context(spark):
    rows = [(i, "red apple " * 30 + "blue sky " * 30 if i % 2 else "green leaf " * 60) for i in range(60)]
    out = suffix_tree.scored(spark.createDataFrame(rows, "doc_id long, text string"), fold_mod("doc_id", 10) != 0)
    r = out.selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r["s"] > 0.7 * r["b"]


def test_quality(spark, docs, none):
    rng = random.Random(1)
    junk = [(i, " ".join("".join(rng.choice("abc") for _ in range(5)).upper() + "!!" for _ in range(rng.randint(20, 80)))) for i in range(200, 300)]
    good = [(i, " ".join("".join(rng.choice("aeirst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 200))) + ".") for i in range(300, 400)]
    df = spark.createDataFrame([*junk, *good, (400, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, 0) for i, _ in junk), *((i, 1) for i, _ in good), (1, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.classified(df, labels)[0].collect()}
    assert len(out) == 202 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    held = [i for i in range(200, 400) if out[i]["held_out"]]
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200, 400))
    assert held and all(out[i]["predicted"] == (i >= 300) for i in held)
    assert {r["score"] for r in quality.classified(df, labels.where("quality = 1"))[0].collect()} == {1.0}
    assert {r["score"] for r in quality.classified(df, labels.limit(0))[0].collect()} == {0.5}
    assert quality.classified(none, labels)[0].count() == 0


def test_quality_equals_plain_discriminant(spark):
    """Scores from plainly computed class means, shrunken covariances and densities, before and after calibration."""
    rng = np.random.default_rng(8)
    words_ = ["ab", "Cde", "fghi!", "12", "x|y", "lmno.", "p"]
    texts = [" ".join(rng.choice(words_, rng.integers(1, 60), p=np.roll([0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05], i % 2 * 3))) for i in range(160)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, quality int")
    out, model = quality.classified(df, labels)
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    x = np.array([quality.statistics(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in texts])
    train = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in range(160)])
    label = np.arange(160) % 2
    groups = [x[train & (label == c)] for c in (0, 1)]
    scatter = [np.cov(g.T, bias=True) for g in groups]
    n = [len(g) for g in groups]
    pooled = (n[0] * scatter[0] + n[1] * scatter[1]) / sum(n)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    logs = []
    for c in (0, 1):
        own = (0.95 * scatter[c] + 0.05 * pooled) / np.outer(scale, scale)
        own = 0.8 * own + 0.2 * np.trace(own) / len(own) * np.eye(len(own)) + 1e-9 * np.eye(len(own))
        d = (x - groups[c].mean(0)) / scale
        logs.append(math.log(n[c] / sum(n)) - 0.5 * (np.linalg.slogdet(own)[1] + 2 * np.log(scale).sum() + np.einsum("ij,jk,ik->i", d, np.linalg.inv(own), d)))
    odds = logs[1] - logs[0]
    assert model.log_odds(x) == pytest.approx(odds, rel=1e-6, abs=1e-6)
    want = 1 / (1 + np.exp(-(model.slope * odds + model.shift)))
    assert [got[i] for i in range(160)] == pytest.approx(want, rel=1e-5, abs=1e-9)
    z = np.round(np.clip(odds[train], -200, 200) / 0.5) * 0.5  # the calibration's gradient vanishes at its optimum
    p = 1 / (1 + np.exp(-(model.slope * z + model.shift)))
    spread = math.sqrt(np.mean(z * z))
    assert abs(np.mean((label[train] - p) * z / spread) - 1e-4 * model.slope * spread) < 1e-6 and abs(np.mean(label[train] - p) - 1e-4 * model.shift) < 1e-6


def test_very_long_texts_and_clashing_columns(spark):
    """A text of a million words, repeated rows and columns named like those inside, for the operators that other tests give short texts."""
    rng = random.Random(6)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta."]) for _ in range(300_000))
    rows = [(1, long, "a", "b", 1, 2, 3), (1, long, "a", "b", 1, 2, 3), (2, "alpha beta", None, None, 0, 0, 0), (3, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, stats string, train int, copies int, cosine int")
    labels = spark.createDataFrame([(1, 1, 5), (2, 0, 5)], "doc_id long, quality int, stats int")
    assert quality.classified(df, labels)[0].count() == 4
    out = suffix_tree.scored(df, F.lit(True)).collect()
    assert sorted(r["n_tokens"] for r in out) == [1, 3, 300_001, 300_001]
    items = spark.createDataFrame([("i1", "alpha beta gamma delta. alpha alpha beta beta gamma gamma omega", 1.0)], "item_id string, text string, cosine double")
    keyed = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    planted = keyed.unionByName(keyed.limit(1).select(F.lit("d9").alias("doc_id"), F.concat(F.lit("one two three "), F.lit(items.first()["text"]), F.lit(" four")).alias("text"), *keyed.columns[2:]))
    found = {(r["doc_id"], r["item_id"]) for r in leaks.leaked(planted, items).collect()}
    assert ("d9", "i1") in found and leaks.leaked(planted, items.limit(0)).count() == 0
    talks = spark.createDataFrame([(1, 0, "user", long, "s", 1), (1, 1, "assistant", long, "s", 1)], "conv_id long, turn long, role string, text string, state string, segments int")
    r = chat.read_back(chat.format_turns(talks)).first()
    assert r["loss_chars"] == len(long) and r["valid"]


def test_one_large_star(spark):
    """A hub of 100,000 neighbours and some chains."""
    star = spark.range(1, 100_001).selectExpr("id AS u", "7000000L AS v")
    chain = spark.range(200_000, 200_050).selectExpr("id AS u", "id + 1 AS v")
    out = {r["component"]: r["n"] for r in links.components(star.unionByName(chain)).groupBy("component").count().withColumnRenamed("count", "n").collect()}
    assert out == {1: 100_001, 200_000: 51}


def test_bpe(docs, none):
    enc = bpe.encoding(*bpe.rank_file())
    texts = {r[0]: r[1] or "" for r in ROWS}
    out = bpe.tokenized(docs, *bpe.rank_file(), digests=True).where("doc_id is not null").collect()
    for r in out:
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    assert bpe.tokenized(none, *bpe.rank_file()).count() == 0 and len(out) == len(ROWS) + 1


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests


def thirds(text):
    return np.array([*range(3, len(text), 3), len(text)])


@pytest.mark.parametrize(("rule", "cut"), [*((r, thirds) for r in token_counts.RULES), ("majority", token_counts.lines)])
def test_section_tokens(spark, docs, none, rule, cut):
    """Every section against a join of all token spans with all section spans, in characters."""
    ranks = bpe.rank_file("byte_bpe_50k.tiktoken")
    enc = bpe.encoding(*ranks)
    odd = [(900, "é\né\n\n😀😀x\n" * 5, None, None, 0), (901, "\n", None, None, 0), (902, "a\n\nb", None, None, 0)]
    texts = {r[0]: r[1] or "" for r in [*ROWS, *odd]}
    got = {}
    both = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(odd, SCHEMA))
    for r in token_counts.counted(both, *ranks, rule, cut).collect():
        got[r["doc_id"], r["section"]] = (r["start_char"], r["end_char"], r["n_tokens"], r["n_crossing"])
    seen = 0
    for i, t in texts.items():
        places = [k for k, c in enumerate(t) for _ in c.encode()]  # the character of each byte
        spans, at = [], 0
        for x in enc.encode_ordinary(t):
            own = places[at:at + len(enc.decode_single_token_bytes(x))]
            at += len(own)
            spans.append((own[0], own[-1] + 1))
        if len(t) > 2000 and cut is thirds:  # the plain version takes the square
            for k in range(len(cut(t))):
                got.pop((i, k))
            continue
        sections, a = [], 0
        for line in (re.findall(r"(?s).{1,3}", t) if cut is thirds else re.findall(r"[^\n]*\n|[^\n]+", t)) or [""]:
            sections.append((a, a + len(line)))
            a += len(line)
        n, crossing = [0.0] * len(sections), [0] * len(sections)
        for b, e in spans:
            inside = [max(0, min(e, z) - max(b, a)) for a, z in sections]
            hit = [k for k, x in enumerate(inside) if x]
            crossing = [c + (len(hit) > 1 and k in hit) for k, c in enumerate(crossing)]
            if rule == "split":
                n = [v + inside[k] / sum(inside) for k, v in enumerate(n)]
            else:
                n[{"start": hit[0], "end": hit[-1], "majority": max(hit, key=lambda k: (inside[k], -k))}[rule]] += 1
        for k, (a, z) in enumerate(sections):
            have = got.pop((i, k))
            assert have[:2] == (a, z) and have[2] == pytest.approx(n[k]) and have[3] == crossing[k]
            seen += crossing[k]
    assert not got and (seen or cut is token_counts.lines)
    assert token_counts.counted(none, *ranks).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <|im_end|> \\ b"), (1, 2, "user", None), (2, 0, "assistant", ""), (2, None, "system", "s"), (None, 0, "user", "x"), (1, 1, "assistant", "a <|im_end|> \\ b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(SQL["op1_chat_format"]).fetchall()
    got = [tuple(r) for r in chat.read_back(chat.format_turns(df)).collect()]
    assert sorted(map(str, got)) == sorted(str(r) for r in want if r[0] != -1)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_shards(docs, none):
    out = [r.asDict() for r in sharding.shard_rows(docs, 7).collect()]
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert len(out) == len(ROWS) + 2 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(sharding.row_at(r["shard"], r["slot"], len(out), 7) == r["row_number"] for r in out)
    texts = {r[0]: r[1] or "" for r in ROWS}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]].encode()) + 8, zlib.crc32(texts[r["doc_id"]].encode())) for r in out if r["doc_id"] is not None)
    again = [r.asDict() for r in sharding.shard_rows(docs.repartition(5), 7).collect()]
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert sharding.shard_rows(none).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    at = sharding.shard_rows(df, 4)
    sharding.write_shards(df, at, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 50 and sorted(r[0] for r in back.groupBy("shard").count().select("count").collect()) == [12, 12, 13, 13]


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    x[40:50] = x[:10] + 0.1 * rng.standard_normal((10, 8)).astype(np.float32)
    x[50:55] = x[0]
    x[55] = 2 * x[1]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(100, None, 0), (101, [0.0] * 8, 0), (102, [1.0, None, *[0.0] * 6], 0), (103, [float("nan")] * 8, 0), (104, [float("inf")] + [0.0] * 7, 0), (105, [], 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")
    d = x.astype(float)
    cos = d @ d.T / np.sqrt((d * d).sum(1)[:, None] * (d * d).sum(1)[None, :])
    hit = (cos >= 0.95) & ~np.eye(60, dtype=bool)
    root = list(range(60))
    for _ in range(60):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(hit[i]))]) for i in range(60)]
    got = {r["vec_id"]: r for r in vectors.linked(df).collect()}
    for i in range(60):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (hit[i].sum(), root[i], root[i] == i)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(100, 106))
    assert got[None]["component_id"] is None and len(got) == len(rows)
    assert vectors.linked(df.limit(0)).count() == 0 and vectors.linked(df.where("vec_id > 99")).count() == 6


def test_leaks(spark, docs, none):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(15, 90)))) for i in range(20)]
    rows, want = [], set()
    for i in range(120):
        text = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        if i % 4 == 0:
            item = items[i // 4 % 20]
            w = item[1].split()
            if i % 8 == 0:  # a paraphrase: every tenth word differs
                w = [rng.choice(vocab) if k % 10 == 5 else x for k, x in enumerate(w)]
            at = rng.randint(0, len(text))
            text = text[:at] + [x.upper() + "," for x in w] + text[at:]
            want.add((i, item[0]))
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    out = leaks.leaked(df, bench)
    assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == want
    assert leaks.leaked(df, bench.limit(0)).count() == 0 and leaks.leaked(none, bench).count() == 0


def test_leaks_whole_items_at_size(spark):
    """Every document of sf0.1 (200 items) that holds an item's words as one run is found."""
    d = "/root/testdata/sf0.1"
    plain = lambda t: " ".join(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER)))
    texts = {r["doc_id"]: f" {plain(r['text'])} " for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    items = {r["item_id"]: f" {plain(r['text'])} " for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in texts.items() for k, w in items.items() if w in t}
    got = {(r["doc_id"], r["item_id"]) for r in leaks.op8_latent_leaks(spark, d).collect()}
    assert len(want) > 100 and want <= got


def brute_leaks(rows, items):
    """All pairs that the rule accepts in some place of twice the item, by trying every place."""
    found = set()
    for i, text in rows:
        t = np.array(text.split(), object)
        for j, item in items:
            w = np.array(item.split(), object)
            n, answer = len(w), w[-6:]
            common = [x in set(w) for x in t]
            for b in range(len(t)):
                if common[b] and sum(common[b:b + 2 * n]) >= 0.6 * n:
                    share, answers = (leaks.common_subsequence(x, t[b:b + 2 * n]) / len(x) for x in (w, answer))
                    if share >= (1 if n < 8 else 0.7) or (n >= 8 and share >= 0.6 and answers >= 0.8):
                        found.add((i, j))
                        break
    return found


@pytest.mark.parametrize(("least", "most"), [(20, 60), (8, 15), (2, 9)])
def test_leaks_of_a_large_benchmark(spark, least, most):
    """Several hundred items, whole or with up to 30 % of words replaced, in documents of the same words: none is lost."""
    rng = random.Random(least)
    vocab = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(4, 9))) for _ in range(4000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(least, most)))) for i in range(400)]
    rows = []
    for i, (_, item) in enumerate(items):
        w = item.split()
        for k in rng.sample(range(len(w)), int((0, 0.2, 0.3)[i % 3] * len(w))):
            w[k] = rng.choice(vocab)
        rows.append((i, " ".join([*rng.choices(vocab, k=rng.randint(0, 60)), *w, *rng.choices(vocab, k=rng.randint(0, 60))])))
    want = brute_leaks(rows, items)
    got = leaks.leaked(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) >= (390 if least >= 8 else 130)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        return i if root[i] == i else find(root[i])

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in links.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert all(got.get(i, i) == find(i) for i in root)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twins(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, d)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as C
    from tidewell.llm.common import table

    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = docs
    for _, stage in C.STAGES[:-1]:
        kept = stage(spark, kept, d)
        assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, d, "labels").collect()}
    after = {r["doc_id"] for r in C.STAGES[0][1](spark, docs, d).collect()}
    assert sum((i in after) == (q == 1) for i, q in labels.items()) >= 0.95 * len(labels)  # a few dozen labelled rows at this size
    last = {r["doc_id"]: r for r in C.run(spark, d).collect()}
    final = {r["doc_id"]: r["text"] for r in kept.collect()}
    enc = bpe.encoding(*bpe.rank_file())
    assert set(last) == set(final) <= set(rows)
    assert all(last[i]["ids"] == enc.encode_ordinary(final[i]) for i in final)
    bad = docs.limit(0).unionByName(docs.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars").limit(2))
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, bad, d).count() in (0, 2)
        assert stage(spark, docs.limit(0), d).count() == 0


def test_decontamination_without_ids(spark):
    import corpus_pipeline as C

    d = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{d}/benchmark.parquet").first()["text"]
    clean = "nothing of the sort " * 20
    rows = [(None, f"before {item} after"), (None, clean), (None, None), (1, f"before {item} after"), (1, clean), (2, clean)]
    got = C.decontaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), d).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [rows[1], rows[2], *rows[4:]]))


def test_stages_equal_brute_force(spark):
    """near_duplicates, repeated_passages and decontamination on planted rows, each against a plain version of its rule."""
    import corpus_pipeline as C

    rng = random.Random(12)
    vocab = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(600)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    d = "/root/testdata/sf0.001"
    items = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    base, passage = [prose(120) for _ in range(12)], prose(60)
    texts = [*base, base[0], [*base[1], "more"], [*base[2][:60], *prose(60)], [*prose(30), *passage, *prose(30)], [*prose(20), *passage, *prose(50)], [*prose(20), *passage[:20], *prose(50)], [*prose(40), *items[0].split(), *prose(40)], [*prose(40), *items[1].split()[:4], *prose(40)]]
    rows = [(i, " ".join(t), "en", "s", len(" ".join(t))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    shingles = [{tuple(t[k:k + 5]) for k in range(len(t) - 4)} for t in texts]
    gone = {j for i, a in enumerate(shingles) for j, b in enumerate(shingles) if i < j and 100 * len(a & b) >= 75 * len(a | b)}
    got = {r["doc_id"] for r in C.near_duplicates(spark, docs, d).collect()}
    assert got == set(range(len(texts))) - gone and gone == {12, 13}

    seen, want = {}, {}
    for i, text, *_ in rows:
        cut = bytearray(len(text))
        for p in range(len(text) - C.PASSAGE + 1):
            if seen.setdefault(text[p:p + C.PASSAGE], (i, p)) != (i, p):
                cut[p:p + C.PASSAGE] = b"\1" * C.PASSAGE
        want[i] = "".join(c for c, x in zip(text, cut, strict=True) if not x)
    got = {r["doc_id"]: r["text"] for r in C.repeated_passages(spark, docs, d).collect()}
    assert got == want and sum(want[i] != r[1] for i, r in enumerate(rows)) == 4

    plain = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.translate(LOWER))

    def holds(text, item):
        n, least = len(item), math.ceil(0.7 * len(item))
        for k, w in enumerate(text):
            if w in item:
                row = [0] * (n + 1)
                for x in text[k:k + 2 * n]:
                    row = [0] + [v for v in _row(row, x, item)]
                if row[-1] >= least:
                    return True
        return False

    def _row(row, x, item):
        last = 0
        for j, y in enumerate(item):
            last = max(last, row[j] + 1 if x == y else row[j + 1])
            yield last

    benchmark = [plain(t) for t in items]
    bad = {i for i, t, *_ in rows if any(holds(plain(t), b) for b in benchmark)}
    kept = {r["doc_id"] for r in C.decontaminated(spark, docs, d).collect()}
    assert bad == {18} and kept == set(range(len(texts))) - bad


def test_near_duplicates_of_one_id(spark):
    """A row that shares its id with a kept text, but is itself a copy of a smaller id's, goes; no column but id and text is needed."""
    import corpus_pipeline as C

    rng = random.Random(8)
    a, b = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(80)) for _ in range(2))
    rows = [(1, a), (5, a + " tail"), (5, b), (5, b), (7, b + " tail"), (None, a), (9, "")]
    got = C.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(1, a), (5, b), (None, a), (9, "")], "doc_id long, text string").collect()))


def test_latent_search_alone_finds_what_the_exact_mode_does(spark):
    """Whole and reworded items, 300 of them: the cosine's gate loses none that the rarest words would bring."""
    rng = random.Random(21)
    vocab = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [prose(rng.randint(8, 70)) for _ in range(300)]
    rows = []
    for i, item in enumerate(items):
        own = [w if rng.random() > rng.choice([0, 0.1, 0.25]) else rng.choice(vocab) for w in item]
        rows.append((i, " ".join([*prose(rng.randint(0, 90)), *own, *prose(rng.randint(0, 90))])))
    rows += [(1000 + i, " ".join(prose(200))) for i in range(60)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    pairs = [{(r["doc_id"], r["item_id"]) for r in leaks.leaked(docs, bench, rule).collect()} for rule in (leaks.Rule(), leaks.Rule(cosine=2.0, exact=True))]
    assert len(pairs[1]) >= 200
    assert pairs[0] == pairs[1]


def test_bound_never_rules_out_an_accepted_place():
    rng = np.random.default_rng(6)
    own = [rng.integers(0, 400, n).astype(np.uint64) for n in (3, 8, 16, 17, 40, 700)]
    vocabulary = leaks.Vocabulary(np.concatenate(own))
    rule = leaks.Rule()
    bound = leaks.Bound(own, vocabulary, rule)
    for _ in range(40):
        k = int(rng.integers(0, len(own)))
        text = np.concatenate([rng.integers(0, 2000, int(rng.integers(0, 90))), own[k], rng.integers(0, 2000, int(rng.integers(0, 90)))]).astype(np.uint64)
        place, ids = vocabulary.ids(text)
        halves = bound.set(place // leaks.HALF, ids, -(-len(text) // leaks.HALF) + 1)
        for w in range(len(halves) - 1):
            h, n = w * leaks.HALF, len(own[k])
            near = text[max(0, h - n):h + 2 * leaks.HALF + n]
            if leaks.best_place(own[k], own[k][-6:], near, rule)[0]:
                assert bound.possible(halves, np.array([w]), np.array([k])).all()
