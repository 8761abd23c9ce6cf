"""Local parts against plain Python, without Spark."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import bpe, chat, common, jaccard, leaks, messages, sharding, substrings, token_counts, vectors
from tidewell.llm.words import shingle_sets, slices, word_hashes

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t|0", max_size=40)), min_size=1, max_size=8))
def test_words_and_shingles(texts):
    for i, j, buf, offsets in slices(pa.array(texts, pa.string()), 16):
        hashes, at = word_hashes(buf, offsets)
        own = [words(t or "") for t in texts[i:j]]
        assert np.diff(at).tolist() == [len(w) for w in own]
        flat = [x for w in own for x in w]
        assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
        for w, s in zip(own, shingle_sets(buf, offsets), strict=True):
            want = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
            assert len(s) == len(want)


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("scan", [6e-5, 1.0, 0.0])  # as measured; all light; all heavy
def test_size_aware_pairs(monkeypatch, scan):
    monkeypatch.setattr(jaccard, "SCAN_S", scan)
    rng = random.Random(1)
    for trial in range(40):
        sets = []
        for _ in range(rng.randint(2, 30)):
            if sets and rng.random() < 0.6:
                s = set(rng.choice(sets).tolist())
                for _ in range(rng.randint(0, 4)):
                    s.symmetric_difference_update({rng.randint(0, 60)})
            else:
                s = {rng.randint(0, 60) for _ in range(rng.randint(1, 25))}
            sets.append(np.array(sorted(s), np.uint64))
        sets = list({s.tobytes(): s for s in sets}.values())
        group = [rng.randint(0, 1) for _ in sets] if trial % 3 == 0 else None
        want = []
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if len(a) and both * 100 >= 75 * (len(a) + len(b) - both) and not (group and group[i] == group[j]):
                    want.append((i, j))
        assert components(len(sets), jaccard.size_aware_pairs(sets, 75, group)) == components(len(sets), want)


def test_windows_meet_by_their_smallest_gram():
    rng = random.Random(3)
    text = np.array([rng.choice(b"abc") for _ in range(400)] * 2, np.uint8)
    grams, first, last = substrings.window_runs(text, 200)
    assert first[0] == 0 and last[-1] == len(text) - 200 and (first[1:] == last[:-1] + 1).all()
    of = {}
    for g, a, z in zip(grams.tolist(), first.tolist(), last.tolist(), strict=True):
        for i in range(a, z + 1):
            assert of.setdefault(bytes(text[i:i + 200]), g) == g


@pytest.mark.parametrize(("least", "length"), [(64, 64), (64, 80), (70, 133), (64, 300)])
def test_factors_equal_brute_force(least, length):
    rng = random.Random(least + length)
    for trial in range(5):
        pool = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(30, 400))) for _ in range(3)]
        texts = []
        for _ in range(rng.randint(1, 7)):
            a = rng.choice(pool)
            cut = rng.randint(0, len(a))
            texts.append(a[:cut] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 5))) + rng.choice(pool)[rng.randint(0, 20):])
        texts = [t for t in texts if len(t) >= least] or [b"a" * (least + 9)]
        rng.shuffle(texts)
        buf = b"".join(t + b"\xff" * (length + 8) for t in texts)
        base = np.cumsum([0] + [len(t) + length + 8 for t in texts])
        where = [(k, p) for k, t in enumerate(texts) for p in range(len(t) - least + 1)]
        order = list(range(len(where)))
        rng.shuffle(order)  # of the starts, against what comes first
        start = np.array([base[k] + p for k, p in where])
        rest = np.array([min(length, len(texts[k]) - p) for k, p in where])
        longest, previous = substrings.factors(np.frombuffer(buf, np.uint8), start, rest, np.array(order), least, length)
        own = [texts[k][p:p + length] for k, p in where]
        for i in range(0, len(where), max(1, len(where) // 40)):
            both = [0 if j == i or x[:least] != own[i][:least] else len(os.path.commonprefix([own[i], x])) for j, x in enumerate(own)]
            far = max(both)
            before = max([n for j, n in enumerate(both) if order[j] < order[i]], default=0)
            assert (longest[i], previous[i]) == (far if far >= least else 0, before if before >= least else 0)


def test_spans_merge_and_keep_whole_characters():
    x = np.array([[5, 9], [0, 4], [4, 6], [20, 22]], np.int64)
    assert substrings.merged([x[:2].tobytes(), x[2:].tobytes()]).tolist() == [[0, 9], [20, 22]]
    assert substrings.whole_characters(np.array([[1, 3], [0, 3], [1, 2]]), "éé".encode()).tolist() == [[0, 2]]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**40))
def test_permutation(rows, seed):
    n = np.arange(rows)
    p = sharding.permuted(n, rows, seed)
    assert sorted(p.tolist()) == n.tolist() and (sharding.permuted(p, rows, seed, back=True) == n).all()
    k = int(p[rows // 2])
    assert sharding.row_at(k % 7, k // 7, rows, 7, seed) == rows // 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1 .'\n\té 　|<>")), max_size=300))
def test_bpe_cuts_change_nothing(text):
    enc = _encoding()
    ids = bpe.encode(enc, text, most=5)
    assert ids == enc.encode_ordinary(text) and enc.decode_bytes(ids) == text.encode()
    assert "".join(bpe.pieces(text, 5)) == text


_HELD = {}


def _encoding():
    if not _HELD:
        _HELD["e"] = bpe.encoding(*bpe.rank_file())
    return _HELD["e"]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab\\<|\n>ni")), max_size=12), st.text(alphabet=st.sampled_from(list("us\\<|\n>n")), max_size=6))
def test_chat_round_trip(text, role):
    parts = chat.segments(chat.CHATML, role, text)
    assert chat.read_turn(chat.CHATML, "".join(t for t, _ in parts)) == (role, text)
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allocation(rule):
    rng = random.Random(5)
    for _ in range(50):
        n = rng.randint(1, 40)
        tokens = np.array(sorted(rng.sample(range(1, n), rng.randint(0, n - 1))) + [n])
        sections = np.array(sorted(rng.choices(range(0, n + 1), k=rng.randint(0, 4))) + [n])
        got, crossing = token_counts.allocated(np.concatenate([[0], tokens[:-1]]), tokens, sections, rule)
        assert got.sum() == pytest.approx(len(tokens)) and (crossing >= 0).all()
    got, crossing = token_counts.allocated(np.array([0, 3]), np.array([3, 5]), np.array([1, 5]), rule)
    assert got.tolist() == pytest.approx({"start": [1, 1], "end": [0, 2], "majority": [0, 2], "split": [1 / 3, 5 / 3]}[rule]) and crossing.tolist() == [1, 1]


def test_character_spans():
    text = "aé😀b"  # bytes 1, 2, 4, 1
    spans = lambda *widths: list(zip(*(x.tolist() for x in token_counts.character_spans(text, np.array(widths))), strict=True))
    assert spans(1, 2, 4, 1) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert spans(2, 2, 1, 3) == [(0, 2), (1, 3), (2, 3), (2, 4)]  # characters that tokens share
    assert token_counts.lines("a\nb").tolist() == [2, 3] and token_counts.lines("a\n").tolist() == [2] and token_counts.lines("").tolist() == [0]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert leaks.common_subsequence(np.array(a), np.array(b)) == t[-1][-1]


def test_order_join_equals_all_pairs():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((700, 16))
    x[300:] = x[:400] + 0.08 * rng.standard_normal((400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :4]
    x = x[np.lexsort((x @ axes).T[::-1])]
    want = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = vectors.Joined(x, None, axes, 0.95, np.ones(len(x), np.int64), None)
    assert ((got.na + got.nb) == want.sum(1)).all() and want.any()
    two = vectors.Joined(x[:350], x[350:], axes, 0.95, np.ones(350, np.int64), np.ones(350, np.int64))
    assert (two.na == want[:350, 350:].sum(1)).all() and (two.nb == want[:350, 350:].sum(0)).all()


def test_messages_round_trip():
    parts = common.spread_keys(5)
    rng = np.random.default_rng(1)
    docs = [(i, i + 1, np.unique(rng.integers(0, 2**64, 20, np.uint64))) for i in range(6)]
    rows = list(messages.dealt(iter(docs), parts, flush=40))
    got = [(at, h, k, s) for at, hs, ks, ss in messages.gathered(rows) for h, k, s in zip(hs.tolist(), ks.tolist(), ss.tolist(), strict=True)]
    assert sorted((h, k) for _, h, k, _ in got) == sorted((int(x) & (1 << 40) - 1, i) for i, _, h in docs for x in h) and all(s == k + 1 for _, _, k, s in got)
    h, k = np.array([5, 7, 5, 5, 9, 7], np.uint64), np.array([1, 1, 2, 2, 3, 1])
    at, run, n = messages.shared(h, k)
    assert [(int(h[i]), int(k[i])) for i in at] == [(5, 1), (5, 2)] and run.tolist() == [0, 0] and n.tolist() == [2]
    nodes, low = messages.local_components(np.array([5, 3, 9]), np.array([3, 8, 4]))
    assert dict(zip(nodes.tolist(), low.tolist(), strict=True)) == {3: 3, 4: 4, 5: 3, 8: 3, 9: 4}
