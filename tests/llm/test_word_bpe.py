"""Speculative BPE against the tokenizers library: texts of all kinds, unsound tokens, exact merging, long texts and words."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm import word_bpe
from tidewell.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return word_bpe.coder(word_bpe.vocabulary_file())


def coded(own, texts):
    out = [([], []) for _ in texts]
    for i, ids, said in word_bpe.encoded(own, texts):
        out[i][0].append(ids)
        out[i][1].append(said)
    return [(" ".join(a), " ".join(b)) for a, b in out]


def wanted(library, texts):
    got = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    return [(" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)) for ids in got]


def random_texts(n):
    rng = random.Random(3)
    vocab = [v.removesuffix("</w>") for v in json.loads(word_bpe.vocabulary_file())["model"]["vocab"]]
    bits = ["<|endoftext|>", "<|startoftext|>", "<|", "don't", "x'll", "'S", "É", "ß", "½", "́", "é", "\x1c", "\x85", "\xa0", " ", "İ", "ΣΑΣ", "</w>", "<|ENDOFTEXT|>"]
    for _ in range(n):
        r = rng.random()
        if r < 0.3:
            yield "".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:rng.choice([1, 2, 3, 26])]) for _ in range(rng.randint(1, 90)))
        elif r < 0.6:
            yield "".join(rng.choice(vocab) for _ in range(rng.randint(1, 6)))
        elif r < 0.8:
            yield "".join(chr(rng.choice([rng.randint(0, 0x250), rng.randint(0, 0x3000), rng.randint(0x300, 0x370), rng.randint(0xE000, 0x1FFFF), 32, 10])) for _ in range(rng.randint(1, 30)))
        else:
            yield rng.choice(["", " "]).join(rng.choice([*bits, "aa" * rng.randint(1, 20), "." * rng.randint(1, 40)]) for _ in range(6))


def test_random_texts(own, library):
    texts = [*random_texts(4000), "", None, " \n\t "]
    assert coded(own, texts) == wanted(library, texts)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, library, text):
    assert coded(own, [text]) == wanted(library, [text])


def test_long_texts_go_in_pieces_with_the_same_result(own, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "HELD", 20_000)
    text = " ".join(random_texts(3000)).replace("\x00", "") + " " + "x" * 60_000 + "ab" * 20_000 + ". tail"
    assert len(list(word_bpe.pieces(text))) > 2
    assert "".join(word_bpe.pieces(text)) == text
    assert coded(own, [text, "after", text]) == wanted(library, [text, "after", text])


def test_megabyte_without_a_space(own, library):
    text = "ab.c" * 250_000
    assert coded(own, [text]) == wanted(library, [text])


def test_borders_agree_with_exact_merging(own):
    """A pair of sound tokens has no crossing exactly where merging both anew gives the pair."""
    m, rng = own.merges, random.Random(4)
    sound = [t for t in range(m.size) if m.sound[t]]

    def spelt(t):
        return spelt(int(m.left[t])) + spelt(int(m.right[t])) if m.rank[t] >= 0 else [t]

    import numpy as np

    pairs = [(rng.choice(sound), rng.choice(sound)) for _ in range(3000)] + [(t, t) for t in rng.sample(sound, 500)] + [(int(m.left[t]), int(m.right[t])) for t in rng.sample([t for t in sound if m.rank[t] >= 0], 500)]
    crossing = m.crossing(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for (a, b), first in zip(pairs, crossing.tolist(), strict=True):
        assert (m.merged(spelt(a) + spelt(b)) == [a, b]) == (first == word_bpe.NEVER)
    for t in range(m.size):
        assert (m.merged(spelt(t)) == [t]) == bool(m.sound[t])


def test_most_words_of_prose_are_settled_by_their_proposal(library):
    own = word_bpe.Coder(word_bpe.vocabulary_file())
    text = "the quick brown fox jumps over the lazy dog while several engineers discuss interesting distributed tokenizers"
    coded(own, [text])
    assert own.exact <= 2


def altered(change):
    spec = json.loads(word_bpe.vocabulary_file())
    change(spec)
    return json.dumps(spec).encode()


def test_a_table_of_merges_out_of_order_is_merged_exactly(library):
    spec = json.loads(word_bpe.vocabulary_file())
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    file = json.dumps(spec).encode()
    own, other = word_bpe.Coder(file), Tokenizer.from_str(file.decode())
    assert not own.merges.ordered
    texts = ["hello there world", "aaaa aaaaaaab", "tokens of words"]
    assert coded(own, texts) == wanted(other, texts)


def test_files_of_another_kind_are_refused():
    for change in (lambda s: s["model"].update(dropout=0.1), lambda s: s["normalizer"]["normalizers"].pop(), lambda s: s["added_tokens"][0].update(lstrip=True)):
        with pytest.raises(ValueError, match="kind"):
            word_bpe.Coder(altered(change))


def test_frames(spark, library):
    rows = [(1, "Hello  world's <|endoftext|>", 3, "a"), (1, "Hello  world's <|endoftext|>", 3, "a"), (2, None, 3, "a"), (3, "", 3, "a"), (None, "ünï ç", 3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, id string").repartition(2)
    file = word_bpe.vocabulary_file()
    got = sorted(word_bpe.tokenized(docs, file).collect(), key=str)
    want = sorted(((i, [*map(int, a.split())], b) for (i, *_), (a, b) in zip(rows, wanted(library, [r[1] for r in rows]), strict=True)), key=str)
    assert [(r["doc_id"], r["ids"], r["decoded"]) for r in got] == [tuple(w) for w in want] or sorted(map(str, want)) == sorted(str((r["doc_id"], r["ids"], r["decoded"])) for r in got)
    assert word_bpe.tokenized(spark.createDataFrame([], "doc_id long, text string"), file, digests=True).count() == 0


def test_query_over_whole_documents(spark, library):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    want = {}
    for r, (ids, said) in zip(docs, wanted(library, [r["text"] for r in docs]), strict=True):
        want[r["doc_id"]] = (len(ids.split()), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op13_speculative_bpe"](spark, DIR).collect()} == want
