"""Word-level BPE by speculation: greedy tokens are proposed, checked pair by pair in bulk, and merged exactly only where a check fails.

The vocabulary is a tokenizer file of merges with word ends (a ``tokenizers`` JSON file). For each distinct word the longest
token is taken again and again. Such a proposal is the word's encoding exactly where every token encodes to itself and no
merge crosses the border of two neighbours in time: a walk back through the merges of the left token's right edge and of the
right token's left edge meets every pair of symbols that ever stand side by side at the border, and a merge of such a pair
crosses if its rank comes before both of the merges that take its symbols away (the right one's own rank counts too, as equal
merges go from left to right). The walks of all borders of a slice of text run in step, in numpy. Words with a crossing are
merged in order of rank. Files whose merges use later merges get exact merging for every word.

Texts are cut at special tokens first, then normalised and split as the file says: texts of printable ASCII and Latin-1
characters by a compiled pattern, all others by the file's own normaliser and splitter. Long texts go in pieces that end at a
space or a line end, which no word and no composed character spans.

Defined cases: null texts count as empty (no tokens, the empty text decoded), repeated ids and rows give a row each, other
columns are ignored; a text without white space is one piece, a word of any length is one word.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

PIECE = 32_768
SLICE = 1 << 20  # characters whose new words are encoded together
HELD = 24 << 20  # characters of known words that a worker holds, an entry counting as 60 more
SHORT = 64  # symbols of a word up to which a list is searched for its lowest rank instead of a heap
NEVER = np.int64(1) << 40

# The split of the word vocabulary, and the characters that the compiled pattern is right for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
LATIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xac\xae-\xff]*")
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
CUT = re.compile(r"[ \n]")


def byte_symbols() -> list[str]:
    """The symbol of each byte: printable Latin-1 characters stand for themselves, the others follow from 256 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Merges:
    """The merge table as arrays: each token's parts and rank, and the rank of each mergeable pair."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.size = max(vocab.values()) + 1
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, -1, np.int64)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        a, b, made = pairs.T
        at = np.arange(len(pairs))
        self.made = made
        self.left[made], self.right[made], self.rank[made] = a, b, at
        key = a * self.size + b
        order = np.argsort(key)
        self.keys, self.ranks = key[order], at[order]
        #: Every token is made by one merge, of tokens made before.
        self.ordered = len(np.unique(made)) == len(made) and len(np.unique(key)) == len(key) and bool((self.rank[a] < at).all() and (self.rank[b] < at).all())
        self.by_pair = dict(zip(key.tolist(), at.tolist(), strict=True))
        if self.ordered:
            self.sound = self.rank < 0
            whole = np.flatnonzero(~self.sound)
            alone = self.crossing(self.left[whole], self.right[whole]) == self.rank[whole]
            for t, good in sorted(zip(whole.tolist(), alone.tolist(), strict=True), key=lambda x: self.rank[x[0]]):
                self.sound[t] = good and self.sound[self.left[t]] and self.sound[self.right[t]]
        else:
            self.sound = np.zeros(self.size, bool)

    def crossing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbouring tokens the rank of the first merge across their border; NEVER where none is."""
        a, b = a.copy(), b.copy()
        first = np.full(len(a), NEVER)
        until_a, until_b = first.copy(), first.copy()
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else None
            if at is None:
                break
            hit = (self.keys[at] == key) & (self.ranks[at] < until_a[live]) & (self.ranks[at] <= until_b[live])
            first[live[hit]] = self.ranks[at[hit]]  # the walk goes back in time, so the last one found is the first
            rx, ry = self.rank[x], self.rank[y]
            undo_b = (ry >= rx) & (ry >= 0)
            undo_a = ~undo_b & (rx >= 0)
            i, j = live[undo_b], live[undo_a]
            until_b[i], b[i] = ry[undo_b], self.left[y[undo_b]]
            until_a[j], a[j] = rx[undo_a], self.right[x[undo_a]]
            live = live[undo_a | undo_b]
        return first

    def merged(self, tokens: list[int]) -> list[int]:
        """Exact merging: the lowest rank first, then the leftmost place."""
        size, by_pair = self.size, self.by_pair
        if len(tokens) <= SHORT:
            none = len(self.made)
            ranks = [by_pair.get(a * size + b, none) for a, b in zip(tokens, tokens[1:], strict=False)]
            while ranks and (r := min(ranks)) < none:
                i = ranks.index(r)
                tokens[i:i + 2] = [int(self.made[r])]
                del ranks[i]
                if i:
                    ranks[i - 1] = by_pair.get(tokens[i - 1] * size + tokens[i], none)
                if i < len(ranks):
                    ranks[i] = by_pair.get(tokens[i] * size + tokens[i + 1], none)
            return tokens
        after = [*range(1, len(tokens)), -1]
        before = list(range(-1, len(tokens) - 1))
        at = [(r, i) for i in range(len(tokens) - 1) if (r := by_pair.get(tokens[i] * size + tokens[i + 1])) is not None]
        heapq.heapify(at)
        while at:
            r, i = heapq.heappop(at)
            j = after[i]
            if tokens[i] < 0 or j < 0 or by_pair.get(tokens[i] * size + tokens[j]) != r:
                continue
            tokens[i], tokens[j] = int(self.made[r]), -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := by_pair.get(tokens[i] * size + tokens[k])) is not None:
                    heapq.heappush(at, (r, i))
            if (h := before[i]) >= 0 and (r := by_pair.get(tokens[h] * size + tokens[i])) is not None:
                heapq.heappush(at, (r, h))
        return [t for t in tokens if t >= 0]


class Coder:
    """A vocabulary file with the words encoded so far."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(file)
        model = spec["model"]
        known = spec["normalizer"]["normalizers"] == NORMAL and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": SPLIT}
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
        if not known or spec.get("decoder") or any((model.get(k) or v) != v for k, v in plain.items()) or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("the file's split, model or special tokens aren't of the kind that this module encodes")
        library = Tokenizer.from_str(file.decode())
        self.normal, self.split = library.normalizer, library.pre_tokenizer
        self.end = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.merges = Merges(vocab, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.symbols = byte_symbols()
        first, last = {}, {}
        for t, i in vocab.items():
            (last if t.endswith(self.end) else first)[t.removesuffix(self.end)] = i
        self.base = first, last
        sound = self.merges.sound
        self.last = {t: i for t, i in last.items() if sound[i]}
        self.longest = max(map(len, vocab))
        #: Every beginning of a token that a word may go on after, with the token that it is (-1: none).
        self.first = {t[:j]: -1 for t, i in first.items() if sound[i] for j in range(1, len(t))} | {t: i for t, i in first.items() if sound[i]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.apart = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else re.compile(r"(?!)")
        self.forget()
        self.exact = 0  # words that weren't settled by their proposal

    def forget(self) -> None:
        self.known = {t: (str(i), t) for t, i in self.special.items()}
        self.held = 0

    def words(self, text: str) -> list[str]:
        """Keys of the words and special tokens of a piece in order: Latin words as they are, others as byte symbols after a NUL."""
        out: list[str] = []
        begin = 0
        for m in self.apart.finditer(text):
            out += self._words(text[begin:m.start()])
            out.append(m.group())
            begin = m.end()
        return out + self._words(text[begin:]) if begin else self._words(text)

    def _words(self, text: str) -> list[str]:
        if LATIN.fullmatch(text):
            return LATIN_WORDS.findall(text.lower())
        return ["\0" + w for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text))]

    def proposed(self, word: str) -> list[int]:
        """The longest token at each place; empty if a place has none."""
        if (whole := self.last.get(word)) is not None:
            return [whole]
        out, i, n = [], 0, len(word)
        first, last = self.first, self.last
        while i < n:
            if n - i <= self.longest and (t := last.get(word[i:])) is not None:
                out.append(t)
                return out
            found, end = -1, i
            for j in range(i + 1, n):
                if (t := first.get(word[i:j])) is None:
                    break
                if t >= 0:
                    found, end = t, j
            if found < 0:
                return []
            out.append(found)
            i = end
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Encode words not known yet: proposals, one check of all their borders, exact merges for those that fail."""
        new = [w for w in words if w not in self.known]
        if not new:
            return
        spelt = [w[1:] if w[0] == "\0" else "".join([self.symbols[b] for b in w.encode()]) for w in new]
        got = [self.proposed(w) if self.merges.ordered else [] for w in spelt]
        sizes = np.array([len(g) for g in got])
        flat = np.fromiter((t for g in got for t in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(got)), sizes)
        border = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, at = np.unique(flat[border] * self.merges.size + flat[border + 1], return_inverse=True)
        bad = self.merges.crossing(pairs // self.merges.size, pairs % self.merges.size) < NEVER
        failed = sizes == 0
        failed[owner[border[bad[at]]]] = True
        for i in np.flatnonzero(failed).tolist():
            w = spelt[i]
            got[i] = self.merges.merged([self.base[0][c] for c in w[:-1]] + [self.base[1][w[-1]]])
        self.exact += int(failed.sum())
        for w, ids in zip(new, got, strict=True):
            self.known[w] = " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])
            self.held += len(w) + 60


@functools.lru_cache(maxsize=2)
def coder(file: bytes) -> Coder:
    return Coder(file)


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    begin = 0
    while len(text) - begin > most and (m := CUT.search(text, begin + most)):
        yield text[begin:m.start()]
        begin = m.start()
    yield text[begin:]


def encoded(own: Coder, texts: Iterable[str | None], most: int = SLICE) -> Iterator[tuple[int, str, str]]:
    """For each piece with tokens: the text's number, its ids and its token strings, each joined by one space."""
    held: list[tuple[int, list[str]]] = []
    size = 0

    def flush() -> Iterator[tuple[int, str, str]]:
        if own.held > HELD:
            own.forget()
        own.learn({w for _, words in held for w in words})
        for i, words in held:
            got = [own.known[w] for w in words]
            yield i, " ".join([g[0] for g in got]), " ".join([g[1] for g in got])

    for i, text in enumerate(texts):
        for piece in pieces(text or ""):
            if words := own.words(piece):
                held.append((i, words))
                size += len(piece)
            if size >= most:
                yield from flush()
                held, size = [], 0
    yield from flush()


def tokenized(docs: DataFrame, file: bytes, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, ids array<int>, decoded string) or, with ``digests``, (id, n_tokens, ids_sha256, decoded_sha256) without shipping the ids. A narrow map; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(file)  # the size of the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = (t.as_py() for t in part.column(1))
                if digests:
                    state = [[0, hashlib.sha256(), hashlib.sha256()] for _ in range(part.num_rows)]
                    for k, *joined in encoded(own, texts):
                        s = state[k]
                        for h, text in zip(s[1:], joined, strict=True):
                            if s[0]:
                                h.update(b" ")
                            h.update(text.encode())
                        s[0] += joined[0].count(" ") + 1
                    columns = [pa.array([s[0] for s in state], pa.int64()), pa.array([s[1].hexdigest() for s in state]), pa.array([s[2].hexdigest() for s in state])]
                else:
                    ids: list[list[int]] = [[] for _ in range(part.num_rows)]
                    said: list[list[str]] = [[] for _ in range(part.num_rows)]
                    for k, numbers, names in encoded(own, texts):
                        ids[k] += map(int, numbers.split(" "))
                        said[k].append(names)
                    columns = [pa.array(ids, pa.list_(pa.int32())), pa.array([" ".join(s) for s in said], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", *"abc"[:len(columns)]])

    kind = docs.schema[id_col].dataType.simpleString()
    names = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {names}")


def vocabulary_file(name: str = "word_bpe_49k.json") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op13_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"), vocabulary_file(), digests=True)
