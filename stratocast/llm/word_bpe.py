"""BPE encoding and decoding by a trie over distinct words.

A text is cut into words by the vocabulary's own rules. The distinct words of a piece
of the input (about 16 MB of text) form a trie, walked depth first; a node is a prefix
and holds its last token and the node where that begins. The last token is the one
vocabulary suffix that may follow the last token before it, where a pair may follow
when merging its joined text gives the pair back: BPE encodings are exactly the token
sequences whose neighbours are all such pairs. A prefix shared by many words is
therefore encoded once, and a word adds one step, the token that carries the word end.

Words sorted by code point are the trie in depth-first order: the stack holds the path
to the current node, and the common prefix of neighbours says how far to go back.

The vocabulary file's path is a parameter; it is read once per Python worker.
Defined cases: NULL text counts as empty and gives no ids and empty decoded text; the
strings of special tokens inside a text become their ids; texts of any length; repeated
rows encode alike; ids outside the vocabulary decode to nothing.
"""

import hashlib
import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from .common import batches, record

END = "</w>"
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
SPACE = regex.compile(r"\s+")
#: Words whose encodings a worker keeps between pieces.
KEEP = 200_000


def byte_letters():
    """A printable letter for each byte: itself where printable in Latin-1, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordTrie:
    """Encoder of one vocabulary file (word-level BPE with a word-end mark)."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        self.ranks = {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in chain(self.vocab.items(), self.special.items())}
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.letter = byte_letters()
        self.table = {b: s for b, s in self.letter.items()}
        self.pairs = {}
        self.kept = {}
        reach = {t for a, b in self.ranks for t in (a + b,)}  # tokens that merging can produce
        self.tokens = {t: i for t, i in self.vocab.items() if t in reach or len(t.removesuffix(END)) == 1}

    def merged(self, symbols):
        """Plain BPE of a symbol list; only for the short texts of token pairs."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def symbols(self, token):
        body = token.removesuffix(END)
        return [*body[:-1], body[-1] + END] if token.endswith(END) and body else list(body)

    def follows(self, a, b):
        """Whether token ``b`` may stand right after ``a`` in an encoding."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(self.symbols(a) + self.symbols(b)) == [a, b]
        return got

    def step(self, word, n, path, mark):
        """(last token, its id, where it begins) of the first ``n`` letters, ``mark`` at their end."""
        tokens, follows = self.tokens, self.follows
        for k in range(max(0, n - self.longest), n):
            t = word[k:n] + mark
            i = tokens.get(t)
            if i is not None:
                if k == 0 or follows(path[k][0], t):
                    return t, i, k
        raise ValueError(f"no token ends {word[:n]!r}")

    def words(self, words):
        """{word: ids} of distinct words in byte letters, sharing the work on prefixes."""
        out, path, before = {}, [(None, -1, -1)], ""
        for word in sorted(words):
            n = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                n += 1
            n = min(n, len(path) - 1)
            del path[n + 1:]
            for m in range(n + 1, len(word)):
                path.append(self.step(word, m, path, ""))
            _, i, k = self.step(word, len(word), path, END)
            ids = [i]
            while k:
                _, i, k = path[k]
                ids.append(i)
            out[word] = ids[::-1]
            before = word
        return out

    def split(self, text):
        """Words of a text; special tokens come as their ids."""
        if self.cut is None or "<|" not in text and not self.cut.search(text):
            return WORDS.findall(self.normal(text))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += WORDS.findall(self.normal(text[at:m.start()]))
            out.append(self.special[m.group()])
            at = m.end()
        return out + WORDS.findall(self.normal(text[at:]))

    @staticmethod
    def normal(text):
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # Lower-casing per code point: final sigma has no special form here.
            text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
            return text
        return text.lower()

    def letters(self, word):
        if word.isascii():
            return word if word.isprintable() else "".join(map(self.table.__getitem__, word.encode()))
        return "".join(map(self.table.__getitem__, word.encode()))

    def encode(self, texts):
        """Ids of each text as little-endian unsigned 32-bit numbers, and the decoded text."""
        cut = [self.split(t) for t in texts]
        new = set().union(*cut) - self.kept.keys()
        known = {i: (i, self.text_of[i]) for i in new if isinstance(i, int)}
        if len(self.kept) > KEEP:
            self.kept = {}
            new = set().union(*cut)
            known = {i: (i, self.text_of[i]) for i in new if isinstance(i, int)}
        self.kept.update({i: (np.array([n], dtype="<u4").tobytes(), t) for i, (n, t) in known.items()})
        by_letters = {w: self.letters(w) for w in new if not isinstance(w, int)}
        ids = self.words(set(by_letters.values()))
        text_of = self.text_of
        for w, s in by_letters.items():
            i = ids[s]
            self.kept[w] = (np.array(i, dtype="<u4").tobytes(), " ".join([text_of[x] for x in i]))
        get = self.kept.__getitem__
        for c in cut:
            found = list(map(get, c))
            yield b"".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def decode(self, ids):
        return " ".join(self.text_of[i] for i in ids if i in self.text_of)


_LOADED = {}


def encoder(path):
    if path not in _LOADED:
        _LOADED[path] = WordTrie(path)
    return _LOADED[path]


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _pieces(iterator, path):
    trie = encoder(path)
    for b in batches(iterator, 16 << 20):
        yield b.column(0).to_pylist(), trie.encode(b.column(1).to_pylist())


def _texts(docs):
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs, path):
    """(doc_id, ids array<int>) of every whole text."""

    def run(iterator):
        for ids, encoded in _pieces(iterator, path):
            yield record(ENCODED, doc_id=ids, ids=[np.frombuffer(e, dtype="<u4").astype(np.int32) for e, _ in encoded])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded, path):
    """(doc_id, text) of (doc_id, ids)."""

    def run(iterator):
        trie = encoder(path)
        for b in batches(iterator):
            yield record(pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), doc_id=b.column(0), text=[trie.decode(i or []) for i in b.column(1).to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs, path):
    """Counts and digests of ids and decoded text, made where the ids are."""

    def run(iterator):
        for ids, encoded in _pieces(iterator, path):
            out = [(len(e) // 4, hashlib.sha256(e).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for e, t in encoded]
            n, a, b = zip(*out) if out else ([], [], [])
            yield record(DIGEST, doc_id=ids, n_tokens=n, ids_sha256=a, decoded_sha256=b)

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
