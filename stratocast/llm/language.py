"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers read the UTF-8 bytes in either direction; a softmax over the
languages labels every byte; a document's probabilities are the mean over its bytes.
Trained in numpy by backpropagation through time on windows of a bounded sample
(``max_docs``, texts up to ``max_chars``). Scoring covers every byte of every whole
text: windows of 224 bytes with 16 bytes of context on both sides, batched in Arrow
pieces, without a shuffle.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0; texts
shorter than a window are padded; repeated rows score alike; a NULL doc_id is scored
and not held out; without any training row every text is ``und``.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import Adam, batches, held_out, record, remainder, sample
from .recurrent import gru, gru_gradient, init_gru, symbols, windows

CORE, CONTEXT, PAD = 224, 16, 256
LATIN = re.compile("[A-Za-z]")


def has_letter(text):
    return bool(LATIN.search(text)) or not text.isascii() and any(c.isalpha() for c in text)


def logits(ids, net, keep=None):
    """(T, languages, B) scores of every position."""
    forward = gru(ids, net["f"], None if keep is None else keep[0])
    backward = gru(ids[::-1], net["b"], None if keep is None else keep[1])[::-1]
    both = np.concatenate([forward, backward], axis=1)
    return np.matmul(net["o"]["w"], both) + net["o"]["bias"][:, None], both


def softmax(z, axis):
    z = np.exp(z - z.max(axis, keepdims=True))
    z /= z.sum(axis, keepdims=True)
    return z


def training_rows(docs, max_docs, max_chars):
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(remainder(F.col("doc_id"), 4) != 2).where("lang is not null and length(text) between 1 and " + str(int(max_chars)))
    return [r for r in sample(rows, max_docs) if has_letter(r["text"])]


def fit(docs, max_docs=3000, max_chars=20000, hidden=8, steps=600, batch=160, length=96, rate=0.02, seed=11):
    """{"langs", "f", "b", "o"}: languages drawn by the root of their share, windows at random."""
    rows = training_rows(docs, max_docs, max_chars)
    langs = sorted({r["lang"] for r in rows})
    rng = np.random.default_rng(seed)
    net = {"langs": langs, "f": init_gru(257, hidden, rng), "b": init_gru(257, hidden, rng),
           "o": {"w": rng.normal(0, 0.3, (len(langs), 2 * hidden)).astype(np.float32), "bias": np.zeros(len(langs), dtype=np.float32)}}
    if len(langs) < 2:
        return net
    texts = [[np.frombuffer(r["text"].encode(), dtype=np.uint8) for r in rows if r["lang"] == lang] for lang in langs]
    share = np.sqrt([len(t) for t in texts])
    share /= share.sum()
    adam = {k: Adam(net[k], rate) for k in ("f", "b", "o")}
    for step in range(steps):
        y = rng.choice(len(langs), batch, p=share)
        ids = np.full((length, batch), PAD, dtype=np.int64)
        for j, lang in enumerate(y):
            t = texts[lang][rng.integers(len(texts[lang]))]
            n, a = length, rng.integers(max(1, len(t) - length // 2))
            if rng.random() < 0.3:  # short texts, with padding around
                n, a = rng.integers(6, 48), 0 if rng.random() < 0.5 else a
            piece = t[a:a + n]
            ids[:len(piece), j] = piece
        keep = ([], [])
        z, both = logits(ids, net, keep)
        d = softmax(z, 1)
        d[:, y, np.arange(batch)] -= 1
        d *= (ids != PAD)[:, None, :] / np.float32((ids != PAD).sum())
        g_w = np.einsum("tlb,thb->lh", d, both, optimize=True)
        d_both = np.matmul(net["o"]["w"].T, d)
        decay = rate * min(1.0, 2 * (1 - step / steps))
        g = {"f": gru_gradient(ids, net["f"], keep[0], d_both[:, :hidden]), "b": gru_gradient(ids[::-1], net["b"], keep[1], d_both[::-1, hidden:]),
             "o": {"w": g_w, "bias": d.sum((0, 2))}}
        for k in g:
            adam[k].step({n: np.clip(v, -0.05, 0.05) for n, v in g[k].items()}, decay)
    return net


def document_probabilities(texts, net, block=2048):
    """(documents, languages): mean of the byte probabilities of each text (bytes)."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.cumsum(lengths) - lengths
    values = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64)
    owner, at = windows(lengths, CORE, CONTEXT)
    total = np.zeros((len(texts), len(net["langs"])))
    for i in range(0, len(owner), block):
        o = owner[i:i + block]
        ids, inside = symbols(values, offsets, lengths, o, at[i:i + block], CORE, CONTEXT, PAD)
        p = softmax(logits(ids, net)[0][CONTEXT:-CONTEXT], 1)
        p *= inside[CONTEXT:-CONTEXT, None, :]
        np.add.at(total, o, p.sum(0).T)
    return total / np.maximum(lengths, 1)[:, None]


SCORED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def score(docs, net):
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(iterator):
        for b in batches(iterator, 4 << 20):
            texts = b.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None and has_letter(t)] if net["langs"] else []
            lang, value = ["und"] * len(texts), [0.0] * len(texts)
            if known:
                p = document_probabilities([texts[i].encode() for i in known], net)
                for i, best, v in zip(known, p.argmax(1), np.clip(p.max(1), 0, 1)):
                    lang[i], value[i] = net["langs"][best], float(v)
            yield record(SCORED, doc_id=b.column(0), lang_pred=lang, score=value)

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def digest(scored):
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
