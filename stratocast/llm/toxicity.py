"""Toxicity by multiple-instance learning: sentences are instances, documents are bags.

A sentence's probability is a logistic function of its words; a document's is their
noisy-or, 1 - prod(1 - p). Only documents carry labels: the gradient of the document's
likelihood reaches each sentence in the measure that the noisy-or blames it, so the
sentence scores come out of document labels alone and locate what offends.

Fit: numpy on a bounded sample of labelled rows (``max_docs``, texts up to
``max_chars``). Scoring: every whole text, sentence by sentence, in Arrow batches; no
shuffle. Defined cases: NULL text counts as empty, an empty text is one empty sentence
(the bias alone), a text without sentence ends is one sentence, repeated rows are
scored alike, a NULL doc_id is scored and not held out, no labels at all: bias only.
"""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import Adam, batches, held_out, labelled, record

SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
WORD = re.compile(r"[^\W_]+")


def features(sentence):
    """Words and, for compounds and inflections, their first four and five letters."""
    found = WORD.findall(sentence.lower())
    return found + [w[:4] + "*" for w in found] + [w[:5] + "*" for w in found]


def fit(docs, labels, label="toxic", max_docs=6000, max_chars=20000, min_docs=5, min_z=4.0, rounds=150, rate=0.05, l2=1e-4):
    """(bias, {feature: weight}) from document labels.

    Features in at least ``min_docs`` sampled documents whose share of positive
    documents lies ``min_z`` standard deviations off the mean take part.
    """
    rows = labelled(docs, labels, label, max_docs, max_chars)
    seen, hits, bags = {}, {}, []
    for r in rows:
        bag = [features(s) for s in SENTENCE.findall(r["text"])] or [[]]
        bags.append(bag)
        for w in {w for s in bag for w in s}:
            seen[w] = seen.get(w, 0) + 1
            hits[w] = hits.get(w, 0) + r["y"]
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return (-6.0 if not len(y) or y[0] == 0 else 6.0), {}
    mean = y.mean()
    keep = [w for w, n in seen.items() if n >= min_docs and abs(hits[w] - n * mean) >= min_z * math.sqrt(n * mean * (1 - mean))]
    vocab = {w: i for i, w in enumerate(sorted(keep))}
    of_doc = np.array([i for i, b in enumerate(bags) for _ in b])
    flat = [(i, vocab[w]) for i, s in enumerate(s for b in bags for s in b) for w in s if w in vocab]
    of_sentence, ids = np.array(flat, dtype=np.int64).reshape(-1, 2).T
    p = {"w": np.zeros(len(vocab)), "b": np.array([-4.0])}
    adam = Adam(p, rate)
    for _ in range(rounds):
        z = p["b"][0] + np.bincount(of_sentence, p["w"][ids], minlength=len(of_doc))
        none = np.bincount(of_doc, np.logaddexp(0, z), minlength=len(y))  # -log of "no sentence offends"
        blame = np.where(y > 0, -1 / np.expm1(np.maximum(none, 1e-9)), 1.0)
        g = blame[of_doc] / (1 + np.exp(-z)) / len(y)
        adam.step({"w": np.bincount(ids, g[of_sentence], minlength=len(vocab)) + l2 * p["w"], "b": np.array([g.sum()])})
    return float(p["b"][0]), {w: float(p["w"][i]) for w, i in vocab.items() if abs(p["w"][i]) > 0.01}


def log_none(text, bias, weights):
    """Sum over sentences of log(1 + exp(logit)), and the worst sentence (logit, start, end)."""
    total, worst = 0.0, (-math.inf, 0, 0)
    get, base = weights.get, math.log1p(math.exp(bias))
    for m in SENTENCE.finditer(text):
        found = [x for x in map(get, features(m.group())) if x is not None]
        if found:
            z = bias + sum(found)
            total += z if z > 30 else math.log1p(math.exp(z))
        else:
            z, total = bias, total + base
        if z > worst[0]:
            worst = (z, *m.span())
    return (total, worst) if worst[0] > -math.inf else (base, (bias, 0, 0))


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("worst_start", pa.int64()), ("worst_end", pa.int64()), ("worst_score", pa.float64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("sentence", pa.string()), ("score", pa.float64())])


def _texts(docs):
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def score(docs, model):
    """Per document: score, and the most offending sentence as code points [start, end)."""
    bias, weights = model

    def run(iterator):
        for b in batches(iterator):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            found = [log_none(t, bias, weights) for t in texts]
            yield record(SCORED, doc_id=ids, score=[-math.expm1(-n) for n, _ in found], worst_start=[w[1] for _, w in found],
                         worst_end=[w[2] for _, w in found], worst_score=[1 / (1 + math.exp(-max(w[0], -700))) for _, w in found])

    return _texts(docs).mapInArrow(run, "doc_id long, score double, worst_start long, worst_end long, worst_score double")


def offending(docs, model, threshold=0.5):
    """Every sentence whose own probability reaches the threshold, with its span."""
    bias, weights = model

    def run(iterator):
        for b in batches(iterator):
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for m in SENTENCE.finditer(t):
                    p = 1 / (1 + math.exp(-max(-700, bias + sum(weights.get(w, 0.0) for w in features(m.group())))))
                    if p >= threshold:
                        out.append((i, *m.span(), m.group(), p))
            c = list(zip(*out)) or [[]] * 5
            yield record(FOUND, doc_id=c[0], start=c[1], end=c[2], sentence=c[3], score=c[4])

    return _texts(docs).mapInArrow(run, "doc_id long, start long, end long, sentence string, score double")


def digest(scored):
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         "worst_start", "worst_end", "worst_score")
