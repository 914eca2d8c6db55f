"""Line quality by a linear-chain conditional random field, aggregated per document.

Every line is labelled good or bad. A line is described by shares of byte classes,
length and repetition, together with the same features of its two neighbours; a 2x2
table scores transitions. The exact marginals of forward-backward, weighted by line
length, average to the document's quality.

Fit: numpy on a bounded sample (``max_docs``, texts up to ``max_chars``), every line
inheriting its document's label. Scoring: all lines of every whole text; features come
from one vectorised pass over the bytes of an Arrow batch; no shuffle. Defined cases:
NULL text counts as empty, an empty text is one empty line, lines are cut at ``\\n``
only, a very long text is one long chain, repeated rows score alike, a NULL doc_id is
scored and not held out, no labels at all: score 0.5.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import Adam, batches, held_out, labelled, record


def _classes():
    groups = [range(97, 123), range(65, 91), range(48, 58), [32, 9], [46, 44], [33, 63], [124], [35, 36, 37, 38, 42, 64, 94, 126], range(128, 256)]
    c = np.full(256, len(groups), dtype=np.uint8)
    for i, g in enumerate(groups):
        c[list(g)] = i
    return c


CLASS = _classes()
N_CLASS = int(CLASS.max()) + 1
#: Class shares, log length, mean word length, immediate repetition of bytes and of words.
N_FEATURE = N_CLASS + 4
#: Word identity within a line: the sum of these over its bytes.
LETTER = np.random.default_rng(7).integers(1, 1 << 40, 256, dtype=np.int64)


def line_features(texts):
    """(features per line, line lengths, lines per text) of UTF-8 texts."""
    blob = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    lines = np.fromiter((t.count(b"\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    ends = np.flatnonzero(blob == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = ends - starts
    cls = CLASS[blob]
    scale = 1 / np.maximum(length, 1)

    def count(flags):
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return total[ends] - total[starts]

    cols = [count(cls == k) * scale for k in range(N_CLASS)]
    space = (cls == 3) | (blob == 10)
    close = space & np.concatenate([[False], ~space[:-1]])  # the byte after a word
    gaps = count(close)
    at = np.flatnonzero(close)
    total = np.cumsum(LETTER[blob] * ~space)[at]
    word = np.diff(total, prepend=0)
    again = np.zeros(len(blob), dtype=bool)
    again[at] = np.concatenate([[False], word[1:] == word[:-1]])
    same = count(np.concatenate([[False], blob[1:] == blob[:-1]]))
    cols += [np.log1p(length) / 5, np.minimum(length / (gaps + 1), 40) / 10, same * scale, count(again) / (gaps + 1)]
    return np.stack(cols, 1).astype(np.float32), length, lines


def emissions(feats, lines, model):
    """Score of "good" against "bad" per line from the line and its neighbours."""
    own = (feats - model["mean"]) / model["scale"]
    z = own @ model["w"] + model["b"][0]
    first = np.zeros(len(feats), dtype=bool)
    first[np.cumsum(lines) - lines] = True
    before = np.concatenate([[0], (own @ model["wp"])[:-1]])
    after = np.concatenate([(own @ model["wn"])[1:], [0]])
    last = np.concatenate([first[1:], [True]])
    return z + np.where(first, 0, before) + np.where(last, 0, after)


def marginals(z, trans):
    """P(good) for chains z (docs, T); positions beyond a chain's end hold NaN."""
    n, steps = z.shape
    real = ~np.isnan(z)
    e = np.ones((steps, n, 2))
    x = np.where(real, z, 0).T
    e[:, :, 1] = np.exp(np.minimum(x, 0))
    e[:, :, 0] = np.exp(np.minimum(-x, 0))
    a = np.exp(trans)
    alpha = np.empty_like(e)
    alpha[0] = e[0]
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for t in range(1, steps):
        f = (alpha[t - 1] @ a) * e[t]
        alpha[t] = f / f.sum(1, keepdims=True)
    beta = np.ones((n, 2))
    out = np.empty((steps, n))
    pair = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        g = alpha[t] * beta
        out[t] = g[:, 1] / g.sum(1)
        if t:
            h = e[t] * beta
            q = alpha[t - 1][:, :, None] * a[None] * h[:, None, :]
            q /= q.sum((1, 2), keepdims=True)
            pair += q[real[:, t]].sum(0)
            h = h @ a.T
            beta = np.where(real[:, t][:, None], h / h.sum(1, keepdims=True), 1.0)
    return out.T, pair


def _padded(values, lines, at, width):
    out = np.full((len(at), width), np.nan)
    col = np.arange(width)
    inside = col[None] < lines[at][:, None]
    start = (np.cumsum(lines) - lines)[at]
    out[inside] = values[(start[:, None] + col[None])[inside]]
    return out, inside


def fit(docs, labels, label="quality", max_docs=4000, max_chars=20000, rounds=120, rate=0.05, l2=1e-3):
    """CRF parameters by the gradient of the chains' log-likelihood."""
    rows = labelled(docs, labels, label, max_docs, max_chars)
    model = {"w": np.zeros(N_FEATURE), "wp": np.zeros(N_FEATURE), "wn": np.zeros(N_FEATURE), "b": np.zeros(1), "trans": np.zeros((2, 2)),
             "mean": np.zeros(N_FEATURE), "scale": np.ones(N_FEATURE)}
    if not rows:
        return model
    feats, _, lines = line_features([r["text"].encode() for r in rows])
    model["mean"], model["scale"] = feats.mean(0), feats.std(0) + 1e-3
    # Chains of the sample are cut at 32 lines: training stays short, scoring never cuts.
    pieces = np.concatenate([np.minimum(32, n - np.arange(0, n, 32)) for n in lines])
    y = np.repeat(np.array([r["y"] for r in rows], dtype=float), lines)
    own = (feats - model["mean"]) / model["scale"]
    order = np.arange(len(pieces))
    first = np.zeros(len(own), dtype=bool)
    first[np.cumsum(lines) - lines] = True
    last = np.concatenate([first[1:], [True]])
    prev = np.where(first[:, None], 0, np.concatenate([own[:1], own[:-1]]))
    nxt = np.where(last[:, None], 0, np.concatenate([own[1:], own[:1]]))
    yp, _ = _padded(y, pieces, order, 32)
    pairs = np.array([[np.nansum((yp[:, :-1] == i) & (yp[:, 1:] == j)) for j in (0, 1)] for i in (0, 1)], dtype=float)
    p = {k: model[k] for k in ("w", "wp", "wn", "b", "trans")}
    adam = Adam(p, rate)
    # Lines of one document share its label, so each document counts once, not per line.
    weight = np.repeat(1 / lines, lines) / len(rows)
    n_pairs = max(1.0, pairs.sum())
    for _ in range(rounds):
        z = emissions(feats, lines, model)
        zp, inside = _padded(z, pieces, order, 32)
        m, pair = marginals(zp, p["trans"])
        g = (m[inside] - y) * weight
        adam.step({"w": own.T @ g + l2 * p["w"], "wp": prev.T @ g + l2 * p["wp"], "wn": nxt.T @ g + l2 * p["wn"], "b": np.array([g.sum()]),
                   "trans": (pair - pairs) / n_pairs + 0.02 * p["trans"]})
    return model


def line_marginals(texts, model):
    """(P(good) per line, line lengths, lines per text)."""
    feats, length, lines = line_features(texts)
    z = emissions(feats, lines, model)
    good = np.empty(len(z))
    order = np.argsort(lines, kind="stable")
    at = 0
    while at < len(order):  # chains of like length together, at most 2^18 cells unless one chain has more
        width = int(lines[order[at]])
        n = 1
        while at + n < len(order) and lines[order[at + n]] <= width + max(4, width // 4) and (n + 1) * lines[order[at + n]] <= 1 << 18:
            n += 1
        pick = order[at:at + n]
        zp, inside = _padded(z, lines, pick, int(lines[pick].max()))
        m, _ = marginals(zp, model["trans"])
        start = (np.cumsum(lines) - lines)[pick]
        good[(start[:, None] + np.arange(zp.shape[1])[None])[inside]] = m[inside]
        at += n
    return good, length, lines


def document_scores(texts, model):
    """Length-weighted mean of P(good) of each text (bytes)."""
    return aggregated(*line_marginals(texts, model))


def aggregated(good, length, lines):
    cut = np.cumsum(lines) - lines
    weight = length + 1.0  # an empty line counts as one character
    return np.clip(np.add.reduceat(good * weight, cut) / np.add.reduceat(weight, cut), 0, 1)


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_lines", pa.int64()), ("bad_lines", pa.int64())])


def score(docs, model):
    """Per document: length-weighted mean of P(good), lines, and lines labelled bad."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(iterator):
        for b in batches(iterator, 4 << 20):
            good, length, lines = line_marginals(b.column(1).to_pylist(), model)
            cut = np.cumsum(lines) - lines
            yield record(SCORED, doc_id=b.column(0).to_pylist(), score=aggregated(good, length, lines), n_lines=lines, bad_lines=np.add.reduceat((good < 0.5).astype(np.int64), cut))

    return rows.mapInArrow(run, "doc_id long, score double, n_lines long, bad_lines long")


def digest(scored, threshold=0.3):
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                         "n_lines", "bad_lines")
