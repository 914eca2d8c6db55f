"""Personal data by patterns and a character BiLSTM with CRF transitions.

The base are four exact patterns (email, ip, card, phone). A bidirectional LSTM reads
the characters of overlapping windows in both directions, a linear-chain CRF scores
label transitions, and the best path of every window is decoded; where windows overlap,
a position takes the label of the window in which it lies deeper, and runs of one label
over the whole text become spans. A network span is added if, without blanks and
punctuation at its ends, it touches no base span, has ``min_length`` (7) or more
characters and, unless it is an email, holds an ASCII digit; base spans always stay.

Trained in numpy on windows of a bounded sample (``max_docs``, texts up to
``max_chars``), labelled by the base spans, whose digits are redrawn at random so that
the network learns shapes and not numbers. Every character of every whole text is read.
A window keeps the label "outside" throughout without decoding only if that is proven
best: no character's margin can pay for any transition.

Defined cases: NULL text counts as empty and has no spans; texts of any length, with
one run of digits or letters of any length (all patterns are linear); repeated rows get
equal spans; a NULL doc_id is kept; a sample without personal data leaves the base alone.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import Adam, batches, record, rewrite, sample
from .recurrent import init_lstm, lstm, lstm_gradient, symbols, windows

KINDS = ["email", "ip", "card", "phone"]
CORE, CONTEXT, OTHER, PAD = 224, 32, 128, 129

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match never starts inside a run of digits: if its first digit fails, so do the others.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text):
    """Leftmost non-overlapping matches: each begins with the run of local letters before an @."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL_LETTER[min(ord(text[start - 1]), 128)]:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1  # a run cannot reach over an @
        at = text.find("@", max(free, at + 1))
    return out


LOCAL_LETTER = [bool(LOCAL.fullmatch(chr(i))) for i in range(128)] + [False]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text):
    """[(start, kind index, end)] of the four patterns, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def letters(text):
    """Symbols of a text: ASCII as it is, anything else one symbol."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), OTHER).astype(np.int64)


def emissions(ids, net, keep=None):
    forward = lstm(ids, net["f"], None if keep is None else keep[0])
    backward = lstm(ids[::-1], net["b"], None if keep is None else keep[1])[::-1]
    both = np.concatenate([forward, backward], axis=1)
    return np.matmul(net["o"]["w"], both) + net["o"]["bias"][:, None], both


def crf_gradient(e, y, trans):
    """(d log-likelihood loss / d emissions, d / d transitions) of chains (T, K, B)."""
    steps, k, width = e.shape
    x = np.exp(e - e.max(1, keepdims=True)).astype(np.float64)
    a = np.exp(trans.astype(np.float64))
    alpha = np.empty_like(x)
    alpha[0] = x[0] / x[0].sum(0)
    for t in range(1, steps):
        f = (a.T @ alpha[t - 1]) * x[t]
        alpha[t] = f / f.sum(0)
    beta = np.ones((k, width))
    d, pair = np.empty_like(x), np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        g = alpha[t] * beta
        d[t] = g / g.sum(0)
        if t:
            h = x[t] * beta
            q = alpha[t - 1][:, None] * a[:, :, None] * h[None]
            pair += (q / q.sum((0, 1))).sum(2)
            beta = a @ h
            beta /= beta.sum(0)
    cols = np.arange(width)
    for t in range(steps):
        d[t, y[t], cols] -= 1
    np.subtract.at(pair, (y[:-1], y[1:]), 1)
    n = steps * width
    return (d / n).astype(np.float32), (pair / n).astype(np.float32)


def viterbi(e, trans):
    """Best label paths (T, B) of emissions (T, K, B)."""
    steps, k, width = e.shape
    best = np.empty_like(e)
    best[0] = e[0]
    for t in range(1, steps):
        best[t] = (best[t - 1][:, None] + trans[:, :, None]).max(0) + e[t]
    path = np.empty((steps, width), dtype=np.uint8)
    path[-1] = best[-1].argmax(0)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = (best[t - 1] + trans[:, path[t]]).argmax(0)
    return path


def fit(docs, max_docs=1500, max_chars=20000, hidden=8, steps=350, batch=128, length=96, rate=0.02, seed=5):
    """Network weights, or None where the sample holds no personal data."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = sample(rows.where(f"doc_id is not null and length(text) between 1 and {int(max_chars)}").where("text rlike '@|[0-9][0-9]'"), max_docs)
    texts = [(letters(r["text"]), base_spans(r["text"])) for r in rows]
    marked = [i for i, (_, s) in enumerate(texts) if s]
    if not marked:
        return None
    rng = np.random.default_rng(seed)
    k = len(KINDS) + 1
    net = {"f": init_lstm(130, hidden, rng), "b": init_lstm(130, hidden, rng), "o": {"w": rng.normal(0, 0.3, (k, 2 * hidden)).astype(np.float32), "bias": np.zeros(k, np.float32)},
           "t": {"trans": np.zeros((k, k), np.float32)}}
    by_kind = {}
    for i in marked:
        for s in texts[i][1]:
            by_kind.setdefault(s[1], []).append((i, s))
    kinds = sorted(by_kind)
    adam = {n: Adam(net[n], rate) for n in net}
    for step in range(steps):
        ids, y = np.full((length, batch), PAD, np.int64), np.zeros((length, batch), np.int64)
        for j in range(batch):
            if j % 2:
                i, (a, _, _) = by_kind[kinds[j // 2 % len(kinds)]][rng.integers(len(by_kind[kinds[j // 2 % len(kinds)]]))]
                start = max(0, a - int(rng.integers(0, length // 2)))
            else:
                i = int(rng.integers(len(texts)))
                start = int(rng.integers(max(1, len(texts[i][0]) - length // 2)))
            x, spans = texts[i]
            piece = x[start:start + length].copy()
            for a, kind, b in spans:
                a, b = max(0, a - start), min(length, b - start)
                if a < b:
                    y[a:b, j] = kind + 1
                    digit = (piece[a:b] >= 48) & (piece[a:b] <= 57)
                    piece[a:b][digit] = rng.integers(48, 58, int(digit.sum()))
            ids[:len(piece), j] = piece
        keep = ([], [])
        e, both = emissions(ids, net, keep)
        d, d_trans = crf_gradient(e, y, net["t"]["trans"])
        d_both = np.matmul(net["o"]["w"].T, d)
        g = {"f": lstm_gradient(ids, net["f"], keep[0], d_both[:, :hidden]), "b": lstm_gradient(ids[::-1], net["b"], keep[1], d_both[::-1, hidden:]),
             "o": {"w": np.einsum("tkb,thb->kh", d, both, optimize=True), "bias": d.sum((0, 2))}, "t": {"trans": d_trans}}
        for n in g:
            adam[n].step({m: np.clip(v, -0.05, 0.05) for m, v in g[n].items()}, rate * min(1.0, 2 * (1 - step / steps)))
    return net


def network_labels(values, lengths, net, block=1536):
    """Labels of all characters of concatenated texts, windows reconciled."""
    offsets = np.cumsum(lengths) - lengths
    out = np.zeros(len(values), dtype=np.uint8)
    trans = net["t"]["trans"]
    # Most that leaving "outside" can gain in transitions, per character outside it.
    gain = 2 * max(0.0, float(trans.max() - trans[0, 0]))
    owner, at = windows(lengths, CORE, CONTEXT)
    for i in range(0, len(owner), block):
        o, a = owner[i:i + block], at[i:i + block]
        ids, inside = symbols(values, offsets, lengths, o, a, CORE, CONTEXT, PAD)
        e, _ = emissions(ids, net)
        open_ = ((e[:, 1:].max(1) - e[:, 0]).max(0) + gain >= 0).nonzero()[0]
        if len(open_):
            path = viterbi(e[:, :, open_], trans)[CONTEXT:-CONTEXT]
            where = (np.arange(CORE)[:, None] + (a + offsets[o])[open_][None])
            use = inside[CONTEXT:-CONTEXT, open_] & (path > 0)
            out[where[use]] = path[use]
    return out


def runs(labels, lengths):
    """[(start, kind index, end)] per text from labels of concatenated texts."""
    out = [[] for _ in lengths]
    ends = np.cumsum(lengths)
    at = np.flatnonzero(labels)
    if len(at):
        doc = np.searchsorted(ends, at, side="right")
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(labels[at].astype(int)) != 0) | (np.diff(doc) != 0)]))
        for a, b in zip(cut, np.append(cut[1:], len(at))):
            begin = ends[doc[a]] - lengths[doc[a]]
            out[doc[a]].append((int(at[a] - begin), int(labels[at[a]]) - 1, int(at[b - 1] + 1 - begin)))
    return out


def find(texts, net, min_length=7):
    """[(start, kind index, end, is base)] per text, sorted by start, then kind."""
    found = [base_spans(t) for t in texts]
    added = [[] for _ in texts]
    if net is not None:
        values = [letters(t) for t in texts]
        lengths = np.array([len(v) for v in values], dtype=np.int64)
        for i, spans in enumerate(runs(network_labels(np.concatenate([*values, np.zeros(0, np.int64)]), lengths, net), lengths)):
            for a, kind, b in spans:
                piece = texts[i][a:b]
                b, a = b - len(piece) + len(piece.rstrip(" ,.;:\n\t")), a + len(piece) - len(piece.lstrip(" ,.;:\n\t"))
                if b - a >= min_length and (KINDS[kind] == "email" or any(c in "0123456789" for c in texts[i][a:b])) and not any(a < y and x < b for x, _, y in found[i]):
                    added[i].append((a, kind, b))
    return [sorted([(*s, True) for s in f] + [(*s, False) for s in x]) for f, x in zip(found, added)]


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
FOUND = pa.schema([("doc_id", pa.int64()), ("spans", SPAN)])


def spans(docs, net):
    """(doc_id, spans array<struct<kind, start, end, base>>), positions in code points."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(iterator):
        for b in batches(iterator, 2 << 20):
            found = find(b.column(1).to_pylist(), net)
            yield record(FOUND, doc_id=b.column(0), spans=[[{"kind": KINDS[k], "start": a, "end": e, "base": base} for a, k, e, base in f] for f in found])

    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def redact(docs, net):
    """Documents with every span replaced by <KIND>; overlapping spans become one."""

    def mask(texts, same):
        out = []
        for text, found in zip(texts, find(texts, net)):
            pieces, at = [], 0
            for a, kind, b, _ in found:
                if a >= at:
                    pieces += [text[at:a], f"<{KINDS[kind].upper()}>"]
                at = max(at, b)
            out.append("".join(pieces) + text[at:] if found else same)
        return out

    return rewrite(docs, mask, 2 << 20)


def digest(found):
    base = F.filter("spans", lambda s: s["base"])

    def said(x):
        return F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said("spans").alias("spans"))
