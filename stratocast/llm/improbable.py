"""Fingerprints of improbable features, chained Bloom filters and their likeness.

Every window of 64 bytes is a feature. Its entropy falls into one of 1,001 classes, whose
rarity is counted over all windows of all documents; in every run of 64 features the rarest
one (leftmost of equals) wins, and features that win 16 runs or more are selected. They go,
in order and each once, into Bloom filters of 2,048 bits and five hashes, a new one after
every 160 features. Likeness is the mean over the filters of the shorter chain of the best
overlap with a filter of the other, scaled between what chance gives and full overlap.

Entropy sums are integers, so a feature's class never depends on where a piece begins, and
pieces of a batch overlap by what a window and a run need: texts of any length are whole.

Defined cases: NULL text is empty; an empty text has the empty fingerprint, alike (1) to
itself and unlike (0) to any other; a text without a selected feature (under 64 bytes, or
one byte repeated) is one feature as a whole; rows are ordered by doc_id descending, NULL
last, then by a hash of the text (equal rows are interchangeable); a single row is its own
next; an empty table gives no rows; further columns do not take part.
"""

import base64
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import written
from .common import batches, record

WINDOW, RUN, LEAST_RUNS = 64, 64, 16
BITS, HASHES, FULL = 2048, 5, 160
CLASSES = 1001
PIECE = 1 << 20
NONE = np.iinfo(np.int64).max


@cache
def terms():
    """c * log2(c) for c = 0..64, in units of 2^-20."""
    c = np.arange(WINDOW + 1, dtype=np.float64)
    return np.rint(c * np.log2(np.maximum(c, 1)) * (1 << 20)).astype(np.int64)


def entropy_classes(x):
    """Class of the window that begins at each byte of ``x`` (uint8), len(x) - 63 of them.

    Equal bytes at distance 1..63 are counted once for both ends; sliding a window by one
    byte then changes its sum by table values alone.
    """
    n = len(x)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int32)
    after, before = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    for d in range(1, WINDOW):
        same = (x[:-d] == x[d:]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    f = terms()
    gain = f[1:] - f[:-1]
    first = int(f[np.bincount(x[:WINDOW], minlength=256)].sum())
    step = gain[before[WINDOW:]] - gain[after[:n - WINDOW]]
    total = np.concatenate([[first], first + np.cumsum(step)])
    # Entropy is 6 - total / 64 bits: 1,000 is all bytes different.
    return (1000 - (total * 1000 + f[WINDOW] // 2) // f[WINDOW]).astype(np.int32)


def pieces(x, halo):
    """(piece, first, start, end): slices of ``x`` with ``halo`` around their core [start, end)."""
    for start in range(0, len(x), PIECE):
        end = min(len(x), start + PIECE)
        first = max(0, start - halo)
        yield x[first:end + halo], first, start, end


def joined(texts):
    """(bytes, ends, whole): texts end to end, and whether the window at a byte lies in one text."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    whole = np.ones(int(ends[-1]) if len(ends) else 0, dtype=bool)
    start = 0
    for end in ends.tolist():
        whole[max(start, end - WINDOW + 1):end] = False
        start = end
    return np.frombuffer(b"".join(texts), dtype=np.uint8), ends, whole


def counts(texts):
    """Windows of each class; a window of one repeated byte has no information and is left out."""
    x, _, whole = joined(texts)
    out = np.zeros(CLASSES, dtype=np.int64)
    for piece, first, start, end in pieces(x, WINDOW - 1):
        c = entropy_classes(piece)[start - first:end - first]
        out += np.bincount(c[whole[start:start + len(c)]], minlength=CLASSES)
    out[0] = 0
    return out


def selected(texts, rank):
    """For each text the first bytes of its selected features, ascending. ``rank``: place of each class."""
    x, ends, whole = joined(texts)
    found = []
    for piece, first, start, end in pieces(x, WINDOW + RUN - 2):
        c = entropy_classes(piece)
        ok = whole[first:first + len(c)] & (c > 0)
        key = np.full(len(piece) + 2 * (RUN - 1), NONE)
        at = np.flatnonzero(ok)
        key[at + RUN - 1] = (rank[c[at]].astype(np.int64) << 40) | at
        # Runs of 1, 2, 4 ... 64 features; texts are 63 bytes without a feature apart, so no run meets two.
        for half in (1, 2, 4, 8, 16, 32):
            key = np.minimum(key[:-half], key[half:])
        won = np.bincount(key[key != NONE] & ((1 << 40) - 1), minlength=len(piece))
        at = np.flatnonzero(won >= LEAST_RUNS) + first
        found.append(at[(at >= start) & (at < end)])
    at = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    return np.split(at, np.searchsorted(at, ends[:-1])) if len(ends) else []


def filters(text, at, start):
    """Chained filters of a text as rows of 32 words; ``at``: features, counted from ``start``."""
    if not text:
        return np.zeros((0, BITS // 64), dtype=np.uint64)
    h = [xxhash.xxh3_64_intdigest(text[i:i + WINDOW]) for i in (at - start).tolist()] or [xxhash.xxh3_64_intdigest(text)]
    h = np.array(list(dict.fromkeys(h)), dtype=np.uint64)
    bits = np.zeros((-(-len(h) // FULL), BITS), dtype=np.uint8)
    for k in range(HASHES):
        bits[np.arange(len(h)) // FULL, ((h >> np.uint64(11 * k)) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def prints(texts, rank):
    """Chains of filters of byte strings."""
    at = selected(texts, rank)
    starts = np.cumsum([0, *[len(t) for t in texts]])
    return [filters(t, a, s) for t, a, s in zip(texts, at, starts)]


def name(chain):
    """A chain as text."""
    return base64.b64encode(chain.tobytes()).decode()


def chain(fingerprint):
    return np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint64).reshape(-1, BITS // 64)


def best(a, b, part=16):
    """For each filter of ``a`` its best scaled overlap with a filter of ``b``."""
    ones_a, ones_b = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    out = np.zeros(len(a))
    for i in range(0, len(a), part):
        for j in range(0, len(b), 64 * part):
            x, y = a[i:i + part], b[j:j + 64 * part]
            both = np.bitwise_count(x[:, None] & y[None]).sum(2, dtype=np.int64)
            n, m = ones_a[i:i + part, None], ones_b[None, j:j + 64 * part]
            most, chance = np.minimum(n, m), n * m / BITS
            floor = chance + 0.3 * (most - chance)
            score = np.where(most > floor, (both - floor) / np.maximum(most - floor, 1e-9), 1.0)
            out[i:i + part] = np.maximum(out[i:i + part], score.max(1))
    return np.clip(out, 0.0, 1.0)


def likeness(a, b):
    """0 to 1; symmetric: chains of equal length are compared both ways."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if len(a) == len(b):
        return float((best(a, b).mean() + best(b, a).mean()) / 2)
    return float(best(a, b).mean() if len(a) < len(b) else best(b, a).mean())


def binary(docs):
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def ranks(docs):
    """Place of every entropy class by rarity over all windows of all documents (1,001 numbers)."""
    schema = pa.schema([("cls", pa.int32()), ("n", pa.int64())])

    def run(iterator):
        total = np.zeros(CLASSES, dtype=np.int64)
        for b in batches(iterator, 4 << 20):
            total += counts(b.column(1).to_pylist())
        has = np.flatnonzero(total)
        yield record(schema, cls=has.astype(np.int32), n=total[has])

    rows = binary(docs).mapInArrow(run, "cls int, n long").groupBy("cls").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(CLASSES, dtype=np.int64)
    for r in rows:
        seen[r.cls] = r.n
    return np.lexsort((np.arange(CLASSES), seen)).argsort()


def fingerprints(docs, rank):
    """(doc_id, fingerprint) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(iterator):
        for b in batches(iterator, 4 << 20):
            yield record(schema, doc_id=b.column(0), fingerprint=[name(c) for c in prints(b.column(1).to_pylist(), rank)])

    return binary(docs).mapInArrow(run, "doc_id long, fingerprint string")


def edited(own, following):
    """``own`` with its last half replaced by the beginning of ``following`` (code points)."""
    half = len(own) // 2
    return own[:len(own) - half] + following[:half]


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
          ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(rows, rank):
    """Digest columns of (doc_id, text, next text) triples."""
    own, following = [t for _, t, _ in rows], [n for _, _, n in rows]
    made = [edited(t.decode(), n.decode()).encode() for t, n in zip(own, following)]
    # A text is the next one of the row before: each is fingerprinted once.
    distinct = list(dict.fromkeys([*own, *following, *made]))
    known = dict(zip(distinct, prints(distinct, rank)))
    of = lambda texts: [known[t] for t in texts]
    return {"doc_id": [r[0] for r in rows], "n_chars": [len(t.decode()) for t in own], "edited_sha256": [hashlib.sha256(t).hexdigest() for t in made],
            "fingerprint": [name(c) for c in of(own)], "edited_fingerprint": [name(c) for c in of(made)],
            "near_edited": [likeness(a, b) for a, b in zip(of(own), of(made))], "near_next": [likeness(a, b) for a, b in zip(of(own), of(following))]}


def against_next(docs, rank):
    """Digest of every row against the next one in descending order of doc_id.

    Texts move once, dealt by ranges of the order; within a partition the next row is the
    next of the stream. Only the first and the last row of each partition are kept with their
    texts and paired by a join over partitions; the last partition meets the first.
    """
    tie, salt = F.xxhash64("text"), F.monotonically_increasing_id()
    order = [F.desc_nulls_last("doc_id"), F.asc("_tie"), F.asc("_salt")]
    rows = binary(docs).withColumns({"_tie": tie, "_salt": salt}).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    edge = [("part", pa.int32()), ("head", pa.binary()), ("tail", pa.binary())]
    schema = pa.schema(FIELDS + edge)
    blank = [n for n, _ in FIELDS]

    def run(iterator):
        part, held = TaskContext.get().partitionId(), None
        nothing = lambda n: {"part": [None] * n, "head": [None] * n, "tail": [None] * n}
        for b in batches(iterator, 2 << 20):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            if held is None:
                yield record(schema, **{n: [None] for n in blank}, part=[part], head=[texts[0]], tail=[None])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            if len(ids) > 1:
                yield record(schema, **compared(list(zip(ids[:-1], texts[:-1], texts[1:])), rank), **nothing(len(ids) - 1))
            held = ids[-1], texts[-1]
        if held is not None:
            yield record(schema, **{n: [held[0]] if n == "doc_id" else [None] for n in blank}, part=[part], head=[None], tail=[held[1]])

    done = written(rows.mapInArrow(run, f"{DIGEST}, part int, head binary, tail binary"), "improbable")
    heads = done.where("head is not null").select("part", "head")
    # One row for each partition.
    every = Window.partitionBy()
    parts = heads.select("part").withColumn("_next", F.coalesce(F.lead("part").over(every.orderBy("part")), F.min("part").over(every)))
    tails = done.where("tail is not null").select("part", "doc_id", "tail").join(parts, "part")
    tails = tails.join(heads.select(F.col("part").alias("_next"), "head"), "_next").select("doc_id", "tail", "head")

    def last(iterator):
        for b in batches(iterator, 2 << 20):
            yield record(pa.schema(FIELDS), **compared(list(zip(*[c.to_pylist() for c in b.columns])), rank))

    return done.where("part is null").select(*blank).unionByName(tails.mapInArrow(last, DIGEST))


def digest(docs):
    return against_next(docs, ranks(docs))
