"""Improbable-feature fingerprints against loops over single windows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np

from stratocast.llm import improbable as im
from stratocast.llm.queries import QUERIES

from .cases import SF, edge_rows


def plain_class(window):
    total = sum(round(c * math.log2(c) * (1 << 20)) for c in Counter(window).values())
    full = 64 * 6 * (1 << 20)
    return 1000 - (total * 1000 + full // 2) // full


def plain_selected(text, rank):
    """Positions that win 16 runs of 64 positions, runs cut short at either end included."""
    cls = [plain_class(text[i:i + 64]) for i in range(len(text) - 63)]
    won = Counter()
    for start in range(-63, len(cls)):
        run = [(rank[cls[i]], i) for i in range(max(0, start), min(len(cls), start + 64)) if cls[i] > 0]
        if run:
            won[min(run)[1]] += 1
    return [i for i in sorted(won) if won[i] >= 16]


def samples():
    rng = random.Random(3)
    words = ["the", "rain", "falls", "on", "every", "plain", "42", "été", "漢字"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).encode()
    return [b"", b"short", prose(40), b"x" * 300, bytes(range(256)), prose(150), b"ab" * 100 + prose(20), prose(12)[:64], prose(13)[:65]]


def test_entropy_classes_by_single_windows():
    for text in samples():
        got = im.entropy_classes(np.frombuffer(text, dtype=np.uint8))
        assert got.tolist() == [plain_class(text[i:i + 64]) for i in range(max(0, len(text) - 63))]


def test_selection_by_single_runs_and_any_piece(monkeypatch):
    rank = np.random.default_rng(1).permutation(im.CLASSES)
    texts = samples()
    want = [plain_selected(t, rank) for t in texts]
    counts = im.counts(texts)
    for piece in (1 << 20, 97, 256):
        monkeypatch.setattr(im, "PIECE", piece)
        starts = np.cumsum([0, *[len(t) for t in texts]])
        assert [(a - s).tolist() for a, s in zip(im.selected(texts, rank), starts)] == want
        assert (im.counts(texts) == counts).all()
    seen = Counter(plain_class(t[i:i + 64]) for t in texts for i in range(len(t) - 63))
    assert counts.tolist() == [seen[c] if c else 0 for c in range(im.CLASSES)]
    assert im.selected([], rank) == [] and any(want)


def test_likeness():
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n)).encode()
    rank = np.arange(im.CLASSES)
    for n in (60, 400, 4000):
        a, b = text(n), text(n)
        half = a[:len(a) // 2] + b[:len(b) // 2]
        pa, pb, ph = im.prints([a, b, half], rank)
        assert im.likeness(pa, pa) == 1.0 and im.likeness(pa, pb) == im.likeness(pb, pa)
        assert im.likeness(pa, ph) > 0.15 > 0.05 > im.likeness(pa, pb)
        assert (im.chain(im.name(pa)) == pa).all()
        # Chained: one filter for every 160 features.
        assert len(pa) == -(-len({a[i:i + 64] for i in im.selected([a], rank)[0].tolist()}) // im.FULL)
    empty, one = im.prints([b"", b"x"], rank)
    assert im.likeness(empty, empty) == 1.0 and im.likeness(empty, one) == 0.0 and im.likeness(one, one) == 1.0


def test_bits_of_a_chain_by_sets():
    import xxhash
    rank, text = np.arange(im.CLASSES), samples()[5]
    features = list(dict.fromkeys(text[i:i + 64] for i in plain_selected(text, rank)))
    got = np.unpackbits(im.prints([text], rank)[0].view(np.uint8), axis=1)
    for k in range(0, len(features), 160):
        want = {(xxhash.xxh3_64_intdigest(f) >> (11 * j)) % 2048 for f in features[k:k + 160] for j in range(5)}
        assert set(np.flatnonzero(got[k // 160]).tolist()) == want


def check(rows, out, rank):
    """Every row against its next one in the stated order, one by one."""
    rows = [(i, t or "") for i, t in rows]
    got = sorted(out.collect(), key=str)
    printed = lambda t: im.prints([t.encode()], rank)[0]
    ordered = {}
    for i, t in rows:
        ordered.setdefault(i, []).append(t)
    ids = sorted((i for i in ordered if i is not None), reverse=True) + [None] * (None in ordered)
    assert sorted((r.doc_id, r.n_chars) for r in got if r.doc_id is not None) == sorted((i, len(t)) for i, t in rows if i is not None)
    for r in got:
        firsts = [t for t in ordered[ids[(ids.index(r.doc_id) + 1) % len(ids)]]]
        choices = [(t, n) for t in ordered[r.doc_id] for n in [*firsts, *ordered[r.doc_id]]
                   if len(t) == r.n_chars and hashlib.sha256(im.edited(t, n).encode()).hexdigest() == r.edited_sha256]
        assert any(r.fingerprint == im.name(printed(t)) and r.edited_fingerprint == im.name(printed(im.edited(t, n)))
                   and r.near_edited == im.likeness(printed(t), printed(im.edited(t, n))) and r.near_next == im.likeness(printed(t), printed(n)) for t, n in choices)


def test_next_rows_over_partitions(spark, documents):
    rows = [*edge_rows(), *[(100 + i, f"text number {i} " * (i % 7)) for i in range(60)], (-5, "the least id " * 20)]
    rank = np.arange(im.CLASSES)
    check(rows, im.against_next(documents(rows, extra=True).repartition(7), rank), rank)
    one = im.against_next(documents([(3, "only row " * 30)]), rank).collect()[0]
    assert one.near_next == 1.0 and one.n_chars == 270
    assert im.digest(documents([])).count() == 0


def test_next_of_each_document_exactly(spark, documents):
    rows = [(i, f"line {i} of {i * 37 % 11} " * (3 + i % 5)) for i in range(0, 90, 3)]
    got = {r.doc_id: r for r in im.digest(documents(rows).repartition(5)).collect()}
    by_id = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(by_id):
        n = by_id[(k + 1) % len(by_id)][1]
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[:len(t) - half] + n[:half]).encode()).hexdigest()


def test_query_separates_edited_from_next(spark, corpus):
    got = QUERIES["op12_improbable_features"](spark, SF).collect()
    assert len(got) == corpus[0].count()
    long = [r for r in got if r.n_chars >= 300]
    assert np.mean([r.near_edited > r.near_next or r.near_next == 1.0 for r in long]) > 0.97
    by_text = {}
    for r in corpus[0].collect():
        by_text.setdefault(r.text, set()).add(r.doc_id)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert all(len({prints[i] for i in ids}) == 1 for ids in by_text.values())
