"""Fill-in-middle over frames against plain string slices."""

import hashlib
import random
import re

import pytest

from stratocast.llm import frames
from stratocast.llm.queries import ORACLE, QUERIES

from .cases import SF, edge_rows


def plain(doc_id, text, seed=7, rate=100, spm=50):
    """(n, form, prefix_chars, middle_chars, output) straight from the definition."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(rows, out):
    want = sorted(((i, *plain(i, t or "")[:4], hashlib.sha256(plain(i, t or "")[4].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in out.collect()), key=str) == want


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_frames_are_seekable(size):
    rng = random.Random(size)
    for _ in range(60):
        text = "".join(rng.choice(["\n", "a", "é", "漢", "😀", "bc d"]) for _ in range(rng.randint(0, 60)))
        raw, units = text.encode(), re.findall(r"[^\n]*\n|[^\n]+", text)
        f = frames.Frames.store([raw[i:i + 5] for i in range(0, len(raw), 5)], size)
        assert f.total(f.units) == len(units) and f.total(f.chars) == len(text) and b"".join(f.all()) == raw
        assert all(len(f.open(i)) <= size for i in range(len(f.data)))
        for k in range(len(units) + 2):
            before, head = f.opened, "".join(units[:k])
            assert f.cut(k) == (len(head.encode()), len(head)) and f.opened - before <= 1
        a, b = sorted(rng.randint(0, len(raw)) for _ in range(2))
        assert b"".join(f.read(a, b)) == raw[a:b]
        for m in (b"\nbc", b"a\n", "é".encode(), b"<P>"):
            assert f.find(m, a) == raw.find(m, a)


@pytest.mark.parametrize("size", [2, 5, 1 << 16])
def test_arranged_and_restored(size):
    rng = random.Random(size)
    seen = set()
    for doc_id in range(150):
        text = "".join(rng.choice(["\n", "a<", "P>", "S", "<M", "é", "漢 x\n"]) for _ in range(rng.randint(0, 40)))
        stored = frames.Frames.store([text.encode()], size)
        form, prefix, middle, out = frames.arrange(stored, doc_id, rate=80, size=size)
        want = plain(doc_id, text, rate=80)
        assert (form, prefix, middle, b"".join(out.all()).decode()) == want[1:]
        assert out.sha256(*frames.ranges(out, form)) == hashlib.sha256(text.encode()).hexdigest()
        seen.add(form)
    assert seen == {"plain", "psm", "spm"}


def test_edge_rows_and_extra_columns(spark, documents):
    rows = [*edge_rows(), (9, "a\n\n\nb\n"), (10, "holds <S> already\n"), (11, "\n"), (12, "line\r\nnext same line\n")]
    docs = documents(rows, extra=True).withColumnRenamed("score", "frames").withColumnRenamed("fp", "form").repartition(3)
    check(rows, frames.digest(frames.fill_in_middle(frames.stored(docs))))
    check(rows, frames.digest(frames.fill_in_middle(frames.stored(docs, 100), size=64)))
    assert frames.digest(frames.fill_in_middle(frames.stored(documents([])))).count() == 0
    texts = {(r.doc_id, r.text) for r in frames.text(frames.fill_in_middle(frames.stored(docs))).collect()}
    assert texts == {(i, plain(i, t or "")[4]) for i, t in rows}


def test_query_by_definition(spark, corpus):
    check([(r.doc_id, r.text) for r in corpus[0].collect()], QUERIES["op11_seekable_fill_in_middle"](spark, SF))
    assert "op11_seekable_fill_in_middle" in ORACLE
