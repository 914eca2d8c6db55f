"""The conversation trie against a trie of nested prefixes in plain Python."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from stratocast.llm import turn_trie
from stratocast.llm.queries import ORACLE, QUERIES

from .cases import SF

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Output rows from the definition; equal turn numbers must not occur."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        convs[c] = tuple(own.get(first, [])[:h] + turns[h:])
    members, ends = {}, {}
    for c, turns in convs.items():
        ends.setdefault(turns, []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in members:
        w = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] = saved.get(k[:d], 0) + w
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in kids)
    said = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], said(k)) for k, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def conversations(seed, n=60, deep=40):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 200), n):
        for turn in rng.sample(range(30), rng.randint(1, 6)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "a b\tc", "", None, "é\x0bx y"])))
    for c in (300, 301, 340):
        rows += [(c, t, "user", f"turn {t % 3} of many" if c < 340 or t < 25 else "other") for t in range(deep)]
    return [*rows, (400, None, "user", "no number"), (400, 1, "user", "one"), (None, 1, "user", "no id"), (None, None, None, None)]


@pytest.mark.parametrize("height,slices", [(2, 1024), (3, 4), (16, 7)])
def test_trie_by_plain_prefixes(spark, monkeypatch, height, slices):
    monkeypatch.setattr(turn_trie, "SLICE", slices)
    rows = conversations(height)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "'x' as k1", "2 as conv").repartition(4)
    assert got(turn_trie.trie(df, height)) == plain(rows)


def test_many_members_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "PIECE", 8)
    rows = [(c, t, "user", "the same words" if t < 2 else f"own {c % 5}") for c in range(0, 400) for t in range(3)]
    assert got(turn_trie.digest(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_repeated_rows_empty_table_and_long_text(spark):
    long = "word " * 60_000
    rows = [(20, 0, "user", long), (21, 0, "user", "x"), (21, 1, "user", "y")]
    assert got(turn_trie.trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert turn_trie.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    # A repeated row is a turn of its own.
    twice = [(20, 0, "user", "a"), (20, 0, "user", "a"), (20, 1, "user", "b")]
    assert got(turn_trie.digest(spark.createDataFrame(twice, SCHEMA))) == plain([(20, 0, "user", "a"), (20, 1, "user", "a"), (20, 2, "user", "b")])


def test_query_and_oracle(spark):
    q = QUERIES["op13_depth_band_trie"](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cur = con.execute(ORACLE["op13_depth_band_trie"])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(r[names.index(c)] for c in COLUMNS) for r in cur.fetchall())
    assert got(q) == want == plain([tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
