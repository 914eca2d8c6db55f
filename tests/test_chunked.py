"""Chunked scans against plain Python, with chunks small enough to force carries."""

import random

from pyspark.sql import functions as F

from stratocast.operators.chunked import framed, numbered, prefix_scan, row_framed, runs, time_chunk


def series(n, seed, keys=("a", "b", None), hot=0.7):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        k = keys[0] if r.random() < hot else r.choice(keys)
        rows.append((k, r.randrange(0, 4 * n), i, r.choice([None, r.randrange(0, 9)])))
    return rows


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def expect(rows, inclusive=True):
    res = {}
    for k, rs in by_key(rows).items():
        for i, r in enumerate(rs):
            seen = rs[: i + 1] if inclusive else rs[:i]
            v = [x[3] for x in seen if x[3] is not None]
            later = [x[3] for x in rs[i:] if x[3] is not None]
            before = [x[3] for x in rs[:i] if x[3] is not None]
            res[r[2]] = (sum(v) if v else None, len(v), max(v) if v else None, min(v) if v else None, v[-1] if v else None,
                         v[0] if v else None, before[-1] if before else None, later[0] if later else None)
    return res


def test_prefix_scan_matches_brute_force(spark):
    for seed, width in ((1, 7), (2, 40), (3, 10_000)):
        rows = series(120, seed)
        df = spark.createDataFrame(rows, "k string, t long, id long, v long")
        specs = {n: (n, F.col("v")) for n in ("sum", "count", "max", "min", "last", "first", "prev", "next")}
        got = prefix_scan(df, ["k"], ["t", "id"], time_chunk("t", width), specs).collect()
        want = expect(rows)
        assert len(got) == len(rows)
        for r in got:
            assert tuple(r[n] for n in specs) == want[r.id], (seed, r)


def test_exclusive_scan_and_numbering(spark):
    rows = series(80, 5)
    df = spark.createDataFrame(rows, "k string, t long, id long, v long")
    got = prefix_scan(df, ["k"], ["t", "id"], time_chunk("t", 11), {"s": ("sum", F.col("v")), "l": ("last", F.col("v"))}, inclusive=False).collect()
    want = expect(rows, inclusive=False)
    assert all((r.s, r.l) == (want[r.id][0], want[r.id][4]) for r in got)
    rn = {r.id: r.rn for r in numbered(df, ["k"], ["t", "id"], time_chunk("t", 11)).collect()}
    for rs in by_key(rows).values():
        assert [rn[r[2]] for r in rs] == list(range(1, len(rs) + 1))


def test_frames_cross_chunk_borders(spark):
    rows = [("a", t, t, t % 5) for t in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v long")
    got = framed(df, ["k"], "t", ["t"], lambda w: {"s": F.sum("v").over(w.rangeBetween(-20, 0))}, 20, width=25).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.s == sum(x[3] for x in rows if r.t - 20 <= x[1] <= r.t)
    n = numbered(df, ["k"], ["t"], time_chunk("t", 25))
    lag = row_framed(n, ["k"], "rn", lambda w: {"p": F.lag("v", 6).over(w)}, 6, size=10).collect()
    for r in lag:
        assert r.p == (rows[r.rn - 7][3] if r.rn > 6 else None)


def test_runs_are_merged_across_chunks(spark):
    vals = [1, 1, 2, 2, 2, 2, 2, 2, None, None, 1, 3, 3]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(vals)], "k string, t long, v long")
    got = runs(df, ["k"], ["t"], time_chunk("t", 3), "v").groupBy("run_id").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n")).orderBy("run_id").collect()
    assert [(r.v, r.n) for r in got] == [(1, 2), (2, 6), (None, 2), (1, 1), (3, 2)]
