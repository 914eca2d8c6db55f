"""Statistics of growing prefixes against brute force over every prefix."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocast.functions.timeutil import HOUR, MINUTE
from stratocast.operators.chunked import chunked, prefix_scan, row_lag, time_chunk
from stratocast.operators.order_stats import running_quantiles
from stratocast.operators.shape import SHAPE, running_shape

KEYS = ["city", "ev"]


def series(seed, n=140, step=17):
    """Rows of two keys over several chunks, with repeated values, halves and equal times."""
    rng, rows = random.Random(seed), []
    for city, ev in (("a", 1), ("b", 2)):
        t, x = 0, 60.0
        for i in range(n):
            t += rng.choice([0, 5, step, step]) * MINUTE
            x += rng.choice([-2.5, -1, -0.5, 0, 0, 0.5, 1, 1, 1.5])
            rows.append((city, ev, t, i, x))
    rows += [("c", 3, 0, 0, 71.5), ("d", 4, HOUR, 0, None)]
    return rows


def plain_shape(x, step=5):
    """The definition over one list of values so far."""
    x, out = np.array(x), {}
    base = int(np.round(x.max()))
    for name, threshold in (("", base), ("_m1", base - 1), ("_p1", base + 1)):
        hits, best, run = x >= threshold, 0, 0
        for h in hits:
            run = run + 1 if h else 0
            best = max(best, run)
        out["minutes_ge_base" + name], out["max_run_ge_base" + name] = (int(hits.sum()) * step, best * step) if len(x) > 1 else (None, None)
    top = np.sort(x)[::-1]
    out["max_minus_second_max"] = float(top[0] - top[1]) if len(x) > 1 else None
    diffs = x[6:] - x[:-6] if len(x) >= 7 else []
    out["slope_max_30min_up_sofar"], out["slope_max_30min_down_sofar"] = (float(diffs.max()), float(diffs.min())) if len(diffs) else (None, None)
    k, held = [int(np.round(v)) for v in x], [base]
    runs = [[k[0], 0]]
    for v in k:
        if v != runs[-1][0]:
            runs.append([v, 0])
        runs[-1][1] += 1
    held = [v for v, n in runs if n >= 4]
    out["pred_plateau_20min_sofar"] = max(held) if held else base
    edge, at = max(1, len(x) // 10), int(np.argmax(x))
    out["edge_max_flag"] = int(at < edge or at >= len(x) - edge) if len(x) >= 3 else None
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shape_of_every_prefix(spark, seed):
    rows = series(seed)
    df = spark.createDataFrame(rows, "city string, ev int, us long, event_id int, x double").repartition(5)
    got = {(r.city, r.event_id): {c: r[c] for c in SHAPE} for r in running_shape(df, KEYS, "x").collect()}
    want = {}
    for city in "abc":
        own = [r for r in sorted(rows, key=lambda r: (r[2], r[3])) if r[0] == city]
        for i in range(len(own)):
            want[city, own[i][3]] = plain_shape([r[4] for r in own[:i + 1]])
    assert got == want


@pytest.mark.parametrize("inclusive,small", [(True, 10**6), (False, 10**6), (True, 120), (False, 0)])
def test_quantiles_at_every_cutoff(spark, inclusive, small):
    rows = series(7, 400, 3)
    df = spark.createDataFrame(rows, "city string, ev int, us long, event_id int, x double").repartition(5)
    cuts = [(c, e, t * 10 * MINUTE) for c, e in (("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)) for t in range(-1, 120)]
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = running_quantiles(df, spark.createDataFrame([*cuts, *cuts[:5]], "city string, ev int, us long"), KEYS, "us", "x", ps, inclusive, 3.0, small).collect()
    want = {}
    for c, e, t in cuts:
        seen = [r[4] for r in rows if r[0] == c and r[4] is not None and (r[2] <= t if inclusive else r[2] < t)]
        if seen:
            want[c, e, t] = np.percentile(seen, [100 * p for p in ps])
    assert len(got) == len(want)
    for r in got:
        assert r.q == pytest.approx(want[r.city, r.ev, r.us])


def test_quantiles_of_many_values(spark):
    """Thousands of distinct values: four digits."""
    df = spark.range(3000).selectExpr("'a' as city", "id * 60000000L as us", "double(id * 7919 % 3001) as x")
    cuts = spark.createDataFrame([("a", t * 60_000_000) for t in (0, 1, 37, 999, 2999, 5000)], "city string, us long")
    values = np.arange(3000) * 7919 % 3001
    got = [r for small in (0, 10**6) for r in running_quantiles(df, cuts, ["city"], "us", "x", [0.1, 0.5], width=100.0, small=small).collect()]
    assert len(got) == 12
    for r in got:
        assert r.q == pytest.approx(np.percentile(values[:r.us // 60_000_000 + 1], [10, 50]))
    assert running_quantiles(df.where("x < 0"), cuts, ["city"], "us", "x", [0.5]).count() == 0


def test_lag_and_exclusive_kinds_over_chunks(spark):
    rows = series(5)
    df = spark.createDataFrame(rows, "city string, ev int, us long, event_id int, x double")
    order = ["us", "event_id"]
    d = chunked(df, KEYS, time_chunk("us", 25 * MINUTE))
    d = prefix_scan(row_lag(d, order, "x", 6, "lag6"), KEYS, order, "_c", {"before": ("max_before", "x"), "n_before": ("count_before", "x"), "bits": ("xor", "event_id"), "upto": ("max", "x")})
    for city in "ab":
        own = sorted((r for r in rows if r[0] == city), key=lambda r: (r[2], r[3]))
        got = [tuple(r) for r in d.where(F.col("city") == city).orderBy(*order).select("lag6", "before", "n_before", "bits", "upto").collect()]
        bits = 0
        for i, r in enumerate(own):
            x = [q[4] for q in own[:i + 1]]
            bits ^= r[3]
            assert got[i] == (x[-7] if i >= 6 else None, max(x[:-1], default=None), i, bits, max(x))
