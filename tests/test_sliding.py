"""Trailing frames by windows and by merged partials against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocast.functions.timeutil import MINUTE
from stratocast.operators.rolling import acceleration, elapsed, time_stats
from stratocast.operators.sliding import Edge, Extreme, Moments, dense, sliding, slope, std
from stratocast.queries.registry import _spark_project


def rows_of(seed, n=500):
    """Two keys; bursts inside a minute, equal times, gaps, NULLs, equal values."""
    rng, out = random.Random(seed), []
    for city in "ab":
        t = rng.randint(0, 3) * MINUTE
        for i in range(n):
            t += rng.choice([0, 1, 1000, MINUTE // 7, MINUTE, MINUTE, 20 * MINUTE])
            out.append((city, i, t, rng.choice([None, 70.0, 70.0, rng.uniform(60, 80)]), float(rng.randint(0, 5))))
    return out


def plain(rows, city, t, minutes, own):
    rows = ((r[2], r[3], r[4]) for r in rows if r[0] == city)
    return sorted((r for r in rows if t - minutes * MINUTE <= r[0] and (r[0] <= t if own else r[0] < t)), key=lambda r: r[0])


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("partials", [True, False])
def test_frames_of_every_row(spark, own, partials):
    rows = rows_of(4)
    df = spark.createDataFrame(rows, "city string, i int, us long, x double, v double").repartition(5)
    specs = {f"{n}_{m}": (m, a) for m in (1, 7, 60) for n, a in (
        ("m", Moments(F.col("x"))), ("t", Moments(elapsed("us"), F.col("x"))), ("hi", Extreme("max", F.col("x"))), ("lo", Extreme("min", F.col("x"))),
        ("sum", Extreme("sum", F.col("v"))), ("first", Edge("v", "us")), ("last", Edge("x", "us", last=True, known=True)))}
    d = sliding(df, ["city"], "us", specs, own, partials)
    d = d.select("city", "i", "us", *[F.col(f"m_{m}.{k}").alias(f"{k}_{m}") for m in (1, 7, 60) for k in ("n", "x")], *[std(F.col(f"m_{m}")).alias(f"std_{m}") for m in (1, 7, 60)],
                 *[slope(F.col(f"t_{m}")).alias(f"slope_{m}") for m in (1, 7, 60)], *[F.col(f"{n}_{m}.v").alias(f"{n}_{m}") for m in (1, 7, 60) for n in ("hi", "lo", "sum")],
                 *[F.col(f"{n}_{m}.v.v").alias(f"{n}_{m}") for m in (1, 7, 60) for n in ("first", "last")])
    got = d.collect()
    assert len(got) == len(rows)
    near = lambda a, b: (a is None and b is None) or a == pytest.approx(b, abs=1e-7, rel=1e-7)
    for r in got:
        for m in (1, 7, 60):
            f = plain(rows, r.city, r.us, m, own)
            x = [q[1] for q in f if q[1] is not None]
            assert r[f"n_{m}"] == len(x) and near(r[f"x_{m}"], np.mean(x) if x else None)
            assert near(r[f"std_{m}"], np.std(x, ddof=1) if len(x) > 1 else None)
            assert near(r[f"hi_{m}"], max(x, default=None)) and near(r[f"lo_{m}"], min(x, default=None))
            assert near(r[f"sum_{m}"], sum(q[2] for q in f) if f else None)
            assert near(r[f"first_{m}"], min((q[2] for q in f if q[0] == f[0][0]), default=None) if f else None)
            late = [q for q in f if q[1] is not None]
            assert near(r[f"last_{m}"], max(q[1] for q in late if q[0] == late[-1][0]) if late else None)
            t = [(q[0] / MINUTE, q[1]) for q in f if q[1] is not None]
            if len(t) >= 2:
                a, b = np.array(t).T
                want = 0.0 if a.std() < 0.001 else np.cov(a, b)[0, 1] / np.var(a) * 60
                assert r[f"slope_{m}"] == pytest.approx(want, rel=1e-4, abs=1e-4)
            else:
                assert r[f"slope_{m}"] is None


def test_both_ways_agree_and_density_decides(spark):
    few = spark.range(400).selectExpr("'a' as city", f"id * {MINUTE // 3} as us", "double(id * 37 % 101) as x")
    many = spark.range(4000).selectExpr("'a' as city", f"id * {MINUTE // 300} as us", "double(id * 37 % 101) as x")
    assert not dense(few, ["city"], "us") and dense(many, ["city"], "us")
    for d in (few, many):
        a = {r.us: r for r in time_stats(d, ["city"], "us", "x", (3, 10)).collect()}
        for r in sliding(d, ["city"], "us", {"s": (3, Moments(F.col("x"))), "h": (10, Extreme("max", F.col("x")))}, partials=True).collect():
            assert r.s.x == pytest.approx(a[r.us].mean_3) and r.h.v == a[r.us].max_10


def test_empty(spark):
    d = spark.createDataFrame([], "city string, us long, x double")
    assert sliding(d, ["city"], "us", {"s": (5, Moments(F.col("x")))}).count() == 0


def test_acceleration_of_equal_times_and_of_small_spread(spark):
    """As SQL: 0 / 0 at one time, and a slope however close two times are."""
    at = [0] * 13 + [50, 40 * MINUTE, 40 * MINUTE]
    d = spark.createDataFrame([("a", 1_704_067_200_000_000 + t, i, 70.0 + i) for i, t in enumerate(at)], "city string, us long, i int, x double")
    got = {r.i: r for r in _spark_project(acceleration(d, ["city"], "us", "x"), [("i", "i"), ("rate", "h"), ("accel", "h")]).collect()}
    assert all(math.isnan(got[i].rate) for i in (*range(13), 14, 15)) and all(got[i].accel is None for i in range(14))
    f = np.array([(t / MINUTE, 70.0 + i) for i, t in enumerate(at[:14])]).T
    assert got[13].rate == pytest.approx(np.cov(f)[0, 1] / np.var(f[0]) * 60, rel=1e-4)
    assert math.isnan(got[14].accel) and math.isnan(got[15].accel)


def test_places_of_numbers_without_any(spark):
    d = spark.createDataFrame([(x,) for x in (math.nan, math.inf, 1e20, -1.25, None)], "x double")
    nan, *rest = [r.x for r in _spark_project(d, [("x", "f")]).collect()]
    assert math.isnan(nan) and rest == [math.inf, 1e20, -1.25, None]


def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """Rows of a task do not grow with the table, in both ways; results stay."""
    from stratocast.operators import chunked
    for gap in (MINUTE // 3, MINUTE // 300):
        d = spark.range(6000).selectExpr("if(id % 2 = 0, 'a', 'b') as city", f"id * {gap} as us", "double(id * 37 % 101) as x")
        run = lambda: sliding(d, ["city"], "us", {"h": (3, Extreme("max", F.col("x")))})
        monkeypatch.setattr(chunked, "TASK_ROWS", 200_000)
        want = sorted((r.us, r.h.v) for r in run().collect())
        monkeypatch.setattr(chunked, "TASK_ROWS", 500)
        few = run()
        assert few.rdd.getNumPartitions() >= 12
        assert sorted((r.us, r.h.v) for r in few.collect()) == want
