"""Statistics at cutoffs against the definition over each prefix and against frames of every row."""

import pytest
from pyspark.sql import functions as F
from test_running import KEYS, plain_shape, series

from stratocast.features.groups import at_cutoffs, observed, shape, trailing
from stratocast.functions.timeutil import MINUTE
from stratocast.operators.cutoffs import first_cutoff, frames_at
from stratocast.operators.shape import SHAPE, shape_at
from stratocast.operators.sliding import Edge, Extreme, Moments, sliding
from stratocast.plans import datasets as D


@pytest.mark.parametrize("inclusive", [True, False])
def test_shape_at_cutoffs(spark, inclusive):
    rows = series(4)
    df = spark.createDataFrame(rows, "city string, ev int, us long, event_id int, x double").where("x is not null").repartition(5)
    cuts = [(c, e, t * 45 * MINUTE) for c, e in (("a", 1), ("b", 2), ("c", 3), ("e", 5)) for t in range(30)]
    seen = first_cutoff(df, spark.createDataFrame(cuts, "city string, ev int, _cut long"), KEYS, inclusive=inclusive)
    want, base, last = {}, [], {}
    for c, e, t in cuts:
        own = [r[4] for r in sorted(rows, key=lambda r: (r[2], r[3])) if r[0] == c and (r[2] <= t if inclusive else r[2] < t)]
        if own and last.get(c) != len(own):
            want[c, t] = plain_shape(own)
            base.append((c, e, t, round(max(own))))
        last[c] = len(own)
    seen = seen.join(spark.createDataFrame(base, "city string, ev int, _cut long, b long"), [*KEYS, "_cut"])
    for slot in (7 * MINUTE, 360 * MINUTE):
        assert {(r.city, r._cut): {c: r[c] for c in SHAPE} for r in shape_at(seen, KEYS, "x", "b", slot=slot).collect()} == want


def test_frames_at_some_rows(spark):
    df = spark.createDataFrame(series(6), "city string, ev int, us long, event_id int, x double")
    df = df.withColumn("y", F.when(F.col("event_id") % 5 > 0, F.col("x") * 2)).repartition(5)
    t = F.col("us") / MINUTE
    specs = {"a": (30, Moments(F.col("y"))), "b": (120, Moments(t, F.col("y"))), "c": (30, Extreme("max", F.col("y"))), "d": (120, Extreme("sum", F.col("y"))), "e": (30, Edge("x", "us"))}
    at = df.where("event_id % 7 = 3").select("city", "us")
    flat = lambda d: {(r.city, r.us): [r[n][k] for n, k in (("a", "n"), ("a", "x"), ("a", "xx"), ("b", "n"), ("b", "y"), ("b", "xy"), ("c", "v"), ("d", "v"))] + [r["e"]["v"]["v"]] for r in d.collect()}
    want, got = flat(sliding(df.join(at.distinct(), ["city", "us"]), ["city"], "us", specs) if False else sliding(df, ["city"], "us", specs).join(at.distinct(), ["city", "us"])), flat(frames_at(df, at, ["city"], "us", specs))
    assert set(want) == set(got) and len(want) > 30
    for k in want:
        assert got[k] == [None if v is None else pytest.approx(v, abs=1e-9) for v in want[k]]


def test_groups_hold_no_more_rows_than_snapshots(spark, tables):
    """However dense the observations are, a group of one snapshot per event has one row per event."""
    s = D.hourly(tables.settle, 23, 23)
    ctx = at_cutoffs(D.inputs(tables), s)
    most = s.count()
    assert tables.obs.count() > 3 * most
    for group in (observed, shape, trailing):
        assert 0 < group(ctx).df.count() <= most
