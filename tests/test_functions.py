"""Fees, sizing, strikes, probabilities and clocks on literal examples."""

import math

from pyspark.sql import functions as F

from stratocast.functions import probs, quality, strikes, timeutil, trades


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_fees_roles_and_best_trade(spark):
    L = F.lit
    r = one(spark, a=trades.taker_fee_cents(L(50)), b=trades.taker_fee_cents(L(50), L(100)), c=trades.taker_fee_usd(L(100)),
            role=trades.liquidity_role(L("yes"), L("buy"), L(48), L(45), L(48)), maker=trades.liquidity_role(L("yes"), L("buy"), L(46), L(45), L(48)),
            ev=trades.expected_value(L("yes"), L("buy"), L(46), L(0.6), L("maker")), best=trades.best_trade(L(0.6), L(45), L(48)),
            none=trades.best_trade(L(0.6), L(0), L(48)))
    assert (r.a, r.b) == (math.ceil(0.07 * 0.5 * 1 * 0.5 * 100), math.ceil(0.07 * 0.5 * 100 * 0.5 * 100))
    assert (r.c, r.role, r.maker) == (0.0, "taker", "maker")
    assert abs(r.ev - 14) < 1e-9
    assert r.best.action == "buy" and r.best.price == 48 and r.best.role == "taker" and abs(r.best.ev - 10) < 1e-9
    assert r.none is None


def test_kelly_caps(spark):
    L = F.lit
    n, cap = trades.kelly_size(L(14.0), L(46), L(0.6), L(2.5), L(0))
    m, cap2 = trades.kelly_size(L(14.0), L(46), L(0.6), L(2.5), L(95))
    z, _ = trades.kelly_size(L(-1.0), L(46), L(0.6), L(2.5), L(0))
    r = one(spark, n=n, cap=cap, m=m, cap2=cap2, z=z)
    assert (r.n, r.cap, r.m, r.cap2, r.z) == (100, "max_position", 5, "max_position", 0)


def test_strike_modes(spark):
    rows = [("less", None, 60.0), ("between", 61.0, 62.0), ("greater", 62.0, None)]
    d = spark.createDataFrame(rows, "k string, lo double, hi double")
    hits = lambda x, mode: [r.k for r in d.filter(strikes.contains("k", "lo", "hi", F.lit(x), mode)).collect()]
    assert hits(60.0, "integer") == ["less"] and hits(60.0, "real") == [] and hits(62.0, "integer") == ["between"]
    assert hits(62.0, "half_open") == ["greater"] and hits(61.0, "left_open") == []
    t = one(spark, a=strikes.parse_ticker(F.lit("HIGHCHI-25NOV28-B35.5")), b=strikes.parse_ticker(F.lit("HIGHCHI-25NOV28-B50")),
            c=strikes.parse_ticker(F.lit("HIGHCHI-25NOV28-T83LO")), d=strikes.parse_ticker(F.lit("HIGHCHI-25XXX28-T90")))
    assert (t.a.floor_s, t.a.cap_s, t.b.cap_s, t.c.strike_type, t.c.cap_s) == (35.5, 37.5, 54.0, "less", 83.0)
    assert str(t.a.event_date) == "2025-11-28" and t.d.event_date is None and t.d.floor_s == 90.0


def test_probability_arrays(spark):
    p = F.array(*[F.lit(x) for x in (0.1, 0.5, 0.3, 0.1)])
    k = F.array(*[F.lit(x) for x in (-1, 0, 1, 2)])
    cum = F.array(*[F.lit(x) for x in (0.6, 0.7, 0.2)])
    r = one(spark, e=probs.expected(p, k), m=probs.mode(p, k), q=probs.mass(p, k, 0, 1), i=probs.shortest_interval(p, k, 0.8),
            c=probs.classes_from_cumulative(cum), mono=probs.monotone(cum), n=probs.normal_cdf(F.lit(-1.3)))
    assert abs(r.e - 0.4) < 1e-12 and r.m == 0 and abs(r.q - 0.8) < 1e-12 and (r.i.lo, r.i.hi) == (0, 1)
    assert abs(sum(r.c) - 1) < 1e-12 and min(r.c) >= 0 and r.mono == [0.7, 0.7, 0.2]
    assert abs(r.n - 0.5 * (1 + math.erf(-1.3 / math.sqrt(2)))) < 1e-7


def test_clocks(spark):
    d = F.lit("2024-03-10").cast("date")
    a, b = timeutil.local_day_bounds_utc(d, F.lit("America/Chicago"))
    t = F.lit("2024-03-10 02:30:15.25").cast("timestamp_ntz")
    r = one(spark, h=(timeutil.epoch_us(b) - timeutil.epoch_us(a)) / timeutil.HOUR, us=timeutil.epoch_us(t), back=timeutil.from_us(timeutil.epoch_us(t)),
            wd=timeutil.weather_day(t), f=timeutil.floor_minutes(t, 15))
    assert r.h == 23 and str(r.back) == "2024-03-10 02:30:15.250000" and str(r.wd) == "2024-03-09" and str(r.f) == "2024-03-10 02:30:00"


def test_valid_temperature(spark):
    d = spark.createDataFrame([(None,), (-77.9,), (151.0,), (-50.0,), (70.0,)], "x double")
    assert [r.x for r in d.filter(quality.valid_temp("x")).collect()] == [-50.0, 70.0]
    assert d.count() == 5
