"""Strategy registry: id -> builder of trade rows."""

from pyspark.sql import functions as F

from ..functions.timeutil import HOUR, epoch_us
from ..operators import strategies as S


def _base(t, **p):
    return S.fixed_entry(t.fcst, t.settle, t.market, **p)


def _next_over(t, **p):
    at = epoch_us(F.col("day").cast("timestamp_ntz")) + 14 * HOUR
    return S.next_over(_base(t, **p), t.market, t.candle, at, 8 * HOUR)


def _curve_gap(t, **p):
    return S.curve_gap(_base(t, **p), t.market, t.obs, t.fcst_hourly, 12, avg_min=120, slope_min=240)


def _midnight(t, alpha=0.3, beta=0.1, **p):
    return S.midnight(t.fcst, t.settle, t.market, t.candle, alpha, beta, p.get("budget", 100.0))


STRATEGIES = {
    "open_maker_base": (_base, {"bias": 1.0, "entry": 30.0, "budget": 100.0}),
    "open_maker_next_over": (_next_over, {"bias": 1.0, "entry": 30.0, "budget": 100.0}),
    "open_maker_curve_gap": (_curve_gap, {"bias": 1.0, "entry": 30.0, "budget": 100.0}),
    "midnight": (_midnight, {"alpha": 0.3, "beta": 0.1}),
}


def run_strategy(name, tables, **params):
    if name not in STRATEGIES:
        raise KeyError(f"unknown strategy {name!r}; known: {sorted(STRATEGIES)}")
    fn, defaults = STRATEGIES[name]
    return fn(tables, **{**defaults, **params})
