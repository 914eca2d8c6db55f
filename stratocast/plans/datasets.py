"""Snapshot datasets: spine plus feature groups, all cities and days in one plan."""

from copy import copy

from pyspark.sql import functions as F

from ..features import build
from ..features.groups import Inputs
from ..functions.quality import valid_temp
from ..functions.timeutil import DAY, HOUR, MINUTE
from ..operators.fill import interpolate_small_gaps
from ..operators.spine import event_spine
from ..session import written


def inputs(t, inclusive=True):
    """Inputs of the feature groups; settlements feed most of them and are written once. The caller's
    tables stay as they are, as the written one may go with its scope (``session.intermediates``)."""
    t = copy(t)
    t.settle = written(t.settle, "settle")
    return Inputs(obs=t.obs, city_obs=t.obs2, fcst=t.fcst, curve=t.fcst_hourly, candles=t.candle, settle=t.settle, guidance=t.guidance, station=t.fcst_station, inclusive=inclusive)


def snapshots(events, step_min=5):
    return event_spine(events.select("city", F.col("day").alias("event_date")), "event_date", step_min)


def hourly(events, lo=10, hi=23):
    d0 = F.datediff("event_date", F.lit("1970-01-01").cast("date")).cast("long") * DAY
    e = events.select("city", F.col("day").alias("event_date"))
    return e.select("*", F.explode(F.sequence(d0 + lo * HOUR, d0 + hi * HOUR, F.lit(HOUR))).alias("us"))


def market_clock_dataset(events, ctx, step_min=5, min_obs=1, groups=None):
    """Every snapshot with at least ``min_obs`` observations behind it."""
    s = build(snapshots(events, step_min), ctx, groups)
    return s.filter(F.col("num_samples_sofar") >= min_obs)


def hourly_dataset(events, ctx, min_obs=12, groups=None, lo=10, hi=23):
    s = build(hourly(events, lo, hi), ctx, groups)
    return s.filter(F.col("num_samples_sofar") >= min_obs)


def repaired(obs, limit=3):
    """Observations of valid readings, short gaps of a day filled from both sides by at most
    ``limit`` rows; what stays unknown is left out by the feature groups."""
    o = interpolate_small_gaps(obs.withColumn("raw_f", F.when(valid_temp("raw_f"), F.col("raw_f"))), ["city", "day"], "us", "event_id", "raw_f", "_fixed", limit)
    return o.withColumn("temp_f", F.col("_fixed")).drop("_fixed")


def quarter_hours_dataset(events, ctx, min_obs=1, groups=None, lo=10, hi=23):
    """Snapshots every fifteen minutes of the event day (the context's opening hour says which rows count)."""
    return build(quarter_hours(events, lo, hi), ctx, groups).filter(F.col("num_samples_sofar") >= min_obs)


def quarter_hours(events, lo=10, hi=23):
    d0 = F.datediff("event_date", F.lit("1970-01-01").cast("date")).cast("long") * DAY
    e = events.select("city", F.col("day").alias("event_date"))
    return e.select("*", F.explode(F.sequence(d0 + lo * HOUR, d0 + hi * HOUR + 45 * MINUTE, F.lit(15 * MINUTE))).alias("us"))
