"""Clock arithmetic. ``*_local`` columns are TIMESTAMP_NTZ, ``us`` columns are
microseconds since 1970-01-01 of the same clock, kept as exact integers."""

from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def col(c):
    return F.col(c) if isinstance(c, str) else c


def epoch_us(ts):
    """Microseconds since the epoch of a zone-free timestamp.

    Built from calendar fields, so no session time zone is involved and the
    result is strictly monotonic through daylight-saving changes.
    """
    ts = col(ts)
    secs = (
        F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
    )
    return secs * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def from_us(us):
    """Zone-free timestamp of an ``epoch_us`` value."""
    us = col(us)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=(us / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)")
    )


def day_index(day, origin="2024-01-01"):
    return F.datediff(col(day), F.lit(origin).cast("date"))


def floor_minutes(ts, n):
    """Floor a timestamp to an ``n``-minute wall-clock grid within the hour."""
    ts = col(ts)
    return F.date_trunc("hour", ts).cast("timestamp_ntz") + F.make_dt_interval(
        mins=(F.floor(F.minute(ts) / n) * n).cast("int")
    )


def market_clock(event_date, cutoff_us, open_hour=10):
    """Minutes/hours since the window opened at D-1 10:00 and to its close at D 23:55."""
    d0 = F.datediff(col(event_date), F.lit("1970-01-01").cast("date")).cast("long") * DAY
    opened = d0 - DAY + open_hour * HOUR
    closed = d0 + 23 * HOUR + 55 * MINUTE
    c = col(cutoff_us)
    return {
        "minutes_since_market_open": F.floor((c - opened) / MINUTE),
        "hours_since_market_open": (c - opened) / F.lit(float(HOUR)),
        "hours_to_event_close": (closed - c) / F.lit(float(HOUR)),
        "is_event_day": (c >= d0).cast("int"),
        "is_d_minus_1": (c < d0).cast("int"),
    }


def calendar(day, ts):
    """Calendar fields and cyclic encodings of a local cutoff time."""
    day, ts = col(day), col(ts)
    tau = 6.283185307179586
    h, m = F.hour(ts), F.minute(ts)
    msm = h * 60 + m
    doy, week = F.dayofyear(day), F.weekofyear(day)

    def cyc(x, period):
        return F.sin(tau * x / period), F.cos(tau * x / period)

    out = {
        "snapshot_hour": h, "minute": m, "minutes_since_midnight": msm, "doy": doy,
        "week_of_year": week, "month": F.month(day), "is_weekend": (F.weekday(day) >= 5).cast("int"),
    }
    for name, x, p in [
        ("hour", h, 24.0), ("minute", m, 60.0), ("time_of_day", msm, 1440.0),
        ("doy", doy, 365.25), ("week", week, 52.0),
    ]:
        out[f"{name}_sin"], out[f"{name}_cos"] = cyc(x, p)
    return out


def local_day_bounds_utc(day, zone):
    """UTC start and end of a local civil day (23, 24 or 25 hours long)."""
    start = col(day).cast("timestamp_ntz")
    end = F.date_add(col(day), 1).cast("timestamp_ntz")
    conv = lambda t: F.convert_timezone(col(zone), F.lit("UTC"), t)
    return conv(start), conv(end)


def weather_day(ts, cut_hour=6):
    """Local hours before ``cut_hour`` belong to the previous day."""
    ts = col(ts)
    d = ts.cast("date")
    return F.when(F.hour(ts) < cut_hour, F.date_sub(d, 1)).otherwise(d)


def seconds_to_midnight(ts):
    ts = col(ts)
    return 86400 - (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))


def weighted_hour(yesterday, today, tomorrow):
    """0.2 / 0.7 / 0.1 blend; a missing neighbour falls back to today's hour."""
    t = col(today)
    return 0.2 * F.coalesce(col(yesterday), t) + 0.7 * t + 0.1 * F.coalesce(col(tomorrow), t)
