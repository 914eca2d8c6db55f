"""Equi and dimension joins between forecasts, observations and events."""

from pyspark.sql import functions as F


def forecast_with_hourly_obs(fcst_hourly, obs, by_date=True):
    """Hourly forecast with the hour's mean observation. ``by_date=False`` pools the
    hours of all days of a city."""
    keys = ["city", "day", "hour"] if by_date else ["city", "hour"]
    # Sums of a hundredth-degree integer keep the mean independent of merge order.
    h = obs.groupBy(*keys).agg((F.sum(F.round(F.col("temp_f") * 100).cast("long")) / F.count("temp_f") / 100).alias("obs_f"))
    f = fcst_hourly.select("city", "day", "hour", F.col("temp_f").alias("fcst_f"))
    return f.join(h, keys)


def lags_by_date(daily, keys, day, cols, lags):
    """Lag by calendar date: a missing day gives NULL."""
    out = daily
    for n in lags:
        prev = daily.select(*keys, F.date_add(day, n).alias(day), *[F.col(c).alias(f"{c}_lag{n}") for c in cols])
        out = out.join(prev, [*keys, day], "left")
    return out


def full_outer(a, b, keys, suffixes=("_a", "_b")):
    ren = lambda d, s: d.select(*keys, *[F.col(c).alias(c + s) for c in d.columns if c not in keys])
    return ren(a, suffixes[0]).join(ren(b, suffixes[1]), keys, "full")


def fill_achievable(trades, candles, key, listed_us, price, window_us):
    """Trades for which some quote in [listed, listed+window] was at or below the price.

    The market key bounds the range test to one market's quotes; they are first
    reduced to the cheapest price per 30-minute slot (exact for slots fully inside
    the window), so a market with very many quotes is joined as a few slots.
    """
    slot = 1_800_000_000
    c = candles.withColumn("_p", F.coalesce("ask", "bid"))
    t = trades.withColumns({"_lo": F.col(listed_us), "_hi": F.col(listed_us) + window_us})
    # Interior slots by minimum, the two border slots by their rows.
    border = t.select(key, F.explode(F.array_distinct(F.array(
        F.floor(F.col("_lo") / slot), F.floor(F.col("_hi") / slot)))).alias("_b"), "_lo", "_hi", price).join(
        c.select(key, "bucket_us", "_p", F.floor(F.col("bucket_us") / slot).alias("_b")), [key, "_b"]
    ).filter((F.col("bucket_us") >= F.col("_lo")) & (F.col("bucket_us") <= F.col("_hi")) & (F.col("_p") <= F.col(price))).select(key)
    slots = c.groupBy(key, F.floor(F.col("bucket_us") / slot).alias("_b")).agg(F.min("_p").alias("_m"))
    inner = t.select(key, "_lo", "_hi", price).join(slots, key).filter(
        (F.col("_b") > F.floor(F.col("_lo") / slot)) & (F.col("_b") < F.floor(F.col("_hi") / slot)) & (F.col("_m") <= F.col(price))).select(key)
    return trades.join(border.union(inner).distinct(), key, "left_semi")


def missing_days(have, keys, day, lo, hi):
    """Calendar spine against present days: one row per (key, day) with a present flag."""
    spine = have.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(lo).cast("date"), F.lit(hi).cast("date"))).alias(day))
    return spine.join(have.select(*keys, day).distinct().withColumn("present", F.lit(1)), [*keys, day], "left").fillna(0, ["present"])


def lead_path(fcst, leads=(0, 1, 2)):
    """Forecast path of one basis date: the highs of each lead side by side, with trends."""
    p = fcst.filter(F.col("lead").isin(*leads)).groupBy("city", "basis").agg(
        *[F.max(F.when(F.col("lead") == l, F.col("tempmax_f"))).alias(f"t{l}") for l in leads]).filter("t0 IS NOT NULL")
    return p.withColumns({"trend": (F.coalesce("t2", "t1", "t0") - F.col("t0")) / 2,
                          "d1": F.col("t1") - F.col("t0"), "d2": F.col("t2") - F.col("t0")})
