"""Series statistics per key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.timeutil import MINUTE, col
from .chunked import prefix_scan

QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]


def quantiles(df, keys, x, width=1.0):
    """Exact linear quantiles per key in ``_q``; no group sits in one buffer.

    Equal values are counted first; the counts are accumulated over chunks of ``width``
    value units, and the two neighbours of each rank are picked by an aggregate.
    """
    c = df.select(*keys, col(x).cast("double").alias("_x")).where("_x is not null").groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n"))
    c = prefix_scan(c, list(keys), ["_x"], F.floor(F.col("_x") / width), {"_cum": ("sum", "_n")})
    c = c.join(c.groupBy(*keys).agg(F.sum("_n").alias("_all")), list(keys))
    at = lambda r: F.min(F.when(F.col("_cum") > r, F.col("_x")))
    out = []
    for p in QUANTILES:
        pos = F.lit(p) * (F.col("_all") - 1)
        share = F.max(pos - F.floor(pos))
        out.append(at(F.floor(pos)) + share * (at(F.ceil(pos)) - at(F.floor(pos))))
    return c.groupBy(*keys).agg(F.array(*out).alias("_q"))


def partial_day(df, keys, x, bounded=False):
    """max/min/mean/std/linear percentiles/count/half-even base/fraction.

    ``bounded`` says that a key has few rows (a day's 24 forecast hours): percentiles are
    then taken in the same aggregation.
    """
    name, x = x, col(x)
    q = F.percentile(x, F.array(*[F.lit(p) for p in QUANTILES])) if bounded else F.lit(None).cast("array<double>")
    a = df.groupBy(*keys).agg(
        F.max(x).alias("max_f"), F.min(x).alias("min_f"), F.avg(x).alias("mean_f"),
        F.coalesce(F.stddev_samp(x), F.when(F.count(x) > 0, F.lit(0.0))).alias("std_f"), q.alias("_q"),
        F.count(x).alias("n"))
    if not bounded:
        a = a.drop("_q").join(quantiles(df, keys, name), list(keys), "left")
    base = F.bround("max_f", 0).cast("long")
    out = a.select("*", *[F.col("_q")[i].alias(f"q{int(p * 100)}_f") for i, p in enumerate(QUANTILES)],
                   base.alias("t_base"), (F.col("max_f") - base).alias("frac_part")).drop("_q")
    return out.withColumns({"range_f": F.col("max_f") - F.col("min_f"), "iqr_f": F.col("q75_f") - F.col("q25_f")})


def with_last(df, keys, us):
    """Attach each key's newest time; the aggregate is one row per key."""
    last = df.groupBy(*keys).agg(F.max(us).alias("last_us"))
    return df.join(last, list(keys))


def tail_slopes(df, keys, us, x, minutes):
    """Slopes per hour over the last ``minutes``: sample covariance over population
    variance (the steeper variant) and the ordinary least-squares slope."""
    d = with_last(df, keys, us).filter(F.col(us) >= F.col("last_us") - minutes * MINUTE)
    t = (F.col(us) - F.col("last_us")) / F.lit(float(MINUTE))
    v = F.var_pop(t)
    n = F.count(x)
    return d.groupBy(*keys).agg(
        n.alias("n"),
        F.when(n >= 2, F.when(F.sqrt(v) < 0.001, 0.0).otherwise(F.covar_samp(col(x), t) / F.nullif(v, F.lit(0.0)) * 60)).alias("rate"),
        F.when(F.sqrt(v) >= 0.001, F.regr_slope(col(x), t) * 60).alias("ols"))


def ema(df, keys, us, x, halflife_min):
    """Mean weighted by exp(-ln2/h * age in minutes)."""
    d = with_last(df, keys, us)
    w = F.exp(F.lit(-0.6931471805599453 / halflife_min) * ((F.col("last_us") - F.col(us)) / F.lit(float(MINUTE))))
    s = F.sum(w)
    return d.groupBy(*keys).agg(F.when(s >= 0.001, F.sum(w * col(x)) / s).alias("ema"))


def multi_horizon(fcst, keys, decay=0.15):
    """Leads 1 to 6: lead 0 is issued on the event day and known to no earlier snapshot."""
    fcst = fcst.filter(F.col("lead").between(1, 6))
    w = F.exp(F.lit(-decay) * (F.col("lead") - 1))
    x = F.col("tempmax_f")
    at = lambda l: F.max(F.when(F.col("lead") == l, x))
    return fcst.filter(x.isNotNull()).groupBy(*keys).agg(
        F.avg(x).alias("multi_mean"), F.median(x).alias("multi_median"), (F.sum(w * x) / F.sum(w)).alias("multi_ema"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("multi_std"), (F.max(x) - F.min(x)).alias("multi_range"),
        (at(1) - at(2)).alias("t1_t2_diff"), (at(1) - at(6)).alias("drift"))


def drift(fcst, keys):
    """Spread of the leads around the T-1 anchor (or the smallest lead)."""
    x, l = F.col("tempmax_f"), F.col("lead")
    anchor = F.min_by(x, F.struct((l != 1).cast("int"), l))
    n = F.count(x)
    return fcst.filter(x.isNotNull()).groupBy(*keys).agg(
        n.alias("n_leads"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("drift_std"),
        (F.max(x) - anchor).alias("max_upside"), (F.min(x) - anchor).alias("max_downside"),
        (F.avg(x) - anchor).alias("mean_delta"),
        F.when(n >= 2, F.regr_slope(x, l.cast("double"))).otherwise(0.0).alias("slope_per_lead"))


def multivar(curve, keys):
    h = F.col("hour")
    out = []
    for c in ("humidity", "cloud", "dew"):
        out += [F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
                (F.max(c) - F.min(c)).alias(f"{c}_range")]
    out += [F.avg(F.when(h.between(6, 11), F.col("humidity"))).alias("am_humidity"),
            F.avg(F.when(h.between(12, 18), F.col("humidity"))).alias("pm_humidity")]
    return curve.groupBy(*keys).agg(*out)


def peak_window(curve, keys, step=60, band=1.0):
    """Peak, hour of the first peak, width between first and last point near it.

    A forecast curve has at most one row per hour of its day.
    """
    w = Window.partitionBy(*keys)
    d = curve.withColumns({"_m": F.max("temp_f").over(w), "_i": F.row_number().over(w.orderBy("us"))})
    near = F.when(F.col("temp_f") >= F.col("_m") - band, F.col("_i"))
    return d.groupBy(*keys).agg(
        F.max("temp_f").alias("peak_f"),
        F.max_by("hour", F.struct(F.col("temp_f"), -F.col("us"))).cast("double").alias("peak_hour"),
        ((F.max(near) - F.min(near) + 1) * step).alias("band_width_min"))


def station_gap(a, b, keys, on, x="temp_f"):
    """Gap of two aligned series: last, max, mean, population std, trend of halves."""
    from .chunked import numbered, time_chunk
    j = a.select(*keys, *on, F.col(x).alias("a")).join(b.select(*keys, *on, F.col(x).alias("b")), [*keys, *on])
    j = j.withColumn("gap", F.col("a") - F.col("b"))
    j = numbered(j, keys, on, time_chunk(on[0]))
    n = j.groupBy(*keys).agg(F.max("rn").alias("_n"))
    j = j.join(n, list(keys))
    half = F.floor(F.col("_n") / 2)
    g, r = F.col("gap"), F.col("rn")
    last = F.max_by(g, r)
    return j.groupBy(*keys).agg(
        F.count(g).alias("n"), last.alias("gap_last"), (F.max("a") - F.max("b")).alias("max_gap"), F.avg(g).alias("mean_gap"),
        F.coalesce(F.stddev_pop(g), F.lit(0.0)).alias("gap_std"), (last < 0).cast("int").alias("warmer"),
        F.when(F.count(g) >= 4, F.avg(F.when(r > half, g)) - F.avg(F.when(r <= half, g))).alias("gap_trend"))


def bracket_entropy(quotes, keys, index, bid):
    """Arg-max, max, entropy and upper-half mass of normalised bracket prices.

    The array holds the brackets of one event (six), never an open-ended group.
    """
    from ..functions.probs import total
    p = F.transform(F.sort_array(F.collect_list(F.struct(index, bid))), lambda s: s[bid] / 100.0)
    d = quotes.filter(col(bid).isNotNull()).groupBy(*keys).agg(p.alias("_p"))
    s = total(F.col("_p"))
    d = d.withColumn("_q", F.transform("_p", lambda x: F.when(s > 0, x / s).otherwise(x)))
    q = F.col("_q")
    return d.select(*keys, (F.array_position(q, F.array_max(q)) - 1).alias("argmax_idx"), F.array_max(q).alias("max_prob"),
                    (-total(F.transform(q, lambda x: x * F.ln(x + 1e-10)))).alias("entropy"),
                    total(F.slice(q, F.floor(F.size(q) / 2).cast("int") + 1, F.size(q))).alias("upper_mass"))


def latest_two(runs, keys, run, value):
    """Newest and second newest run per key: the second is the newest among the rest,
    so two hash aggregates suffice and no group is sorted."""
    g = runs.groupBy(*keys).agg(F.max_by(F.struct(F.col(run).alias("r"), F.col(value).alias("v")), run).alias("_a"), F.count(F.lit(1)).alias("n"))
    rest = runs.join(g.select(*keys, F.col("_a.r").alias("_top")), list(keys)).filter(F.col(run) < F.col("_top"))
    rest = rest.groupBy(*keys).agg(F.max_by(value, run).alias("previous"))
    return g.join(rest, list(keys), "left").select(*keys, F.col("_a.v").alias("latest"), "previous", "n")


def prior_days(daily, key, index, value, days=30, min_days=10):
    """Mean and population deviation over the prior calendar days. One row per day."""
    w = Window.partitionBy(key).orderBy(index).rangeBetween(-days, -1)
    ok = F.count(value).over(w) >= min_days
    return daily.withColumns({"mean_f": F.when(ok, F.avg(value).over(w)), "std_f": F.when(ok, F.stddev_pop(value).over(w))})
