"""Snapshot feature groups in dependency order.

A snapshot is (city, event_date, us). Observation features are computed once
per observation (running and trailing windows) and picked up by one as-of join,
so the many snapshots of an event multiply only narrow rows.
"""

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import derived as X
from ..functions import meteo
from ..functions import timeutil as TU
from ..functions.timeutil import DAY, HOUR, MINUTE
from ..operators import rolling, stats
from ..operators.asof import Source
from ..operators.chunked import prefix_scan, time_chunk
from ..operators.cutoffs import first_cutoff, frames_at
from ..operators.joins import lags_by_date
from ..operators.order_stats import marked_quantiles
from ..operators.shape import SHAPE, shape_at
from ..operators.sliding import Edge, Extreme, Moments, sliding, slope, std
from ..session import written
from .registry import KEY, feature_group


@dataclass
class Inputs:
    """Source frames of one build; any but ``obs`` may be None (``complete`` makes it an empty frame)."""
    obs: Any
    city_obs: Any = None
    fcst: Any = None
    curve: Any = None
    candles: Any = None
    settle: Any = None
    guidance: Any = None
    station: Any = None
    inclusive: bool = True
    open_hour: int = 10
    #: Set by ``at_cutoffs``: the snapshots, the observations with the first snapshot that sees them, and one row per such snapshot.
    cuts: Any = None
    seen: Any = None
    slots: Any = None


# Columns that the groups read of each optional frame.
FRAMES = {
    "city_obs": "city string, day date, us long, temp_f double",
    "fcst": "city string, day date, lead int, tempmax_f double",
    "curve": "city string, day date, hour int, us long, temp_f double, cloud double, humidity double, dew double",
    "candles": "city string, day date, bucket_us long, mkt string, j int, bid long, ask long, volume long, oi long",
    "settle": "city string, day date, di int, settle_f long, vc_max_f double",
    "guidance": "city string, day date, model string, run_us long, run_id long, peak_f double",
    "station": "city string, day date, tempmax_f double",
}


def complete(ctx, spark):
    """``ctx`` with an empty frame for every absent source, so that a snapshot always has
    all columns, those without a source as NULLs of their type."""
    return replace(ctx, **{n: spark.createDataFrame([], s) for n, s in FRAMES.items() if getattr(ctx, n) is None})


def at_cutoffs(ctx, snapshots):
    """``ctx`` with the observations of every event marked by the first snapshot that sees them (``_cut``), and per
    such mark the maximum so far and the time of the newest row. Both are written once for all groups that read them."""
    cuts = snapshots.select(*KEY, F.col("us").alias("_cut")).distinct()
    o = event_rows(ctx.obs.filter("temp_f IS NOT NULL").select("city", "day", "us", "event_id", "temp_f"), ctx.open_hour).drop("day")
    seen = written(first_cutoff(o, cuts, KEY, inclusive=ctx.inclusive), "seen")
    slots = seen.groupBy(*KEY, "_cut").agg(F.max("temp_f").alias("_top"), F.max("us").alias("_us"))
    # At most one row per snapshot of the event.
    w = Window.partitionBy(*KEY).orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0)
    return replace(ctx, cuts=cuts, seen=seen, slots=written(slots.withColumn("_top", F.max("_top").over(w)), "slots"))


def event_rows(df, open_hour=10):
    """Rows of the event window: a row after the D-1 opening belongs to D and D+1."""
    d = df["day"]
    late = F.pmod(F.col("us"), F.lit(DAY)) >= open_hour * HOUR
    ev = F.when(late, F.array(d, F.date_add(d, 1))).otherwise(F.array(d))
    return df.withColumn("event_date", F.explode(ev))


@feature_group("clock")
def clock(s, ctx):
    ts = TU.from_us("us")
    c = TU.market_clock("event_date", "us", ctx.open_hour)
    s = s.withColumns({**c, **TU.calendar("event_date", ts)})
    return s.withColumns({"hour": F.col("snapshot_hour"), "day_fraction": F.col("minutes_since_midnight") / 1440.0})


@feature_group("trailing", "series")
def trailing(ctx):
    """Momentum, volatility and weather of the newest observation and of the minutes before it, at the snapshots."""
    o = ctx.obs.filter("temp_f IS NOT NULL").select("city", "day", "us", "event_id", "temp_f", "humidity", "wind", "gust", "cloud")
    o = o.withColumns({"wb": meteo.wet_bulb("temp_f", "humidity"), "wc": meteo.wind_chill("temp_f", "wind")})

    x, n = F.col("temp_f"), Moments(F.lit(1.0))
    specs = {**{f"_x{m}": (m, Moments(x)) for m in (30, 60, 120)}, **{f"_hi{m}": (m, Extreme("max", x)) for m in (30, 60)},
             **{f"_t{m}": (m, Moments(rolling.elapsed("us"), x)) for m in (30, 60)},
             **{f"_{c}": (60, Moments(F.col(c))) for c in ("humidity", "cloud", "wb", "wc")}, "_dep": (60, Moments(x - F.col("wb"))),
             "_wind": (60, Extreme("max", F.col("wind"))), "_gust": (60, Extreme("max", F.col("gust"))), "_n30": (30, n),
             "_first60": (60, Edge(F.struct("cloud", "humidity"), "us")), "_first30": (30, Edge(F.struct("us", "cloud", "wb", "wc"), "us"))}
    # Only the newest row at a snapshot is read, and the one half an hour before it.
    newest = ctx.slots.select("city", F.col("_us").alias("us")).distinct()
    cuts = newest.select("city", "us", (F.col("us") - 30 * MINUTE).alias("_cut"))
    past = first_cutoff(o.select("city", "us"), cuts, ["city"]).groupBy("city", "_cut").agg(F.max("us").alias("_past"))
    past = prefix_scan(cuts.join(past, ["city", "_cut"], "left"), ["city"], ["_cut"], time_chunk("_cut"), {"_past": ("max", "_past")})
    past = written(past.select("city", "us", "_past"), "observed-past")
    at = past.select("city", "us").union(past.where("_past is not null").select("city", "_past"))
    own = [c for c in o.columns if c not in ("city", "us", "day", "event_id")]
    rows = o.join(past.select("city", "us"), ["city", "us"]).groupBy("city", "us").agg(F.max_by(F.struct(*own), "event_id").alias("_own"))
    o = written(frames_at(o, at, ["city"], "us", specs), "observed-frames")
    rates = o.select("city", F.col("us").alias("_past"), slope(F.col("_t30")).alias("_rate_past"))
    o = o.join(rows, ["city", "us"]).join(past, ["city", "us"]).join(rates, ["city", "_past"], "left").select("*", "_own.*").drop("_own", "_past")
    zero, two = F.lit(0.0), F.col("_n30.n") >= 2
    early, hour = F.col("_first30.v.v"), F.col("_first60.v.v")
    per_hour = lambda c: F.when(two, (F.col(c) - early[c]) / F.nullif((F.col("us") - early["us"]) / 1e6, zero) * 3600)
    out = {}
    for m in (30, 60, 120):
        out.update({f"temp_mean_last_{m}min": F.col(f"_x{m}.x"), f"temp_std_last_{m}min": F.coalesce(std(F.col(f"_x{m}")), zero)})
        if m <= 60:
            out.update({f"temp_max_last_{m}min": F.col(f"_hi{m}.v"), f"temp_rate_last_{m}min": slope(F.col(f"_t{m}")), f"temp_volatility_{m}min": std(F.col(f"_x{m}"))})
    out.update({
        "windgust_max_last_60min": F.col("_gust.v"), "windspeed_max_last_60min": F.col("_wind.v"), "wetbulb_depression_mean_60min": F.col("_dep.x"),
        "wetbulb_rate_last_30min": per_hour("wb"), "windchill_warming_rate": per_hour("wc"), "cloudcover_rate_last_30min": F.when(two, (F.col("cloud") - early["cloud"]) / 0.5),
        "humidity_mean_last_60min": F.col("_humidity.x"), "humidity_std_last_60min": F.coalesce(std(F.col("_humidity")), zero),
        "cloudcover_mean_last_60min": F.col("_cloud.x"), "cloudcover_volatility_60min": std(F.col("_cloud")),
        "cloudcover_change_last_60min": F.col("cloud") - hour["cloud"], "humidity_change_last_60min": F.col("humidity") - hour["humidity"],
        "wetbulb_mean_last_60min": F.col("_wb.x"), "windchill_mean_last_60min": F.col("_wc.x")})
    o = o.withColumns(out).drop(*specs)
    v = F.col("temp_f")
    o = o.withColumns({
        "humidity_last_obs": F.col("humidity"), "windspeed_last_obs": F.col("wind"), "cloudcover_last_obs": F.col("cloud"),
        "high_humidity_flag": (F.col("humidity") > 80).cast("int"), "strong_wind_flag": (F.col("wind") > 15).cast("int"),
        "high_cloud_flag": (F.col("cloud") > 70).cast("int"), "clear_sky_flag": (F.col("cloud") < 20).cast("int"),
        "wetbulb_last_obs": F.col("wb"), "wetbulb_depression": v - F.col("wb"), "high_wetbulb_flag": (F.col("wb") > 75).cast("int"),
        "windchill_last_obs": F.when(v <= 50, F.col("wc")), "cloud_regime": meteo.cloud_regime("cloud"),
        "cloud_stability_score": F.when(F.col("cloudcover_volatility_60min").isNotNull(), 1 - F.least(F.lit(1.0), F.col("cloudcover_volatility_60min") / 100)),
        "clearing_trend_flag": (F.col("cloudcover_change_last_60min") < -20).cast("int"),
        "clouding_trend_flag": (F.col("cloudcover_change_last_60min") > 20).cast("int"),
        "windchill_depression": F.when(v <= 50, v - F.col("wc")), "strong_windchill_flag": F.when(v <= 50, (v - F.col("wc") > 10).cast("int")),
        "_acceleration": F.col("temp_rate_last_30min") - F.col("_rate_past")})
    drop = {"city", "us", "humidity", "wind", "gust", "cloud", "wb", "wc", "temp_f", "_rate_past"}
    cols = {c: c for c in o.columns if c not in drop}
    o = ctx.slots.join(o.withColumnRenamed("us", "_us"), ["city", "_us"])
    return Source(o.select(*KEY, "_cut", *cols), "_cut", cols)


@feature_group("observed", "series")
def observed(ctx):
    """Partial-day statistics and quality of the observations so far, at the snapshots."""
    v, h = F.col("temp_f"), F.floor(F.pmod(F.col("us"), F.lit(DAY)) / HOUR)
    part = lambda c: F.max(F.when(c, v))
    # Decayed means as running sums of growing weights; the growth cancels in the ratio.
    d0 = F.datediff("event_date", F.lit("1970-01-01").cast("date")).cast("long") * DAY - DAY
    grow = lambda half: F.exp((F.col("us") - d0) / F.lit(float(MINUTE)) * (0.6931471805599453 / half))
    # No row after the newest one near the maximum raises it, so "near" may be read against the maximum at the snapshot.
    near = F.when(F.abs(v - F.col("_top")) < 0.01, F.col("us"))
    o = ctx.seen.join(ctx.slots, [*KEY, "_cut"]).groupBy(*KEY, "_cut", "_top", "_us").agg(
        F.count(v).alias("num_samples_sofar"), F.sum(v).alias("_s"), F.sum(v * v).alias("_ss"), F.min(v).alias("vc_min_f_sofar"), part(h < 12).alias("max_morning_f_sofar"),
        part((h >= 12) & (h < 17)).alias("max_afternoon_f_sofar"), part(h >= 17).alias("max_evening_f_sofar"), F.max(X.via_celsius(v)).alias("pred_c_first_sofar"),
        F.min("us").alias("_first"), F.max(near).alias("_at"), F.max_by(v, F.when(F.col("us") == F.col("_us"), F.col("event_id"))).alias("_last"),
        *[F.sum(grow(m)).alias(f"_w{m}") for m in (30, 60)], *[F.sum(grow(m) * v).alias(f"_wx{m}") for m in (30, 60)])
    o = o.withColumnRenamed("_top", "vc_max_f_sofar")
    # Gaps lie within an hour of a snapshot's rows or between two such hours.
    hour = F.floor(F.col("us") / HOUR)
    w = Window.partitionBy(*KEY, "_cut", "_h").orderBy("us")
    g = ctx.seen.select(*KEY, "_cut", "us", hour.alias("_h")).withColumn("_gap", F.col("us") - F.lag("us").over(w))
    g = g.groupBy(*KEY, "_cut", "_h").agg(F.max("_gap").alias("_gap"), F.min("us").alias("_from"), F.max("us").alias("_to"))
    w = Window.partitionBy(*KEY).orderBy("_cut", "_h")
    g = g.withColumns({"_gap": F.greatest("_gap", F.col("_from") - F.lag("_to").over(w)), "_new": F.when(F.lag("_h").over(w) == F.col("_h"), 0).otherwise(1)})
    g = g.groupBy(*KEY, "_cut").agg(F.max("_gap").alias("_gap"), F.sum("_new").alias("hours_observed"))
    # At most one row per snapshot of the event.
    up = Window.partitionBy(*KEY).orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0)
    fold = {F.sum: ["num_samples_sofar", "_s", "_ss", "_w30", "_w60", "_wx30", "_wx60", "hours_observed"], F.min: ["vc_min_f_sofar", "_first"],
            F.max: ["max_morning_f_sofar", "max_afternoon_f_sofar", "max_evening_f_sofar", "pred_c_first_sofar", "_at", "_gap"]}
    o = o.join(g, [*KEY, "_cut"]).withColumns({c: f(c).over(up) for f, names in fold.items() for c in names})
    n, mean = F.col("num_samples_sofar"), F.col("_s") / F.col("num_samples_sofar")
    var = F.greatest((F.col("_ss") - F.col("_s") * mean) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))
    base = F.bround("vc_max_f_sofar", 0)
    o = o.withColumns({
        "vc_mean_f_sofar": mean, "vc_std_f_sofar": F.when(n > 1, F.sqrt(var)).otherwise(0.0),
        "vc_frac_part_sofar": F.col("vc_max_f_sofar") - base, "t_base": base.cast("long"),
        "intraday_range_sofar": F.col("vc_max_f_sofar") - F.col("vc_min_f_sofar"),
        "temp_cv_sofar": F.when((mean > 0) & (n > 1), F.sqrt(var) / mean),
        "minutes_since_max_observed": (F.col("_us") - F.col("_at")) / F.lit(float(MINUTE)),
        "missing_fraction_sofar": 1 - n / F.greatest(F.floor((F.col("_us") - F.col("_first")) / (5 * MINUTE)) + 1, n),
        "temp_ema_30min": F.col("_wx30") / F.col("_w30"), "temp_ema_60min": F.col("_wx60") / F.col("_w60"),
        "hours_coverage_fraction": F.col("hours_observed") / 38.0,
        "max_gap_minutes": F.col("_gap") / F.lit(float(MINUTE)),
        "pred_max_round_sofar": base.cast("long"), "pred_ceil_max_sofar": F.ceil("vc_max_f_sofar"), "pred_floor_max_sofar": F.floor("vc_max_f_sofar"),
        "last_temp_f": F.col("_last")})
    cols = {c: c for c in o.columns if c not in KEY and not c.startswith("_")}
    return Source(o.select(*KEY, "_cut", *cols), "_cut", cols)


@feature_group("shape", "series")
def shape(ctx):
    """Runs above the moving base, second maximum, slopes and plateau so far (``operators.shape``), at the snapshots."""
    tops = ctx.slots.select(*KEY, "_cut", F.bround("_top", 0).cast("long").alias("_b"))
    o = shape_at(ctx.seen.join(tops, [*KEY, "_cut"]), KEY, "temp_f", "_b")
    return Source(o, "_cut", {c: c for c in SHAPE})


@feature_group("quantiles", "cutoffs")
def quantiles(s, ctx):
    """Quantiles of all temperatures so far, at every snapshot."""
    ps = stats.QUANTILES
    q = marked_quantiles(ctx.seen, ctx.cuts, KEY, "us", "temp_f", ps)
    return q.select(*KEY, "us", *[F.col("q")[i].alias(f"vc_q{int(p * 100)}_f_sofar") for i, p in enumerate(ps)])


@feature_group("acceleration")
def acceleration(s, ctx):
    """Change of the half-hour slope, once an hour of samples has been seen."""
    if "_acceleration" not in s.columns or "num_samples_sofar" not in s.columns:
        return s
    return s.withColumn("temp_acceleration", F.when(F.col("num_samples_sofar") >= 12, F.col("_acceleration"))).drop("_acceleration")


@feature_group("rules")
def rules(s, ctx):
    p = ["pred_max_round_sofar", "pred_ceil_max_sofar", "pred_floor_max_sofar", "pred_c_first_sofar", "pred_plateau_20min_sofar"]
    d = X.rule_disagreement(p)
    return s.withColumns({"range_pred_rules_sofar": d["range_pred"], "num_distinct_preds_sofar": d["n_distinct"]})


# Names of the feature contract that prefixing does not give.
CONTRACT = {"drift_std": "fcst_drift_std_f", "n_leads": "fcst_drift_num_leads", "am_humidity": "fcst_humidity_morning_mean", "pm_humidity": "fcst_humidity_afternoon_mean",
            "slope_per_lead": "fcst_drift_slope_f_per_lead", "drift": "fcst_multi_drift", "t1_t2_diff": "fcst_multi_t1_t2_diff"}


@feature_group("forecast", "event")
def forecast(ctx):
    """Static forecast curve, its peak, drift over leads and multivariate summary per event."""
    k = ["city", "day"]
    c = stats.partial_day(ctx.curve, k, "temp_f", bounded=True).select(
        *k, F.col("max_f").alias("fcst_prev_max_f"), F.col("min_f").alias("fcst_prev_min_f"), F.col("mean_f").alias("fcst_prev_mean_f"),
        F.col("std_f").alias("fcst_prev_std_f"), *[F.col(f"q{q}_f").alias(f"fcst_prev_q{q}_f") for q in (10, 25, 50, 75, 90)],
        F.col("frac_part").alias("fcst_prev_frac_part"), F.col("t_base").alias("t_forecast_base"))
    pk = stats.peak_window(ctx.curve, k).select(
        *k, F.col("peak_f").alias("fcst_peak_temp_f"), F.col("peak_hour").alias("fcst_peak_hour_float"), F.floor("peak_hour").alias("fcst_prev_hour_of_max"),
        F.col("band_width_min").cast("double").alias("fcst_peak_band_width_min"), F.lit(60.0).alias("fcst_peak_step_minutes"))
    mv = stats.multivar(ctx.curve, k)
    mv = mv.withColumnsRenamed({x: CONTRACT.get(x, "fcst_" + x.replace("cloud_", "cloudcover_").replace("dew_", "dewpoint_")) for x in mv.columns if x not in k})
    frac = F.col("fcst_prev_max_f") - F.floor("fcst_prev_max_f")
    c = c.withColumn("fcst_prev_distance_to_int", F.least(frac, 1 - frac))
    c = c.withColumn("fcst_prev_near_boundary_flag", (F.col("fcst_prev_distance_to_int") < 0.25).cast("double"))
    per_event = c.join(pk, k).join(mv, k)
    if ctx.fcst is not None:
        mh = stats.multi_horizon(ctx.fcst, k)
        mh = mh.withColumnsRenamed({x: CONTRACT.get(x, "fcst_" + x) for x in mh.columns if x not in k})
        # Lead 0 is issued on the event day, after the first snapshots.
        dr = stats.drift(ctx.fcst.filter("lead >= 1"), k)
        dr = dr.withColumnsRenamed({x: CONTRACT.get(x, "fcst_drift_" + x + "_f") for x in dr.columns if x not in k})
        per_event = per_event.join(mh, k, "left").join(dr, k, "left")
    if ctx.station is not None:
        per_event = per_event.join(ctx.station.groupBy(*k).agg(F.max("tempmax_f").alias("fcst_station_max_f")), k, "left")
        per_event = per_event.withColumn("fcst_city_station_gap", F.col("fcst_station_max_f") - F.col("fcst_prev_max_f"))
    return per_event.withColumnRenamed("day", "event_date")


@feature_group("forecast_error", "series")
def forecast_error(ctx):
    """Observed minus forecast over the completed hours of the event day."""
    from ..operators.joins import forecast_with_hourly_obs
    e = forecast_with_hourly_obs(ctx.curve, ctx.obs).withColumn("e", F.col("obs_f") - F.col("fcst_f"))
    d0 = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * DAY
    e = e.select("city", F.col("day").alias("event_date"), (d0 + (F.col("hour") + 1) * HOUR).alias("t"), "e")
    # At most 24 completed hours per event.
    w3 = Window.partitionBy(*KEY).orderBy("t").rowsBetween(-2, 0)
    e = e.withColumn("err_last3h_mean", F.when(F.count("e").over(w3) == 3, F.avg("e").over(w3)))
    e = prefix_scan(e, KEY, ["t"], time_chunk("t", DAY), {"_n": ("count", "e"), "_s": ("sum", "e"), "_ss": ("sum", F.col("e") * F.col("e")), "_a": ("sum", F.abs("e")), "err_max_pos_sofar": ("max", "e"), "err_max_neg_sofar": ("min", "e")})
    spread = F.greatest(F.col("_ss") - F.col("_s") * F.col("_s") / F.col("_n"), F.lit(0.0)) / (F.col("_n") - 1)
    e = e.withColumn("err_std_sofar", F.when(F.col("_n") > 1, F.sqrt(spread)).when(F.col("_n") == 1, 0.0))
    e = e.select(*KEY, "t", "err_std_sofar", (F.col("_s") / F.col("_n")).alias("err_mean_sofar"), (F.col("_a") / F.col("_n")).alias("err_abs_mean_sofar"),
                 "err_max_pos_sofar", "err_max_neg_sofar", F.col("e").alias("err_last1h"), "err_last3h_mean")
    return Source(e, "t", {c: c for c in e.columns if c not in (*KEY, "t")})


@feature_group("station_city", "series")
def station_city(ctx):
    """Gap of the station and city series at equal times, so far."""
    b = ctx.city_obs.select("city", "day", "us", F.col("temp_f").alias("b")).groupBy("city", "day", "us").agg(F.max("b").alias("b"))
    j = ctx.obs.select("city", "day", "us", "temp_f").join(b, ["city", "day", "us"])
    j = event_rows(j.withColumn("g", F.col("temp_f") - F.col("b")), ctx.open_hour)
    j = prefix_scan(j, KEY, ["us"], time_chunk("us"), {"_n": ("count", "g"), "_s": ("sum", "g"), "_ss": ("sum", F.col("g") * F.col("g")), "_a": ("max", "temp_f"), "_b": ("max", "b")})
    # A row is the middle of the series of twice its number and of one more.
    half = j.select(*KEY, F.explode(F.array(2 * F.col("_n"), 2 * F.col("_n") + 1)).alias("_n"), F.col("_n").alias("_h"), F.col("_s").alias("_hs"))
    j = j.join(half, [*KEY, "_n"], "left")
    trend = F.when(F.col("_n") >= 4, (F.col("_s") - F.col("_hs")) / (F.col("_n") - F.col("_h")) - F.col("_hs") / F.col("_h"))
    m = F.col("_s") / F.col("_n")
    j = j.select(*KEY, "us", trend.alias("station_city_gap_trend"), F.col("g").alias("station_city_temp_gap"), (F.col("_a") - F.col("_b")).alias("station_city_max_gap_sofar"), m.alias("station_city_mean_gap_sofar"),
                 F.sqrt(F.greatest(F.col("_ss") / F.col("_n") - m * m, F.lit(0.0))).alias("station_city_gap_std"), (F.col("g") < 0).cast("int").alias("city_warmer_flag"))
    return Source(j, "us", {c: c for c in j.columns if c not in (*KEY, "us")}, inclusive=ctx.inclusive)


@feature_group("market", "series")
def market(ctx):
    """Quotes of the event's brackets strictly before the cutoff, newest (time, ticker) last."""
    c = ctx.candles.select("city", F.col("day").alias("event_date"), "bucket_us", "mkt", "bid", "ask", "volume", "oi", "j")

    # Equal minutes of two brackets are told apart by bracket index.
    c = c.withColumn("_t", F.col("bucket_us") + F.col("j"))
    specs = {k: p for m in (30, 60) for k, p in ((f"_n{m}", (m, Moments(F.col("bid")))), (f"_f{m}", (m, Edge("bid", "_t"))), (f"_v{m}", (m, Extreme("sum", F.col("volume")))))}
    c = sliding(c, KEY, "_t", specs)
    c = c.withColumns({n: v for m in (30, 60) for n, v in (
        (f"bid_change_last_{m}min", F.when(F.col(f"_n{m}.n") >= 2, F.col("bid") - F.col(f"_f{m}.v.v")).cast("double")),
        (f"volume_last_{m}min", F.coalesce(F.col(f"_v{m}.v"), F.lit(0)).cast("double")))}).drop(*specs)
    c = prefix_scan(c, KEY, ["_t"], time_chunk("_t"), {"cumulative_volume_today": ("sum", "volume")})
    c = c.select(*KEY, "bucket_us", "j", F.col("bid").cast("double").alias("market_yes_bid"), F.col("ask").cast("double").alias("market_yes_ask"),
                 (F.col("ask") - F.col("bid")).cast("double").alias("market_bid_ask_spread"), ((F.col("ask") + F.col("bid")) / 2).alias("market_mid_price"),
                 F.col("oi").cast("double").alias("open_interest"), "bid_change_last_30min", "bid_change_last_60min", (F.col("bid_change_last_30min") * 2).alias("bid_momentum_30min"),
                 "volume_last_30min", "volume_last_60min", F.col("cumulative_volume_today").cast("double").alias("cumulative_volume_today"),
                 (F.col("volume_last_30min") > 0).cast("int").alias("has_recent_trade"))
    return Source(c, "bucket_us", {x: x for x in c.columns if x not in (*KEY, "bucket_us", "j")}, tie="j", inclusive=False)


@feature_group("candles_micro", "series")
def candles_micro(ctx):
    """Fifteen-minute microstructure of the event's quotes (see ``rolling.microstructure``)."""
    synthetic = F.col("is_synthetic").cast("double") if "is_synthetic" in ctx.candles.columns else F.lit(None).cast("double")
    c = ctx.candles.select("city", F.col("day").alias("event_date"), "bucket_us", (F.col("bucket_us") + F.col("j")).alias("_t"), "bid", "ask", "volume", synthetic.alias("synthetic"))
    m = rolling.microstructure(c, KEY, "_t", 15, own_row=True)
    names = {"c_logit_mid_last": "logit_last", "c_logit_mom_15m": "logit_mom", "c_logit_vol_15m": "logit_vol", "c_logit_surprise_15m": "logit_surprise",
             "c_spread_pct_mean_15m": "spread_pct", "c_mid_range_pct_15m": "mid_range_pct", "c_trade_frac_15m": "trade_frac", "c_synth_frac_15m": "synth_frac"}
    m = m.select(*KEY, "bucket_us", "_t", *[F.col(c).alias(n) for n, c in names.items()])
    return Source(m, "bucket_us", {n: n for n in names}, tie="_t", inclusive=False)


def guidance_runs(model):
    """As-of source of one model: at every run its high and that of the run before.

    An event has as many runs as the model has cycles in the days before it.
    """
    def source(ctx):
        if ctx.guidance is None:
            return None
        w = Window.partitionBy("city", "day").orderBy("run_us", "run_id")
        r = ctx.guidance.filter(F.col("model") == model).select("city", F.col("day").alias("event_date"), "run_us", "run_id", "peak_f", F.lag("peak_f").over(w).alias("before"))
        return Source(r, "run_us", {f"_{model}_latest": "peak_f", f"_{model}_previous": "before"}, tie="run_id")
    return source


for _model in ("nbm", "hrrr", "ndfd"):
    feature_group(f"guidance_{_model}", "series")(guidance_runs(_model))


@feature_group("guidance_history", "event")
def guidance_history(ctx):
    """Mean and deviation of the 15:00 observation over the 30 days before."""
    t15 = ctx.obs.filter("hour = 15 AND minute(ts) <= 15").groupBy("city", "day").agg(F.min_by("temp_f", "us").alias("x"))
    h = stats.prior_days(ctx.settle.select("city", "day", "di").join(t15, ["city", "day"], "left"), "city", "di", "x")
    return h.select("city", F.col("day").alias("event_date"), F.col("mean_f").alias("obs_t15_mean_30d_f"), F.col("std_f").alias("obs_t15_std_30d_f"))


@feature_group("guidance")
def guidance(s, ctx):
    """High of each model's latest run at the snapshot, its revision and z-scores."""
    models = ("nbm", "hrrr", "ndfd")
    if f"_{models[0]}_latest" not in s.columns or "obs_t15_mean_30d_f" not in s.columns:
        return s
    x = {m: X.guidance(f"_{m}_latest", f"_{m}_previous", "obs_t15_mean_30d_f", "obs_t15_std_30d_f") for m in models}
    s = s.withColumns({
        "nbm_peak_window_max_f": F.col("_nbm_latest"), "nbm_peak_window_revision_1h_f": x["nbm"]["revision"],
        "hrrr_peak_window_max_f": F.col("_hrrr_latest"), "hrrr_peak_window_revision_1h_f": x["hrrr"]["revision"],
        "ndfd_tmax_T1_f": F.col("_ndfd_latest"), "ndfd_drift_T2_to_T1_f": x["ndfd"]["drift"],
        "nbm_t15_z_30d_f": x["nbm"]["z"], "hrrr_t15_z_30d_f": x["hrrr"]["z"],
        "hrrr_minus_nbm_t15_z_30d_f": F.bround(x["hrrr"]["z"] - x["nbm"]["z"], 2),
        "hrrr_minus_nbm_peak_window_max_f": F.bround(F.col("_hrrr_latest") - F.col("_nbm_latest"), 2)})
    c = lambda n: F.col(n) if n in s.columns else F.lit(None).cast("double")
    s = s.withColumn("ndfd_minus_vc_T1_f", F.bround(F.col("_ndfd_latest") - c("fcst_prev_max_f"), 2))
    return s.drop(*[f"_{m}_{k}" for m in models for k in ("latest", "previous")])


@feature_group("lags", "event")
def lags(ctx):
    """Settled values of earlier calendar days (a missing day stays NULL)."""
    d = ctx.settle.select("city", "day", "settle_f", "vc_max_f")
    l = lags_by_date(d, ["city"], "day", ["settle_f", "vc_max_f"], [1, 2, 7]).drop("settle_f", "vc_max_f", "vc_max_f_lag2")
    return l.withColumnRenamed("day", "event_date")


@feature_group("derived")
def derived(s, ctx):
    c = lambda n: F.col(n) if n in s.columns else F.lit(None).cast("double")
    s = s.withColumn("delta_vcmax_lag1", c("vc_max_f_sofar") - c("vc_max_f_lag1"))
    s = s.withColumns(X.derived_forecast("fcst_prev_max_f", "vc_max_f_sofar", "fcst_peak_hour_float", "snapshot_hour"))
    s = s.withColumn("fcst_remaining_potential", F.when(F.col("obs_fcst_max_gap").isNotNull(), F.greatest(F.lit(0.0), F.col("obs_fcst_max_gap"))))
    s = s.withColumns(X.time_confidence("hours_since_market_open", "is_event_day", "vc_max_f_sofar", "fcst_prev_max_f"))
    s = s.withColumns(X.regime("temp_rate_last_30min", "minutes_since_max_observed", "snapshot_hour"))
    c = lambda n: F.col(n) if n in s.columns else F.lit(None).cast("double")
    return s.withColumns(X.interactions(c)).withColumns(X.engineered(c))


@feature_group("labels")
def labels(s, ctx):
    """delta = settlement - forecast high, and the older settlement - rounded maximum so far."""
    t = ctx.settle.select("city", F.col("day").alias("event_date"), "settle_f")
    s = s.join(t, KEY, "left")
    return s.withColumns({"delta": (F.col("settle_f") - F.bround("fcst_prev_max_f", 0)).cast("long"), "delta_obs": F.col("settle_f") - F.col("t_base")})
