"""Window functions and time-series operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.meteo import cloud_bins, cloud_regime
from ..functions.quality import valid_temp
from ..functions.timeutil import HOUR, MINUTE
from ..operators import equity as E
from ..operators import fill, rolling
from ..operators.chunked import numbered, prefix_scan, runs, time_chunk
from ..operators.joins import lags_by_date
from .aggregates import _BAD
from .joins import gaps
from .registry import query

N = F.lit


def daily(t):
    return gaps(t.settle).select("city", "day", "di", "settle_f", "vc_max_f")


@query("win_lag_rows", "city s, day d, lag1 i, lag2 i, lag7 i", """
SELECT city, day, lag(settle_f) OVER w AS lag1, lag(settle_f, 2) OVER w AS lag2, lag(settle_f, 7) OVER w AS lag7 FROM (SELECT city, CASE WHEN di % 9 = 4 THEN day + 40 ELSE day END AS day, settle_f FROM v_settle) WINDOW w AS (PARTITION BY city ORDER BY day)""")
def win_lag_rows(t):
    """One row per (city, day): bounded by the calendar."""
    w = Window.partitionBy("city").orderBy("day")
    return daily(t).select("city", "day", *[F.lag("settle_f", n).over(w).alias(f"lag{n}") for n in (1, 2, 7)])


@query("win_lag_calendar", "city s, day d, settle_f_lag1 i, settle_f_lag2 i, settle_f_lag7 i", """
WITH d AS (SELECT city, CASE WHEN di % 9 = 4 THEN day + 40 ELSE day END AS day, settle_f FROM v_settle) SELECT x.city, x.day, a.settle_f AS settle_f_lag1, b.settle_f AS settle_f_lag2, c.settle_f AS settle_f_lag7 FROM d x
LEFT JOIN d a ON a.city = x.city AND a.day = x.day - 1 LEFT JOIN d b ON b.city = x.city AND b.day = x.day - 2 LEFT JOIN d c ON c.city = x.city AND c.day = x.day - 7""")
def win_lag_calendar(t):
    return lags_by_date(daily(t), ["city"], "day", ["settle_f"], [1, 2, 7])


_T15 = "SELECT city, day, arg_min(temp_f, struct_pack(a := us, b := event_id)) AS x FROM v_obs WHERE hour = 15 GROUP BY city, day"


def t15(t):
    return t.obs.filter("hour = 15").groupBy("city", "day").agg(F.min_by("temp_f", F.struct("us", "event_id")).alias("x"))


@query("win_rolling_prior_rows", "city s, day d, mean_f f, std_f f", f"""
SELECT city, day, CASE WHEN count(x) OVER w >= 10 THEN avg(x) OVER w END AS mean_f, CASE WHEN count(x) OVER w >= 10 THEN stddev_pop(x) OVER w END AS std_f FROM ({_T15}) WINDOW w AS (PARTITION BY city ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""")
def win_rolling_prior_rows(t):
    w = Window.partitionBy("city").orderBy("day").rowsBetween(-30, -1)
    ok = F.count("x").over(w) >= 10
    return t15(t).select("city", "day", F.when(ok, F.avg("x").over(w)).alias("mean_f"), F.when(ok, F.stddev_pop("x").over(w)).alias("std_f"))


@query("win_rolling_prior_days", "city s, day d, mean_f f, std_f f", f"""
SELECT a.city, a.day, CASE WHEN count(b.x) >= 10 THEN avg(b.x) END AS mean_f, CASE WHEN count(b.x) >= 10 THEN stddev_pop(b.x) END AS std_f FROM v_settle a LEFT JOIN ({_T15}) b ON a.city = b.city AND b.day BETWEEN a.day - 30 AND a.day - 1 GROUP BY a.city, a.day""")
def win_rolling_prior_days(t):
    from ..operators.stats import prior_days
    return prior_days(t.settle.select("city", "day", "di").join(t15(t), ["city", "day"], "left"), "city", "di", "x")


@query("win_locf", "event_id i, fixed f, filled i", f"""
SELECT event_id, CASE WHEN bad AND c IS NOT NULL THEN c ELSE raw_f END AS fixed, (bad AND c IS NOT NULL)::INT AS filled FROM (
SELECT *, last_value(CASE WHEN NOT bad THEN raw_f END IGNORE NULLS) OVER (PARTITION BY city ORDER BY us, event_id) AS c FROM (SELECT *, coalesce({_BAD}, true) AS bad FROM v_obs))""")
def win_locf(t):
    return fill.locf(t.obs, ["city"], "us", "event_id", "raw_f", valid_temp("raw_f"), "fixed", "filled")


@query("win_smart_ffill", "event_id i, fixed f, filled i, excluded i", f"""
WITH b AS (SELECT *, coalesce({_BAD}, true) AS bad FROM v_obs), q AS (SELECT city, day, count(*) FILTER (bad) * 100.0e0 / count(*) >= 15 AS bd FROM b GROUP BY city, day),
c AS (SELECT b.*, bd, last_value(CASE WHEN NOT bad THEN raw_f END IGNORE NULLS) OVER (PARTITION BY city ORDER BY us, event_id) AS c FROM b JOIN q USING (city, day))
SELECT event_id, CASE WHEN bad AND NOT bd AND c IS NOT NULL THEN c ELSE raw_f END AS fixed, (bad AND NOT bd AND c IS NOT NULL)::INT AS filled, (bad AND bd)::INT AS excluded FROM c""")
def win_smart_ffill(t):
    return fill.locf_except_bad_days(t.obs, ["city"], "day", "us", "event_id", "raw_f", valid_temp("raw_f"), 15.0, "fixed", "filled", "excluded")


@query("win_fill_latest", "event_id i, fixed f", """
SELECT event_id, CASE WHEN us >= 1706486400000000 THEN coalesce(raw_f, l) ELSE raw_f END AS fixed FROM v_obs LEFT JOIN (SELECT city, arg_max(raw_f, us) FILTER (raw_f IS NOT NULL) AS l FROM v_obs GROUP BY city) USING (city)""")
def win_fill_latest(t):
    return fill.fill_latest(t.obs, ["city"], "us", "event_id", "raw_f", 1_706_486_400_000_000, "fixed")


_SPARSE = """SELECT mkt, bucket_us, bid_n AS bid, CASE WHEN bucket_us // 60000000 % 3 = 0 THEN NULL ELSE ask END AS ask, volume, 0 AS source_rank FROM v_candle
UNION ALL SELECT mkt, bucket_us, bid + 100, ask + 100, volume + 1, 1 FROM v_candle WHERE bucket_us // 60000000 % 2 = 0"""


def sparse(t):
    m = F.floor(F.col("bucket_us") / MINUTE)
    a = t.candle.select("mkt", "bucket_us", F.col("bid_n").alias("bid"), F.when(m % 3 == 0, None).otherwise(F.col("ask")).alias("ask"), "volume", N(0).alias("source_rank"))
    b = t.candle.filter(m % 2 == 0).select("mkt", "bucket_us", (F.col("bid") + 100).alias("bid"), (F.col("ask") + 100).alias("ask"), (F.col("volume") + 1).alias("volume"), N(1).alias("source_rank"))
    return a.unionByName(b)


@query("win_dense_grid", "mkt s, hour u, n i, n_synth i, n_trade i, bid_sum i, ask_sum i, bid_min i, vol i", f"""
WITH sp AS ({_SPARSE}), m AS (SELECT mkt, bucket_us, arg_min(bid, source_rank) FILTER (bid IS NOT NULL) AS bid, arg_min(ask, source_rank) FILTER (ask IS NOT NULL) AS ask, arg_min(volume, source_rank) FILTER (volume IS NOT NULL) AS volume FROM sp GROUP BY mkt, bucket_us),
s AS (SELECT m.mkt, min(bucket_us) AS lo0, max(bucket_us) AS hi0, greatest(min(bucket_us), any_value(listed_us)) AS lo1, least(max(bucket_us), any_value(close_us)) AS hi1 FROM m LEFT JOIN v_market k USING (mkt) GROUP BY m.mkt),
g AS (SELECT mkt, unnest(CASE WHEN lo1 <= hi1 THEN range(lo1, hi1 + 1, 60000000) ELSE range(lo0, hi0 + 1, 60000000) END) AS bucket_us FROM s),
d AS (SELECT g.mkt, g.bucket_us, m.volume, m.mkt IS NULL AS syn, last_value(bid IGNORE NULLS) OVER w AS bid, last_value(ask IGNORE NULLS) OVER w AS ask FROM g LEFT JOIN m USING (mkt, bucket_us) WINDOW w AS (PARTITION BY g.mkt ORDER BY g.bucket_us))
SELECT mkt, bucket_us - bucket_us % 3600000000 AS hour, count(*) AS n, count(*) FILTER (syn) AS n_synth, count(*) FILTER (coalesce(volume, 0) > 0) AS n_trade, sum(bid) AS bid_sum, sum(ask) AS ask_sum, min(bid) AS bid_min, sum(coalesce(volume, 0)) AS vol FROM d GROUP BY 1, 2""")
def win_dense_grid(t):
    d = fill.dense_grid(sparse(t), t.market, "mkt", ["bid", "ask"])
    return d.groupBy("mkt", (F.col("bucket_us") - F.pmod(F.col("bucket_us"), N(HOUR))).alias("hour")).agg(
        F.count(N(1)).alias("n"), F.sum("is_synthetic").alias("n_synth"), F.sum("has_trade").alias("n_trade"), F.sum("bid").alias("bid_sum"),
        F.sum("ask").alias("ask_sum"), F.min("bid").alias("bid_min"), F.sum("volume").alias("vol"))


@query("win_run_islands", "city s, day d, k i, run_min i, total_min i", """
WITH x AS (SELECT o.city, o.day, k, o.us, o.event_id, temp_f >= settle_f // 3 + k AS f FROM v_obs o JOIN v_settle s ON o.city = s.city AND o.day = s.day, range(-1, 2) r(k)),
g AS (SELECT *, row_number() OVER (PARTITION BY city, day, k ORDER BY us, event_id) - row_number() OVER (PARTITION BY city, day, k, f ORDER BY us, event_id) AS isl FROM x),
c AS (SELECT city, day, k, isl, count(*) AS n FROM g WHERE f GROUP BY ALL)
SELECT a.city, a.day, a.k, coalesce(max(n), 0) * 5 AS run_min, coalesce(sum(n), 0) * 5 AS total_min FROM (SELECT DISTINCT city, day, k FROM x) a LEFT JOIN c USING (city, day, k) GROUP BY ALL""")
def win_run_islands(t):
    s = t.settle.select("city", "day", F.floor(F.col("settle_f") / 3).alias("base"))
    x = t.obs.select("city", "day", "us", "event_id", "temp_f").join(s, ["city", "day"])
    x = x.select("city", "day", "us", "event_id", "temp_f", "base", F.explode(F.array(N(-1), N(0), N(1))).alias("k"))
    x = x.withColumn("f", (F.col("temp_f") >= F.col("base") + F.col("k")).cast("int"))
    r = runs(x, ["city", "day", "k"], ["us", "event_id"], time_chunk("us"), "f")
    c = r.groupBy("city", "day", "k", "run_id").agg(F.sum("f").alias("n"))
    return c.groupBy("city", "day", "k").agg((F.max("n") * 5).alias("run_min"), (F.sum("n") * 5).alias("total_min"))


@query("win_plateau", "city s, day d, plateau_k i", """
WITH r AS (SELECT city, day, us, event_id, CAST(round_even(temp_f / 10, 0) AS BIGINT) AS k FROM v_obs), g AS (SELECT *, row_number() OVER (PARTITION BY city, day ORDER BY us, event_id) - row_number() OVER (PARTITION BY city, day, k ORDER BY us, event_id) AS isl FROM r)
SELECT city, day, max(k) AS plateau_k FROM (SELECT city, day, k, count(*) AS c FROM g GROUP BY city, day, k, isl) WHERE c >= 4 GROUP BY city, day""")
def win_plateau(t):
    from ..operators.rules import plateau
    return plateau(t.obs.withColumn("temp_f", F.col("temp_f") / 10), 4)


@query("win_slope_30min", "city s, day d, slope_up f, slope_down f", """
SELECT city, day, max(d) AS slope_up, min(d) AS slope_down FROM (SELECT city, day, temp_f - lag(temp_f, 6) OVER (PARTITION BY city, day ORDER BY us, event_id) AS d FROM v_obs) GROUP BY city, day""")
def win_slope_30min(t):
    return rolling.row_slope(t.obs, ["city", "day"], ["us", "event_id"], "us", "temp_f", 6)


@query("win_second_max", "city s, day d, gap f", """
SELECT city, day, max(temp_f) FILTER (r = 1) - max(temp_f) FILTER (r = 2) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY city, day ORDER BY temp_f DESC) AS r FROM v_obs) WHERE r <= 2 GROUP BY city, day""")
def win_second_max(t):
    """Values are counted first; the top two then need one row per distinct value."""
    c = t.obs.groupBy("city", "day", "temp_f").agg(F.count(N(1)).alias("c"))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("city", "day").orderBy(F.desc("temp_f")))).filter("r <= 2")
    a = r.groupBy("city", "day").agg(F.max("temp_f").alias("m"), F.max(F.when(F.col("r") == 1, F.col("c"))).alias("c"), F.min("temp_f").alias("m2"), F.count(N(1)).alias("n"))
    return a.withColumn("gap", F.when(F.col("c") > 1, 0.0).when(F.col("n") > 1, F.col("m") - F.col("m2")))


@query("win_daypart_max", "city s, day d, morning f, afternoon f, evening f", """
SELECT city, day, max(temp_f) FILTER (hour < 12) AS morning, max(temp_f) FILTER (hour BETWEEN 12 AND 16) AS afternoon, max(temp_f) FILTER (hour >= 17) AS evening FROM v_obs GROUP BY city, day""")
def win_daypart_max(t):
    h = F.col("hour")
    m = lambda c: F.max(F.when(c, F.col("temp_f")))
    return t.obs.groupBy("city", "day").agg(m(h < 12).alias("morning"), m(h.between(12, 16)).alias("afternoon"), m(h >= 17).alias("evening"))


@query("win_time_range_stats", "event_id i, mean_30 f, std_30 f, max_30 f, mean_60 f, std_60 f, max_60 f, mean_120 f, std_120 f, max_120 f", """
SELECT event_id, avg(temp_f) OVER a AS mean_30, coalesce(stddev_samp(temp_f) OVER a, 0) AS std_30, max(temp_f) OVER a AS max_30, avg(temp_f) OVER b AS mean_60, coalesce(stddev_samp(temp_f) OVER b, 0) AS std_60, max(temp_f) OVER b AS max_60,
 avg(temp_f) OVER c AS mean_120, coalesce(stddev_samp(temp_f) OVER c, 0) AS std_120, max(temp_f) OVER c AS max_120 FROM v_obs
WINDOW a AS (PARTITION BY city ORDER BY us RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW), b AS (PARTITION BY city ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), c AS (PARTITION BY city ORDER BY us RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW)""")
def win_time_range_stats(t):
    return rolling.time_stats(t.obs, ["city"], "us", "temp_f")


_RATE = """SELECT *, CASE WHEN count(*) OVER a >= 2 THEN covar_samp(temp_f, (us - 1704067200000000) / 6e7) OVER a / var_pop((us - 1704067200000000) / 6e7) OVER a * 60 END AS rate, row_number() OVER (PARTITION BY city ORDER BY us) AS rn
FROM v_obs WINDOW a AS (PARTITION BY city ORDER BY us RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW)"""


@query("win_acceleration", "event_id i, rate h, accel h", f"""
WITH r AS ({_RATE}) SELECT r.event_id, r.rate, CASE WHEN r.rn >= 12 THEN r.rate - p.rate END AS accel FROM r ASOF LEFT JOIN r p ON r.city = p.city AND r.us - 1800000000 >= p.us""")
def win_acceleration(t):
    return rolling.acceleration(t.obs.select("city", "us", "event_id", "temp_f"), ["city"], "us", "temp_f")


@query("win_volatility", "event_id i, vol_30 f, vol_60 f, range_sofar f, cv_sofar f", """
SELECT event_id, stddev_samp(temp_f) OVER a AS vol_30, stddev_samp(temp_f) OVER b AS vol_60, max(temp_f) OVER c - min(temp_f) OVER c AS range_sofar, stddev_samp(temp_f) OVER c / avg(temp_f) OVER c AS cv_sofar FROM v_obs
WINDOW a AS (PARTITION BY city, day ORDER BY us RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW), b AS (PARTITION BY city, day ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), c AS (PARTITION BY city, day ORDER BY us)""")
def win_volatility(t):
    return rolling.volatility(t.obs, ["city", "day"], "us", "temp_f")


@query("win_minutes_since_max", "event_id i, run_max f, since_max_min f", """
WITH m AS (SELECT *, max(temp_f) OVER (PARTITION BY city, day ORDER BY us) AS run_max FROM v_obs)
SELECT a.event_id, any_value(a.run_max) AS run_max, (any_value(a.us) - max(b.us)) / 6e7 AS since_max_min FROM m a JOIN m b ON a.city = b.city AND a.day = b.day AND b.us <= a.us AND abs(b.temp_f - a.run_max) < 0.01e0 GROUP BY a.event_id""")
def win_minutes_since_max(t):
    return rolling.minutes_since_max(t.obs, ["city", "day"], "us", "temp_f")


@query("win_half_trend", "city s, day d, n i, trend f", """
SELECT city, day, count(*) AS n, avg(temp_f) FILTER (rn > n // 2) - avg(temp_f) FILTER (rn <= n // 2) AS trend FROM (SELECT *, row_number() OVER (PARTITION BY city, day ORDER BY us, event_id) AS rn, count(*) OVER (PARTITION BY city, day) AS n FROM v_obs) GROUP BY city, day""")
def win_half_trend(t):
    k = ["city", "day"]
    d = numbered(t.obs.select(*k, "us", "event_id", "temp_f"), k, ["us", "event_id"], time_chunk("us"))
    d = d.join(t.obs.groupBy(*k).agg(F.count(N(1)).alias("n")), k)
    late = F.col("rn") > F.floor(F.col("n") / 2)
    return d.groupBy(*k).agg(F.max("n").alias("n"), (F.avg(F.when(late, F.col("temp_f"))) - F.avg(F.when(~late, F.col("temp_f")))).alias("trend"))


@query("win_gap_quality", "city s, day d, n i, missing f, max_gap_min f, edge_max i", """
WITH r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY city, day) AS n, us - lag(us) OVER w AS g FROM v_obs WINDOW w AS (PARTITION BY city, day ORDER BY us, event_id)),
a AS (SELECT city, day, max(n) AS n, max(us) - min(us) AS span, max(g) / 6e7 AS max_gap_min, arg_max(i, struct_pack(a := temp_f, b := -i)) AS mi FROM r GROUP BY city, day)
SELECT city, day, n, 1 - n * 1.0e0 / greatest(span // 300000000 + 1, n) AS missing, max_gap_min, CASE WHEN n >= 3 THEN (mi < greatest(1, n // 10) OR mi >= n - greatest(1, n // 10))::INT END AS edge_max FROM a""")
def win_gap_quality(t):
    k = ["city", "day"]
    d = prefix_scan(t.obs.select(*k, "us", "event_id", "temp_f"), k, ["us", "event_id"], time_chunk("us"), {"i": ("count", N(1)), "p": ("last", F.col("us"))}, inclusive=False)
    g = d.groupBy(*k).agg(F.count(N(1)).alias("n"), (F.max("us") - F.min("us")).alias("span"), (F.max(F.col("us") - F.col("p")) / 6e7).alias("max_gap_min"), F.max_by("i", F.struct(F.col("temp_f"), -F.col("i"))).alias("mi"))
    n, edge = F.col("n"), F.greatest(N(1), F.floor(F.col("n") / 10))
    return g.withColumns({"missing": 1 - n / F.greatest(F.floor(F.col("span") / (5 * MINUTE)) + 1, n), "edge_max": F.when(n >= 3, ((F.col("mi") < edge) | (F.col("mi") >= n - edge)).cast("int"))})


@query("win_last_hour", "event_id i, change f, max_n f, min_n f", """
SELECT event_id, CASE WHEN rn >= 12 THEN temp_f - f END AS change, CASE WHEN rn >= 12 THEN mx END AS max_n, CASE WHEN rn >= 12 THEN mn END AS min_n FROM (SELECT event_id, temp_f, row_number() OVER (PARTITION BY city, day ORDER BY us, event_id) AS rn, first_value(temp_f) OVER w AS f, max(temp_f) OVER w AS mx, min(temp_f) OVER w AS mn
FROM v_obs WINDOW w AS (PARTITION BY city, day ORDER BY us, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))""")
def win_last_hour(t):
    return rolling.last_rows(t.obs, ["city", "day"], ["us", "event_id"], "us", "temp_f", 12)


@query("win_latest_two_runs", "city s, day d, model s, latest f, previous f, n i", """
SELECT city, day, model, max(peak_f) FILTER (r = 1) AS latest, max(peak_f) FILTER (r = 2) AS previous, max(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY city, day, model ORDER BY run_id DESC) AS r, count(*) OVER (PARTITION BY city, day, model) AS n FROM v_run) GROUP BY ALL""")
def win_latest_two_runs(t):
    from ..operators.stats import latest_two
    return latest_two(t.run, ["city", "day", "model"], "run_id", "peak_f")


@query("win_microstructure", "mkt s, bucket_us u, logit_last f, logit_mom f, logit_vol f, logit_surprise f, spread_pct f, mid_range_pct f, trade_frac f", """
WITH c AS (SELECT mkt, bucket_us, bid, ask, volume, (bid + ask) * 0.5e0 AS mid, ln(least(greatest((bid + ask) * 0.5e0 / 100, 1e-6), 1 - 1e-6) / (1 - least(greatest((bid + ask) * 0.5e0 / 100, 1e-6), 1 - 1e-6))) AS lm FROM v_candle),
j AS (SELECT a.mkt, a.bucket_us AS t, b.bucket_us AS u, b.lm, b.mid, (b.ask - b.bid) / greatest(b.mid, 1e-6) AS sp, (b.volume > 0)::INT AS tr, b.lm - lag(b.lm) OVER (PARTITION BY a.mkt, a.bucket_us ORDER BY b.bucket_us) AS d FROM c a JOIN c b ON a.mkt = b.mkt AND b.bucket_us >= a.bucket_us - 14400000000 AND b.bucket_us < a.bucket_us),
s AS (SELECT mkt, t, count(*) AS n, arg_max(lm, u) AS l, arg_max(lm, u) - arg_min(lm, u) AS m, stddev_samp(d) AS v, avg(sp) AS sp, (max(mid) - min(mid)) / greatest(avg(mid), 1e-6) AS rg, avg(tr) AS tf FROM j GROUP BY mkt, t)
SELECT c.mkt, c.bucket_us, l AS logit_last, m AS logit_mom, v AS logit_vol, abs(m) / (v + 1e-6) AS logit_surprise, sp AS spread_pct, rg AS mid_range_pct, tf AS trade_frac FROM c LEFT JOIN s ON c.mkt = s.mkt AND c.bucket_us = s.t AND s.n >= 3""")
def win_microstructure(t):
    return rolling.microstructure(t.candle, ["mkt"], "bucket_us", minutes=240)


@query("win_market_momentum", "mkt s, bucket_us u, spread f, mid f, bid_change_60 f, volume_60 f, bid_change_240 f, volume_240 f, cum_volume i, recent_trade i, momentum f", """
SELECT mkt, bucket_us, ask - bid AS spread, (ask + bid) / 2 AS mid, CASE WHEN count(*) OVER a >= 2 THEN bid - first_value(bid) OVER a END AS bid_change_60, sum(volume) OVER a AS volume_60, CASE WHEN count(*) OVER b >= 2 THEN bid - first_value(bid) OVER b END AS bid_change_240, sum(volume) OVER b AS volume_240,
 sum(volume) OVER (PARTITION BY mkt ORDER BY bucket_us) AS cum_volume, (sum(volume) OVER a > 0)::INT AS recent_trade, 2 * CASE WHEN count(*) OVER a >= 2 THEN bid - first_value(bid) OVER a END AS momentum FROM v_candle
WINDOW a AS (PARTITION BY mkt ORDER BY bucket_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), b AS (PARTITION BY mkt ORDER BY bucket_us RANGE BETWEEN 14400000000 PRECEDING AND CURRENT ROW)""")
def win_market_momentum(t):
    return rolling.market_momentum(t.candle, ["mkt"], "bucket_us", windows=(60, 240))


@query("win_interpolate_positional", "event_id i, cloud_i f", """
WITH u AS (SELECT DISTINCT city, us FROM (SELECT city, us FROM v_obs UNION ALL SELECT city, us FROM v_fcst_hourly)), n AS (SELECT u.city, u.us, h.cloud AS v, row_number() OVER (PARTITION BY u.city ORDER BY u.us) AS rn FROM u LEFT JOIN v_fcst_hourly h ON h.city = u.city AND h.us = u.us),
k AS (SELECT * FROM n WHERE v IS NOT NULL), j AS (SELECT n.city, n.us, n.rn, a.rn AS r0, a.v AS v0, b.rn AS r1, b.v AS v1 FROM n ASOF LEFT JOIN k a ON n.city = a.city AND n.rn >= a.rn ASOF LEFT JOIN k b ON n.city = b.city AND n.rn <= b.rn)
SELECT o.event_id, CASE WHEN r0 IS NULL THEN v1 WHEN r1 IS NULL OR r1 = r0 THEN v0 ELSE v0 + (rn - r0) * 1.0e0 / (r1 - r0) * (v1 - v0) END AS cloud_i FROM v_obs o JOIN j ON o.city = j.city AND o.us = j.us""")
def win_interpolate_positional(t):
    return fill.interpolate_positional(t.obs.select("city", "us", "event_id"), t.fcst_hourly, ["city"], "us", "us", "cloud", "cloud_i")


@query("win_interpolate_time", "city s, us u, cc f, regime s, regime_code i, clear_flag i", """
WITH h AS (SELECT city, us, avg(cloud) AS v FROM (SELECT city, us, cloud FROM v_fcst_hourly UNION ALL SELECT city, us, cloud + 2 FROM v_fcst_hourly) GROUP BY ALL),
u AS (SELECT DISTINCT city, us FROM (SELECT city, us FROM v_snap UNION ALL SELECT city, us FROM h)), n AS (SELECT u.city, u.us, h.v, row_number() OVER (PARTITION BY u.city ORDER BY u.us) AS rn FROM u LEFT JOIN h USING (city, us)), k AS (SELECT * FROM n WHERE v IS NOT NULL),
j AS (SELECT n.city, n.us, n.rn, a.rn AS r0, a.v AS v0, b.rn AS r1, b.v AS v1 FROM n ASOF LEFT JOIN k a ON n.city = a.city AND n.rn >= a.rn ASOF LEFT JOIN k b ON n.city = b.city AND n.rn <= b.rn),
c AS (SELECT s.city, s.us, CASE WHEN r0 IS NULL THEN v1 WHEN r1 IS NULL OR r1 = r0 THEN v0 ELSE v0 + (rn - r0) * 1.0e0 / (r1 - r0) * (v1 - v0) END AS cc FROM v_snap s JOIN j ON s.city = j.city AND s.us = j.us)
SELECT *, CASE WHEN cc <= 20 THEN 'clear' WHEN cc <= 70 THEN 'partly' WHEN cc <= 101 THEN 'overcast' END AS regime, CASE WHEN cc < 20 THEN 0 WHEN cc < 70 THEN 1 ELSE 2 END AS regime_code, (cc < 20)::INT AS clear_flag FROM c""")
def win_interpolate_time(t):
    h = t.fcst_hourly.select("city", "us", "cloud").union(t.fcst_hourly.select("city", "us", F.col("cloud") + 2))
    c = fill.interpolate_positional(t.snap.select("city", "us"), h, ["city"], "us", "us", "cloud", "cc")
    return c.withColumns({"regime": cloud_bins("cc"), "regime_code": cloud_regime("cc"), "clear_flag": F.col("cc") < 20})


@query("win_interpolate_small_gaps", "event_id i, fixed f", """
WITH n AS (SELECT city, day, event_id, CASE WHEN event_id // 40 % 3 = 0 THEN NULL ELSE raw_f END AS v, row_number() OVER (PARTITION BY city, day ORDER BY us, event_id) AS rn FROM v_obs), k AS (SELECT * FROM n WHERE v IS NOT NULL),
j AS (SELECT n.*, a.rn AS r0, a.v AS v0, b.rn AS r1, b.v AS v1 FROM n ASOF LEFT JOIN k a ON n.city = a.city AND n.day = a.day AND n.rn >= a.rn ASOF LEFT JOIN k b ON n.city = b.city AND n.day = b.day AND n.rn <= b.rn)
SELECT event_id, CASE WHEN v IS NOT NULL THEN v WHEN coalesce(rn - r0 <= 3, false) OR coalesce(r1 - rn <= 3, false) THEN CASE WHEN r0 IS NULL THEN v1 WHEN r1 IS NULL THEN v0 ELSE v0 + (rn - r0) * 1.0e0 / (r1 - r0) * (v1 - v0) END END AS fixed FROM j""")
def win_interpolate_small_gaps(t):
    o = t.obs.select("city", "day", "us", "event_id", F.when(F.floor(F.col("event_id") / 40) % 3 == 0, None).otherwise(F.col("raw_f")).alias("v"))
    return fill.interpolate_small_gaps(o, ["city", "day"], "us", "event_id", "v", "fixed")


_W60 = "WINDOW h AS (PARTITION BY city ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), q AS (PARTITION BY city ORDER BY us RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW)"


@query("win_meteo_last_window", "event_id i, humidity f, humidity_mean_60 f, humidity_std_60 f, wind f, wind_max_60 f, cloud_mean_60 f, high_humidity i, strong_wind i, high_cloud i, clear_sky i", f"""
SELECT event_id, humidity, avg(humidity) OVER h AS humidity_mean_60, coalesce(stddev_samp(humidity) OVER h, 0) AS humidity_std_60, wind, max(wind) OVER h AS wind_max_60, avg(cloud) OVER h AS cloud_mean_60, (humidity > 80)::INT AS high_humidity, (wind > 15)::INT AS strong_wind, (cloud > 70)::INT AS high_cloud, (cloud < 20)::INT AS clear_sky FROM v_obs {_W60}""")
def win_meteo_last_window(t):
    return rolling.meteo_window(t.obs, ["city"], "us")


@query("win_meteo_trends", "event_id i, cloud_change f, humidity_change f, wind_increasing i", f"""
SELECT event_id, CASE WHEN count(*) OVER h >= 2 THEN cloud - first_value(cloud) OVER h END AS cloud_change, CASE WHEN count(*) OVER h >= 2 THEN humidity - first_value(humidity) OVER h END AS humidity_change, CASE WHEN count(*) OVER h >= 2 THEN (wind > first_value(wind) OVER h + 2)::INT END AS wind_increasing FROM v_obs {_W60}""")
def win_meteo_trends(t):
    return rolling.meteo_trends(t.obs, ["city"], "us")


_WB = """SELECT *, ((temp_f - 32) * 5 / 9 * atan(0.151977e0 * sqrt(humidity + 8.313659e0)) + atan((temp_f - 32) * 5 / 9 + humidity) - atan(humidity - 1.676331e0) + 0.00391838e0 * pow(humidity, 1.5e0) * atan(0.023101e0 * humidity) - 4.686035e0) * 9 / 5 + 32 AS wb,
 CASE WHEN temp_f > 50 OR wind < 3 THEN temp_f ELSE 35.74e0 + 0.6215e0 * temp_f - 35.75e0 * pow(wind, 0.16e0) + 0.4275e0 * temp_f * pow(wind, 0.16e0) END AS wc FROM v_obs"""


@query("win_meteo_advanced", "event_id i, wb f, wb_mean_60 f, wb_depression f, wb_depression_mean_60 f, high_wb i, wb_rate_30 f, wc_last f, wc_depression f, strong_wc i, wc_mean_60 f, wc_rate_30 f, cloud_rate_30 f, cloud_vol_60 f, cloud_stability f, clearing i, clouding i, cloud_regime i", f"""
SELECT event_id, wb, avg(wb) OVER h AS wb_mean_60, temp_f - wb AS wb_depression, avg(temp_f - wb) OVER h AS wb_depression_mean_60, (wb > 75)::INT AS high_wb, CASE WHEN count(*) OVER q >= 2 THEN (wb - first_value(wb) OVER q) / ((us - first_value(us) OVER q) / 1e6) * 3600 END AS wb_rate_30,
 CASE WHEN temp_f <= 50 THEN wc END AS wc_last, CASE WHEN temp_f <= 50 THEN temp_f - wc END AS wc_depression, CASE WHEN temp_f <= 50 THEN (temp_f - wc > 10)::INT END AS strong_wc, avg(wc) OVER h AS wc_mean_60, CASE WHEN count(*) OVER q >= 2 THEN (wc - first_value(wc) OVER q) / ((us - first_value(us) OVER q) / 1e6) * 3600 END AS wc_rate_30,
 CASE WHEN count(*) OVER q >= 2 THEN (cloud - first_value(cloud) OVER q) / 0.5e0 END AS cloud_rate_30, stddev_samp(cloud) OVER h AS cloud_vol_60, CASE WHEN count(*) OVER h >= 2 THEN 1 - least(1, stddev_samp(cloud) OVER h / 100) END AS cloud_stability, CASE WHEN count(*) OVER h >= 2 THEN (cloud - first_value(cloud) OVER h < -20)::INT END AS clearing,
 CASE WHEN count(*) OVER h >= 2 THEN (cloud - first_value(cloud) OVER h > 20)::INT END AS clouding, CASE WHEN cloud < 20 THEN 0 WHEN cloud < 70 THEN 1 ELSE 2 END AS cloud_regime FROM ({_WB}) {_W60}""")
def win_meteo_advanced(t):
    d = rolling.meteo_advanced(t.obs, ["city"], "us")
    return d.withColumn("cloud_stability", F.when(F.col("cloud_vol_60").isNotNull(), F.col("cloud_stability")))


@query("win_first_last_change", "event_id i, rate f", f"""
SELECT event_id, CASE WHEN count(*) OVER q >= 2 THEN (temp_f - first_value(temp_f) OVER q) / ((us - first_value(us) OVER q) / 1e6) * 3600 END AS rate FROM v_obs {_W60}""")
def win_first_last_change(t):
    from ..operators.chunked import framed

    def exprs(w):
        q = w.rangeBetween(-30 * MINUTE, 0)
        secs = (F.col("us") - F.first("us").over(q)) / 1e6
        return {"rate": F.when(F.count(N(1)).over(q) >= 2, (F.col("temp_f") - F.first("temp_f").over(q)) / F.nullif(secs, N(0.0)) * 3600)}
    return framed(t.obs.select("city", "us", "event_id", "temp_f"), ["city"], "us", ["us"], exprs, 30 * MINUTE)


ORD = ["ok", "ln", "pk", "sk"]


@query("win_cumulative_pnl", "city s, day d, ok i, ln i, pk i, sk i, cum_pnl i, halted i", """
SELECT city, day, ok, ln, pk, sk, sum(pnl) OVER w AS cum_pnl, (sum(pnl) OVER w <= -300)::INT AS halted FROM v_bt WINDOW w AS (PARTITION BY city, day ORDER BY ok, ln, pk, sk ROWS UNBOUNDED PRECEDING)""")
def win_cumulative_pnl(t):
    b = t.bt.select("city", "day", *ORD, "pnl")
    return E.cumulative_pnl(b, ["city", "day"], ORD, "pnl", 300)


@query("win_position_limits", "city s, ok i, ln i, pk i, sk i, pos_at i, sign i, n_open i, n_total i, allowed i", """
WITH e AS (SELECT city, ok, ln, pk, sk, ok * 10 AS at_, 1 AS sign FROM v_bt UNION ALL SELECT city, ok, ln, pk, sk, ok * 10 + n, -1 FROM v_bt),
r AS (SELECT *, sum(sign) OVER (PARTITION BY city ORDER BY at_, sign, ok, ln, pk, sk ROWS UNBOUNDED PRECEDING) AS n_open, sum(sign) OVER (ORDER BY at_, sign, ok, ln, pk, sk, city ROWS UNBOUNDED PRECEDING) AS n_total FROM e)
SELECT city, ok, ln, pk, sk, at_ AS pos_at, sign, n_open, n_total, (n_open < 3 AND n_total < 12)::INT AS allowed FROM r""")
def win_position_limits(t):
    o = t.bt.withColumn("p", F.col("ok") * 10)
    c = t.bt.withColumn("p", F.col("ok") * 10 + F.col("n"))
    return E.open_positions(o, c, ["city"], "p", ORD, (3, 12))


@query("win_equity_drawdown", "city s, n i, final_equity f, max_dd f, max_dd_pct f, profit_factor f, avg_win f, avg_loss f, sharpe f", """
WITH e AS (SELECT *, 10000 + sum(pnl) OVER w AS eq FROM v_bt WINDOW w AS (PARTITION BY city ORDER BY day, ok, ln, pk, sk ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(10000, max(eq) OVER (PARTITION BY city ORDER BY day, ok, ln, pk, sk ROWS UNBOUNDED PRECEDING)) AS pk_ FROM e), d AS (SELECT city, day, sum(pnl) AS p FROM v_bt GROUP BY ALL), sh AS (SELECT city, avg(p) / stddev_samp(p) * sqrt(250) AS sharpe FROM d GROUP BY city),
a AS (SELECT city, count(*) AS n, 10000 + sum(pnl) AS final_equity, min(eq - pk_) AS max_dd, arg_min(pk_, struct_pack(a := eq - pk_, b := day, c := ok, d := ln, e := pk, f := sk)) AS at_, sum(pnl) FILTER (pnl > 0) * 1.0e0 / -sum(pnl) FILTER (pnl < 0) AS profit_factor, avg(pnl) FILTER (pnl > 0) AS avg_win, avg(pnl) FILTER (pnl < 0) AS avg_loss FROM p GROUP BY city)
SELECT a.city, n, final_equity, max_dd, max_dd * 100.0e0 / at_ AS max_dd_pct, profit_factor, avg_win, avg_loss, sharpe FROM a JOIN sh USING (city)""")
def win_equity_drawdown(t):
    b = t.bt.select("city", "day", *ORD, "pnl")
    return E.drawdown(b, ["city"], ["day", *ORD], "pnl", "day")


@query("win_equity_kelly_fold", "city s, day d, ok i, ln i, pk i, sk i, bet f, equity f", """
WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY city, day ORDER BY ok, ln, pk, sk) AS i FROM v_bt),
r AS (SELECT city, day, ok, ln, pk, sk, i, least(greatest(0.1e0 * (2 * prob - 1) * 10000, 0), 50) AS bet, 10000 + pnl / 100 * (least(greatest(0.1e0 * (2 * prob - 1) * 10000, 0), 50) / (price / 100)) AS equity FROM s WHERE i = 1
 UNION ALL SELECT s.city, s.day, s.ok, s.ln, s.pk, s.sk, s.i, least(greatest(0.1e0 * (2 * prob - 1) * r.equity, 0), 50), r.equity + pnl / 100 * (least(greatest(0.1e0 * (2 * prob - 1) * r.equity, 0), 50) / (price / 100)) FROM r JOIN s ON s.city = r.city AND s.day = r.day AND s.i = r.i + 1)
SELECT city, day, ok, ln, pk, sk, bet, equity FROM r""")
def win_equity_kelly_fold(t):
    return E.kelly_equity(t.bt, ["city", "day"], ORD)
