"""Joins (J1-J24)."""

from pyspark.sql import functions as F

from ..functions.timeutil import HOUR, MINUTE
from ..operators import brackets as B
from ..operators import joins as J
from ..operators.asof import asof, asof_nearest, interpolate_at
from ..operators.strategies import forecast_at_basis
from .registry import query

N = F.lit


@query("join_fcst_obs_hour", "city s, day d, hour i, fcst_f f, obs_f f", """
SELECT f.city, f.day, f.hour, f.temp_f AS fcst_f, o.obs_f FROM v_fcst_hourly f JOIN (
SELECT city, day, hour, sum(CAST(round(temp_f * 100) AS BIGINT)) / count(temp_f) / 100 AS obs_f FROM v_obs GROUP BY ALL) o USING (city, day, hour)""")
def join_fcst_obs_hour(t):
    return J.forecast_with_hourly_obs(t.fcst_hourly, t.obs)


def gaps(settle):
    """Every ninth day of the settlements moved past the others: gaps without dropping a row."""
    move = F.when(F.col("di") % 9 == 4, 40).otherwise(0)
    return settle.withColumns({"day": F.date_add("day", move), "di": F.col("di") + move})


@query("join_lags_left", "city s, day d, hour i, settle_f_lag1 i, settle_f_lag2 i, settle_f_lag7 i, vc_max_f_lag1 f", """
WITH d AS (SELECT city, CASE WHEN di % 9 = 4 THEN day + 40 ELSE day END AS day, settle_f, vc_max_f FROM v_settle)
SELECT s.city, s.day, s.hour, a.settle_f AS settle_f_lag1, b.settle_f AS settle_f_lag2, c.settle_f AS settle_f_lag7, a.vc_max_f AS vc_max_f_lag1
FROM v_snap s LEFT JOIN d x ON x.city = s.city AND x.day = s.day
LEFT JOIN d a ON a.city = x.city AND a.day = x.day - 1 LEFT JOIN d b ON b.city = x.city AND b.day = x.day - 2 LEFT JOIN d c ON c.city = x.city AND c.day = x.day - 7""")
def join_lags_left(t):
    daily = gaps(t.settle).select("city", "day", "settle_f", "vc_max_f")
    lags = J.lags_by_date(daily, ["city"], "day", ["settle_f", "vc_max_f"], [1, 2, 7]).drop("settle_f", "vc_max_f")
    return t.snap.select("city", "day", "hour").join(lags, ["city", "day"], "left")


@query("join_features_left", "city s, day d, hour i, temp_f f, cloud f", """
SELECT s.city, s.day, s.hour, h.temp_f, h.cloud + 1 AS cloud FROM v_snap s LEFT JOIN v_fcst_hourly h USING (city, day, hour)""")
def join_features_left(t):
    old = t.snap.withColumn("cloud", N(0.0))
    new = t.fcst_hourly.select("city", "day", "hour", "temp_f", (F.col("cloud") + 1).alias("cloud"))
    return old.drop("cloud").join(new, ["city", "day", "hour"], "left")


@query("join_full_outer", "day d, n_obs i, n_run i", """
SELECT coalesce(a.day, b.day) AS day, a.n AS n_obs, b.n AS n_run FROM (SELECT day, count(*) n FROM v_obs GROUP BY day) a FULL JOIN (SELECT day, count(*) n FROM v_run GROUP BY day) b ON a.day = b.day""")
def join_full_outer(t):
    c = lambda d: d.groupBy("day").agg(F.count(N(1)).alias("n"))
    return J.full_outer(c(t.obs), c(t.run), ["day"], ("_obs", "_run"))


@query("join_exact_time", "city s, us u, a f, b f", """
SELECT a.city, a.us, a.temp_f AS a, b.temp_f AS b FROM v_obs a JOIN v_obs2 b ON a.city = b.city AND a.us = b.us AND a.event_id = b.event_id""")
def join_exact_time(t):
    b = t.obs2.select("city", "us", "event_id", F.col("temp_f").alias("b"))
    return t.obs.select("city", "us", "event_id", F.col("temp_f").alias("a")).join(b, ["city", "us", "event_id"])


_SNAPJ = "SELECT s.city, s.day, s.us, j, s.city || '|' || strftime(s.day, '%Y%m%d') || '|' || j AS mkt FROM v_snap s, range(6) r(j)"


def snap_markets(t):
    """Every snapshot against each of the event's six brackets."""
    return t.snap.select("city", "day", "us", F.explode(F.array(*[N(i) for i in range(6)])).alias("j")).withColumn(
        "mkt", F.concat_ws("|", "city", F.date_format("day", "yyyyMMdd"), F.col("j").cast("string")))


@query("asof_latest_quote", "mkt s, us u, bid i, ask i, match_us u", f"""
SELECT s.mkt, s.us, c.bid, c.ask, c.bucket_us AS match_us FROM ({_SNAPJ}) s ASOF LEFT JOIN v_candle c ON s.mkt = c.mkt AND s.us >= c.bucket_us""")
def asof_latest_quote(t):
    return asof(snap_markets(t), t.candle, ["mkt"], "us", "bucket_us", {"bid": "bid", "ask": "ask"})


@query("asof_backward_tolerance", "mkt s, us u, price i, match_us u", f"""
SELECT s.mkt, s.us, CASE WHEN s.us - c.bucket_us <= 1800000000 THEN coalesce(c.bid_n, c.ask) END AS price, CASE WHEN s.us - c.bucket_us <= 1800000000 THEN c.bucket_us END AS match_us
FROM ({_SNAPJ}) s ASOF LEFT JOIN v_candle c ON s.mkt = c.mkt AND s.us >= c.bucket_us""")
def asof_backward_tolerance(t):
    return asof(snap_markets(t), t.candle, ["mkt"], "us", "bucket_us", {"price": F.coalesce("bid_n", "ask")}, tolerance=30 * MINUTE)


@query("asof_nearest", "mkt s, us u, bid i, match_us u", f"""
SELECT s.mkt, s.us, c.bid, c.bucket_us AS match_us FROM ({_SNAPJ}) s LEFT JOIN v_candle c ON s.mkt = c.mkt AND abs(s.us - c.bucket_us) <= 1800000000
QUALIFY row_number() OVER (PARTITION BY s.mkt, s.us ORDER BY abs(s.us - c.bucket_us), c.bucket_us) = 1""")
def asof_nearest_q(t):
    return asof_nearest(snap_markets(t), t.candle, ["mkt"], "us", "bucket_us", {"bid": "bid"}, 30 * MINUTE)


@query("asof_forward_first", "mkt s, us u, bid i, match_us u", f"""
SELECT s.mkt, s.us, c.bid_n AS bid, c.bucket_us AS match_us FROM ({_SNAPJ}) s LEFT JOIN v_candle c ON s.mkt = c.mkt AND c.bid_n IS NOT NULL AND c.bucket_us >= s.us AND c.bucket_us <= s.us + 7200000000
QUALIFY row_number() OVER (PARTITION BY s.mkt, s.us ORDER BY c.bucket_us) = 1""")
def asof_forward_first(t):
    return asof(snap_markets(t), t.candle.filter("bid_n IS NOT NULL"), ["mkt"], "us", "bucket_us", {"bid": "bid_n"},
                tolerance=2 * HOUR, direction="forward")


_BR = """SELECT o.event_id, m.ticker, m.strike_type FROM v_obs o JOIN v_market m USING (city, day)
WHERE (m.strike_type = 'between' AND round_even(o.temp_f, 0) BETWEEN m.floor_s AND m.cap_s) OR (m.strike_type = 'less' AND round_even(o.temp_f, 0) < m.cap_s)
 OR (m.strike_type = 'greater' AND round_even(o.temp_f, 0) > m.floor_s)
QUALIFY row_number() OVER (PARTITION BY o.event_id ORDER BY CASE m.strike_type WHEN 'between' THEN 0 WHEN 'less' THEN 1 ELSE 2 END) = 1"""


@query("join_bracket_range", "event_id i, ticker s, strike_type s", _BR)
def join_bracket_range(t):
    o = t.obs.select("event_id", "city", "day", F.bround("temp_f", 0).alias("x"))
    return B.join_bracket(o, t.market, ["city", "day"], "x", ["ticker", "strike_type"])


@query("join_atm_bracket", "city s, day d, fcst_f f, ticker s", """
SELECT f.city, f.day, f.tempmax_f AS fcst_f, m.ticker FROM v_fcst f JOIN v_market m USING (city, day)
WHERE f.lead = 1 AND m.strike_type = 'between' AND f.tempmax_f + 0.5 > m.floor_s AND f.tempmax_f + 0.5 <= m.cap_s""")
def join_atm_bracket(t):
    f = t.fcst.filter("lead = 1").select("city", "day", F.col("tempmax_f").alias("fcst_f"), (F.col("tempmax_f") + 0.5).alias("x"))
    return B.join_bracket(f, t.market, ["city", "day"], "x", ["ticker"], mode="left_open", kinds=["between"])


@query("join_snapshot_obs", "city s, day d, hour i, n_today i, n_both i, max_today f, max_both f", """
SELECT s.city, s.day, s.hour, count(*) FILTER (o.day = s.day) AS n_today, count(*) AS n_both, max(temp_f) FILTER (o.day = s.day) AS max_today, max(temp_f) AS max_both
FROM v_snap s JOIN v_obs o ON o.city = s.city AND o.day BETWEEN s.day - 1 AND s.day AND o.us <= s.us GROUP BY ALL""")
def join_snapshot_obs(t):
    """Rows of D-1 and D up to the cutoff, as a day total plus a running part of D."""
    from ..operators.cumulative import so_far
    today = so_far(t.obs, t.snap, {"n_today": ("sum", N(1)), "max_today": ("max", F.col("temp_f"))})
    prev = t.obs.groupBy("city", F.date_add("day", 1).alias("day")).agg(F.count(N(1)).alias("pn"), F.max("temp_f").alias("pm"))
    j = t.snap.select("city", "day", "hour").join(today, ["city", "day", "hour"], "left").join(prev, ["city", "day"], "left")
    z = lambda c: F.coalesce(F.col(c), N(0))
    return j.select("city", "day", "hour", z("n_today").alias("n_today"), (z("n_today") + z("pn")).alias("n_both"),
                    "max_today", F.greatest("max_today", "pm").alias("max_both")).filter("n_both > 0")


@query("semi_fill_achievable", "mkt s, ticker s", """
SELECT m.mkt, m.ticker FROM v_market m WHERE EXISTS (SELECT 1 FROM v_candle c WHERE c.mkt = m.mkt AND c.bucket_us BETWEEN m.listed_us + 36000000000 AND m.listed_us + 43200000000 AND coalesce(c.ask, c.bid) <= 40)""")
def semi_fill_achievable(t):
    m = t.market.withColumns({"l": F.col("listed_us") + 10 * HOUR, "limit": N(40)})
    return J.fill_achievable(m, t.candle, "mkt", "l", "limit", 2 * HOUR)


@query("anti_missing_dates", "city s, n_days i, n_present i, n_missing i", """
WITH h AS (SELECT DISTINCT city, CASE WHEN (day - DATE '2024-01-01' + length(city)) % 5 = 4 THEN day + 5 ELSE day END AS day FROM v_obs), sp AS (SELECT city, CAST(d AS DATE) AS day FROM (SELECT DISTINCT city FROM h), range(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY) r(d))
SELECT sp.city, count(*) AS n_days, count(h.day) AS n_present, count(*) - count(h.day) AS n_missing FROM sp LEFT JOIN h USING (city, day) GROUP BY sp.city""")
def anti_missing_dates(t):
    # Every fifth day of a city is moved by five days, which leaves gaps without dropping a row.
    gap = F.pmod(F.datediff("day", N("2024-01-01").cast("date")) + F.length("city"), N(5)) == 4
    h = t.obs.select("city", F.when(gap, F.date_add("day", 5)).otherwise(F.col("day")).alias("day"))
    m = J.missing_days(h, ["city"], "day", "2024-01-01", "2024-02-04")
    return m.groupBy("city").agg(F.count(N(1)).alias("n_days"), F.sum("present").alias("n_present"), F.count_if(F.col("present") == 0).alias("n_missing"))


@query("join_neighbor_bracket", "mkt s, idx i, total i, up s, down s", """
SELECT mkt, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY city, day) AS total, lead(ticker) OVER w AS up, lag(ticker) OVER w AS down FROM v_market WINDOW w AS (PARTITION BY city, day ORDER BY floor_s NULLS FIRST)""")
def join_neighbor_bracket(t):
    return B.neighbours(t.market, ["city", "day"])


@query("join_pivot_leads", "city s, basis d, t0 f, t1 f, t2 f, trend f, d1 f, d2 f", """
SELECT a.city, a.basis, a.tempmax_f AS t0, b.tempmax_f AS t1, c.tempmax_f AS t2, (coalesce(c.tempmax_f, b.tempmax_f, a.tempmax_f) - a.tempmax_f) / 2 AS trend, b.tempmax_f - a.tempmax_f AS d1, c.tempmax_f - a.tempmax_f AS d2
FROM (SELECT * FROM v_fcst WHERE lead = 0) a LEFT JOIN (SELECT * FROM v_fcst WHERE lead = 1) b ON a.city = b.city AND a.basis = b.basis LEFT JOIN (SELECT * FROM v_fcst WHERE lead = 2) c ON a.city = c.city AND a.basis = c.basis""")
def join_pivot_leads(t):
    return J.lead_path(t.fcst)


@query("lateral_scalar_subqueries", "city s, day d, peak_hour i, fcst_15 f, max_sofar f, win s", """
SELECT city, day, (SELECT hour FROM v_fcst_hourly h WHERE h.city = s.city AND h.day = s.day ORDER BY temp_f DESC, hour LIMIT 1) AS peak_hour,
 (SELECT max(temp_f) FROM v_fcst_hourly h WHERE h.city = s.city AND h.day = s.day AND h.hour = 15) AS fcst_15,
 (SELECT max(temp_f) FROM v_obs o WHERE o.city = s.city AND o.day = s.day AND o.hour < 15) AS max_sofar,
 (SELECT max(ticker) FROM v_market m WHERE m.city = s.city AND m.day = s.day AND m.result = 'yes') AS win FROM v_settle s""")
def lateral_scalar_subqueries(t):
    """Correlated scalars as one keyed aggregate per source."""
    k = ["city", "day"]
    h = t.fcst_hourly.groupBy(*k).agg(F.max_by("hour", F.struct(F.col("temp_f"), -F.col("hour"))).alias("peak_hour"),
                                      F.max(F.when(F.col("hour") == 15, F.col("temp_f"))).alias("fcst_15"))
    o = t.obs.filter("hour < 15").groupBy(*k).agg(F.max("temp_f").alias("max_sofar"))
    m = t.market.filter("result = 'yes'").groupBy(*k).agg(F.max("ticker").alias("win"))
    s = t.settle.select(*k)
    return s.join(h, k, "left").join(o, k, "left").join(m, k, "left")


@query("join_dim_broadcast", "o_orderpriority s, zone s, n i, total_c i", """
SELECT o_orderpriority, zone, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS total_c FROM orders JOIN (VALUES ('1-URGENT','UTC'),('2-HIGH','America/Chicago'),('3-MEDIUM','America/Denver')) z(p, zone) ON o_orderpriority = p GROUP BY 1, 2""")
def join_dim_broadcast(t):
    # A literal dimension of three rows: its size is fixed by the code.
    z = t.spark.createDataFrame([("1-URGENT", "UTC"), ("2-HIGH", "America/Chicago"), ("3-MEDIUM", "America/Denver")], "p string, zone string")
    return t.orders.join(F.broadcast(z), F.col("o_orderpriority") == F.col("p")).groupBy("o_orderpriority", "zone").agg(
        F.count(N(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("total_c"))


@query("join_cross_grid", "thr f, fill f, n i, pnl f", """
SELECT thr, fill, count(*) AS n, sum(pnl) * fill AS pnl FROM v_bt, (VALUES (2.0e0),(5.0e0),(8.0e0)) a(thr), (VALUES (0.2e0),(0.4e0),(0.6e0),(1.0e0)) b(fill) WHERE abs(edge) >= thr GROUP BY thr, fill""")
def join_cross_grid(t):
    """Every row meets the whole grid in effect, but rows are first counted per edge band,
    so only the few band totals are multiplied by the grid."""
    from ..operators.sweep import threshold_totals
    s = threshold_totals(t.bt, F.abs("edge"), [2.0, 5.0, 8.0], {"n": N(1), "p": F.col("pnl")})
    return s.withColumn("fill", F.explode(F.array(*[N(x) for x in (0.2, 0.4, 0.6, 1.0)]))).select(
        "thr", "fill", "n", (F.col("p") * F.col("fill")).alias("pnl"))


@query("join_fact_dim_counts", "city s, n_quotes i, n_mkts i, b0 u, b1 u", """
SELECT m.city, count(*) AS n_quotes, count(DISTINCT m.mkt) AS n_mkts, min(bucket_us) AS b0, max(bucket_us) AS b1 FROM v_candle c JOIN v_market m USING (mkt) GROUP BY m.city""")
def join_fact_dim_counts(t):
    """Quotes are counted per market before the join and the hot city."""
    c = t.candle.groupBy("mkt").agg(F.count(N(1)).alias("n"), F.min("bucket_us").alias("b0"), F.max("bucket_us").alias("b1"))
    return c.join(t.market.select("mkt", "city"), "mkt").groupBy("city").agg(
        F.sum("n").alias("n_quotes"), F.count(N(1)).alias("n_mkts"), F.min("b0").alias("b0"), F.max("b1").alias("b1"))


@query("join_winning_market", "city s, day d, settle_f i, win_ticker s, win_type s", """
SELECT s.city, s.day, s.settle_f, m.ticker AS win_ticker, m.strike_type AS win_type FROM v_settle s LEFT JOIN (SELECT * FROM v_market WHERE result = 'yes'
 QUALIFY row_number() OVER (PARTITION BY city, day ORDER BY CASE strike_type WHEN 'between' THEN 0 WHEN 'greater' THEN 1 ELSE 2 END, CASE WHEN strike_type = 'greater' THEN -floor_s ELSE cap_s END) = 1) m USING (city, day)""")
def join_winning_market(t):
    return B.winner(t.settle.select("city", "day", "settle_f"), t.market, ["city", "day"])


@query("join_forecast_at_basis", "city s, day d, fcst_f f, lead_used i", """
SELECT city, day, tempmax_f AS fcst_f, lead AS lead_used FROM v_fcst QUALIFY row_number() OVER (PARTITION BY city, day ORDER BY (lead <> 1)::INT, lead) = 1""")
def join_forecast_at_basis(t):
    return forecast_at_basis(t.fcst, 1)


@query("join_interp_forecast_at_time", "event_id i, fcst_at f", """
SELECT event_id, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (us - t0) / (t1 - t0) * (v1 - v0) END AS fcst_at FROM (
SELECT o.event_id, o.us, a.us AS t0, a.temp_f AS v0, b.us AS t1, b.temp_f AS v1 FROM v_obs o ASOF LEFT JOIN v_fcst_hourly a ON o.city = a.city AND o.day = a.day AND o.us >= a.us
 ASOF LEFT JOIN v_fcst_hourly b ON o.city = b.city AND o.day = b.day AND o.us < b.us)""")
def join_interp_forecast_at_time(t):
    o = t.obs.select("city", "day", "us", "event_id")
    return interpolate_at(o, t.fcst_hourly, ["city", "day"], "us", "us", "temp_f", "fcst_at")


@query("join_two_stage_models", "city s, day d, p_prev f, p_day f, settle_f i", """
SELECT s.city, s.day, a.temp_f AS p_prev, b.temp_f AS p_day, coalesce(s.settle_f, 0) AS settle_f FROM v_settle s LEFT JOIN (SELECT city, day + 1 AS day, temp_f FROM v_fcst_hourly WHERE hour = 10) a USING (city, day)
LEFT JOIN (SELECT city, day, temp_f FROM v_fcst_hourly WHERE hour = 10) b USING (city, day) WHERE a.temp_f IS NOT NULL OR b.temp_f IS NOT NULL""")
def join_two_stage_models(t):
    h = t.fcst_hourly.filter("hour = 10")
    tagged = h.select("city", F.date_add("day", 1).alias("day"), "temp_f", N("prev").alias("w")).unionByName(
        h.select("city", "day", "temp_f", N("day").alias("w")))
    p = tagged.groupBy("city", "day").agg(F.max(F.when(F.col("w") == "prev", F.col("temp_f"))).alias("p_prev"),
                                          F.max(F.when(F.col("w") == "day", F.col("temp_f"))).alias("p_day"))
    return p.join(t.settle.select("city", "day", "settle_f"), ["city", "day"])
