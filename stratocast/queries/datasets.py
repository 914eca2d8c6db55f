"""Datasets, views, parity and registries."""

from dataclasses import replace

import pandas as pd
from pyspark.sql import functions as F

from ..features import build
from ..features.registry import FAMILIES, feature_columns
from ..functions import probs as PR
from ..operators import audit as A
from ..plans import datasets as D
from ..plans import views as V
from .aggregates import _BAD
from .registry import RAW_SQL, query
from .scalars import _RULE_SQL, PHI_SQL
from .strategies import _T3

N = F.lit


_QS = (10, 25, 50, 75, 90)
_SINCE = "(us - 1704067200000000) / 6e7"


def _trailing(minutes, w):
    rate = (f"CASE WHEN count(*) OVER {w} >= 2 THEN CASE WHEN sqrt(var_pop({_SINCE}) OVER {w}) < 0.001 THEN 0 ELSE covar_samp(temp_f, {_SINCE}) OVER {w} / "
            f"nullif(var_pop({_SINCE}) OVER {w}, 0) * 60 END END AS temp_rate_last_{minutes}min, max(temp_f) OVER {w} AS temp_max_last_{minutes}min, " if minutes <= 60 else "")
    return f"{rate}avg(temp_f) OVER {w} AS temp_mean_last_{minutes}min, coalesce(stddev_samp(temp_f) OVER {w}, 0) AS temp_std_last_{minutes}min"


def _hourly(c):
    return f"CASE WHEN count(*) OVER a >= 2 THEN ({c} - first({c}) OVER a) / nullif((us - first(us) OVER a) / 1e6, 0) * 3600 END"


# Result columns by the part of the oracle that gives them: running statistics, shape, trailing windows, weather, forecast, errors, gaps, market, lags, derived.
_SNAP_COLUMNS = ", ".join(f"{c} {k}" for k, names in [
    ("i", "num_samples_sofar t_base hours_observed pred_ceil_max_sofar pred_floor_max_sofar"),
    ("f", "vc_max_f_sofar vc_min_f_sofar vc_mean_f_sofar vc_std_f_sofar vc_frac_part_sofar intraday_range_sofar temp_cv_sofar minutes_since_max_observed "
          "missing_fraction_sofar temp_ema_30min temp_ema_60min max_gap_minutes max_morning_f_sofar max_afternoon_f_sofar max_evening_f_sofar"),
    ("f", " ".join(f"vc_q{q}_f_sofar" for q in _QS)),
    ("i", "minutes_ge_base minutes_ge_base_m1 max_run_ge_base max_run_ge_base_m1 pred_plateau_20min_sofar edge_max_flag"),
    ("f", "max_minus_second_max slope_max_30min_up_sofar slope_max_30min_down_sofar"),
    ("f", "temp_mean_last_30min temp_std_last_30min temp_max_last_30min temp_mean_last_60min temp_std_last_60min temp_max_last_60min temp_mean_last_120min temp_std_last_120min"),
    ("h", "temp_rate_last_30min temp_rate_last_60min temp_acceleration wetbulb_rate_last_30min windchill_warming_rate"),
    ("f", "humidity_last_obs humidity_mean_last_60min humidity_std_last_60min windspeed_last_obs windspeed_max_last_60min windgust_max_last_60min cloudcover_last_obs "
          "cloudcover_mean_last_60min cloudcover_volatility_60min cloudcover_rate_last_30min wetbulb_last_obs wetbulb_mean_last_60min wetbulb_depression "
          "wetbulb_depression_mean_60min windchill_last_obs windchill_depression windchill_mean_last_60min"),
    ("i", "strong_windchill_flag cloud_regime fcst_prev_hour_of_max"),
    ("f", "fcst_prev_max_f fcst_prev_min_f fcst_prev_mean_f fcst_prev_std_f fcst_prev_distance_to_int fcst_peak_temp_f fcst_peak_step_minutes fcst_station_max_f fcst_city_station_gap fcst_multi_ema"),
    ("f", " ".join(f"fcst_prev_q{q}_f" for q in _QS)),
    ("f", "err_mean_sofar err_std_sofar err_abs_mean_sofar err_max_pos_sofar err_max_neg_sofar err_last1h"),
    ("f", "station_city_temp_gap station_city_max_gap_sofar station_city_mean_gap_sofar station_city_gap_std station_city_gap_trend"),
    ("f", "market_yes_bid market_yes_ask market_bid_ask_spread cumulative_volume_today volume_last_30min volume_last_60min bid_change_last_30min"),
    ("i", "settle_f_lag1 settle_f_lag2 settle_f_lag7 is_heating_phase settle_f delta delta_obs"),
    ("f", "obs_fcst_max_gap log_abs_obs_fcst_gap temp_x_hours_remaining"),
] for c in names.split())

# Each source is reduced by window functions along its own rows; the spine picks rows by as-of joins.
def _snap(rows, step_min):
    """Snapshots of a spine of ``rows`` steps from the opening."""
    return f"""
WITH s AS MATERIALIZED (SELECT city, day AS ev, settle_f, epoch_us(day::TIMESTAMP) + 86100000000 AS cl, epoch_us(day::TIMESTAMP) - 50400000000 + i * {step_min * 60_000_000} AS us FROM v_settle, range({rows}) r(i)),
o AS MATERIALIZED (SELECT *, CASE WHEN humidity BETWEEN 0 AND 100 THEN ((temp_f - 32) * 5 / 9 * atan(0.151977e0 * sqrt(humidity + 8.313659e0)) + atan((temp_f - 32) * 5 / 9 + humidity) - atan(humidity - 1.676331e0) + 0.00391838e0 * pow(humidity, 1.5e0) * atan(0.023101e0 * humidity) - 4.686035e0) * 9 / 5 + 32 END AS wb,
 CASE WHEN temp_f > 50 OR wind < 3 THEN temp_f ELSE 35.74e0 + 0.6215e0 * temp_f - 35.75e0 * pow(wind, 0.16e0) + 0.4275e0 * temp_f * pow(wind, 0.16e0) END AS wc FROM v_obs),
q AS MATERIALIZED (SELECT *, {_trailing(30, "a")}, {_trailing(60, "b")}, {_trailing(120, "c")}, avg(humidity) OVER b AS humidity_mean_last_60min, coalesce(stddev_samp(humidity) OVER b, 0) AS humidity_std_last_60min,
 max(wind) OVER b AS windspeed_max_last_60min, max(gust) OVER b AS windgust_max_last_60min, avg(cloud) OVER b AS cloudcover_mean_last_60min, stddev_samp(cloud) OVER b AS cloudcover_volatility_60min, avg(wb) OVER b AS wetbulb_mean_last_60min,
 avg(temp_f - wb) OVER b AS wetbulb_depression_mean_60min, avg(wc) OVER b AS windchill_mean_last_60min, {_hourly("wb")} AS wetbulb_rate_last_30min, {_hourly("wc")} AS windchill_warming_rate, CASE WHEN count(*) OVER a >= 2 THEN (cloud - first(cloud) OVER a) / 0.5 END AS cloudcover_rate_last_30min
 FROM o WINDOW a AS (PARTITION BY city ORDER BY us RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW), b AS (PARTITION BY city ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), c AS (PARTITION BY city ORDER BY us RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW)),
p AS MATERIALIZED (SELECT q.*, k.rate AS past FROM q ASOF LEFT JOIN (SELECT city, us, max(temp_rate_last_30min) AS rate FROM q GROUP BY city, us) k ON q.city = k.city AND q.us - 1800000000 >= k.us),
e AS MATERIALIZED (SELECT *, day AS ev FROM p UNION ALL SELECT *, day + 1 AS ev FROM p WHERE us % 86400000000 >= 36000000000),
w AS MATERIALIZED (SELECT *, row_number() OVER o AS n, max(temp_f) OVER o AS mx, min(temp_f) OVER o AS mn, avg(temp_f) OVER o AS mean, coalesce(stddev_samp(temp_f) OVER o, 0) AS sd, {", ".join(f"quantile_cont(temp_f, {q / 100}) OVER o AS vc_q{q}_f_sofar" for q in _QS)},
 max(CASE WHEN hour < 12 THEN temp_f END) OVER o AS max_morning_f_sofar, max(CASE WHEN hour BETWEEN 12 AND 16 THEN temp_f END) OVER o AS max_afternoon_f_sofar, max(CASE WHEN hour >= 17 THEN temp_f END) OVER o AS max_evening_f_sofar,
 {", ".join(f"sum(pow(2e0, (us - 1704067200000000 - (ev - DATE '2024-01-01') * 86400000000) / {m}e0 / 6e7) * temp_f) OVER o / sum(pow(2e0, (us - 1704067200000000 - (ev - DATE '2024-01-01') * 86400000000) / {m}e0 / 6e7)) OVER o AS temp_ema_{m}min" for m in (30, 60))},
 us - lag(us) OVER t AS gap, temp_f - lag(temp_f, 6) OVER t AS rise, min(us) OVER o AS u0, CAST(round_even(temp_f, 0) AS BIGINT) AS k, CASE WHEN lag(us // 3600000000) OVER t = us // 3600000000 THEN 0 ELSE 1 END AS newhour
 FROM e WINDOW o AS (PARTITION BY city, ev ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), t AS (PARTITION BY city, ev ORDER BY us, event_id)),
x AS MATERIALIZED (SELECT *, lag(mx) OVER t AS m0, CAST(round_even(mx, 0) AS BIGINT) AS base, n - row_number() OVER (PARTITION BY city, ev, k ORDER BY n) AS isl FROM w WINDOW t AS (PARTITION BY city, ev ORDER BY n)),
x2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY city, ev, k, isl ORDER BY n) AS len FROM x),
y AS MATERIALIZED (SELECT *, mx - max(CASE WHEN m0 IS NOT NULL THEN least(temp_f, m0) END) OVER t AS second, max(CASE WHEN abs(temp_f - mx) < 0.01e0 THEN us END) OVER t AS near, max(gap) OVER t AS maxgap, max(rise) OVER t AS up, min(rise) OVER t AS down, sum(newhour) OVER t AS hours,
 max(CASE WHEN m0 IS NULL OR temp_f > m0 THEN n END) OVER t AS top, max(CASE WHEN len >= 4 THEN k END) OVER t AS held FROM x2 WINDOW t AS (PARTITION BY city, ev ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pairs AS MATERIALIZED (SELECT a.city, a.ev, a.n, b.n AS bn, b.temp_f >= a.base AS f, b.temp_f >= a.base - 1 AS f1 FROM y a JOIN y b ON a.city = b.city AND a.ev = b.ev AND b.n <= a.n),
islands AS MATERIALIZED (SELECT city, ev, n, f, f1, bn - row_number() OVER (PARTITION BY city, ev, n, f ORDER BY bn) AS i, bn - row_number() OVER (PARTITION BY city, ev, n, f1 ORDER BY bn) AS i1 FROM pairs),
r0 AS (SELECT city, ev, n, max(c) * 5 AS run, sum(c) * 5 AS total FROM (SELECT city, ev, n, i, count(*) AS c FROM islands WHERE f GROUP BY city, ev, n, i) GROUP BY city, ev, n),
r1 AS (SELECT city, ev, n, max(c) * 5 AS run, sum(c) * 5 AS total FROM (SELECT city, ev, n, i1, count(*) AS c FROM islands WHERE f1 GROUP BY city, ev, n, i1) GROUP BY city, ev, n),
z AS (SELECT y.*, CASE WHEN y.n >= 2 THEN coalesce(r0.run, 0) END AS run0, CASE WHEN y.n >= 2 THEN coalesce(r0.total, 0) END AS all0, CASE WHEN y.n >= 2 THEN coalesce(r1.run, 0) END AS run1, CASE WHEN y.n >= 2 THEN coalesce(r1.total, 0) END AS all1
 FROM y LEFT JOIN r0 ON r0.city = y.city AND r0.ev = y.ev AND r0.n = y.n LEFT JOIN r1 ON r1.city = y.city AND r1.ev = y.ev AND r1.n = y.n QUALIFY row_number() OVER (PARTITION BY y.city, y.ev, y.us ORDER BY y.n DESC) = 1),
f AS (SELECT city, day AS ev, max(temp_f) AS fmax, min(temp_f) AS fmin, avg(temp_f) AS fmean, coalesce(stddev_samp(temp_f), 0) AS fstd, arg_max(hour, struct_pack(a := temp_f, b := -hour)) AS peak, {", ".join(f"quantile_cont(temp_f, {q / 100}) AS fcst_prev_q{q}_f" for q in _QS)} FROM v_fcst_hourly GROUP BY city, day),
h AS (SELECT city, day AS ev, sum(exp(-0.15e0 * (lead - 1)) * tempmax_f) / sum(exp(-0.15e0 * (lead - 1))) AS ema FROM v_fcst WHERE lead BETWEEN 1 AND 6 GROUP BY city, day),
eh AS (SELECT f.city, f.day AS ev, epoch_us(f.day::TIMESTAMP) + (f.hour + 1) * 3600000000 AS us, o.m - f.temp_f AS e FROM v_fcst_hourly f JOIN (SELECT city, day, hour, sum(CAST(round(temp_f * 100) AS BIGINT)) / count(temp_f) / 100 AS m FROM v_obs GROUP BY ALL) o USING (city, day, hour)),
er AS (SELECT *, avg(e) OVER t AS em, coalesce(stddev_samp(e) OVER t, 0) AS es, avg(abs(e)) OVER t AS ea, max(e) OVER t AS ep, min(e) OVER t AS en FROM eh WINDOW t AS (PARTITION BY city, ev ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
gr AS (SELECT e.city, e.ev, e.us, e.temp_f AS a, v.temp_f AS b, e.temp_f - v.temp_f AS g FROM e JOIN v_obs2 v ON v.event_id = e.event_id),
gs AS (SELECT *, row_number() OVER t AS n, max(a) OVER t - max(b) OVER t AS gm, avg(g) OVER t AS ga, stddev_pop(g) OVER t AS gd, sum(g) OVER t AS gt FROM gr WINDOW t AS (PARTITION BY city, ev ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT x.*, CASE WHEN x.n >= 4 THEN (x.gt - m.gt) / (x.n - m.n) - m.gt / m.n END AS trend FROM gs x LEFT JOIN gs m ON m.city = x.city AND m.ev = x.ev AND m.n = x.n // 2),
c AS (SELECT *, bucket_us + j AS t, sum(volume) OVER (PARTITION BY city, day ORDER BY bucket_us, j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(volume) OVER a AS v30, sum(volume) OVER b AS v60, CASE WHEN count(bid) OVER a >= 2 THEN bid - first(bid) OVER a END AS chg FROM v_candle
 WINDOW a AS (PARTITION BY city, day ORDER BY bucket_us + j RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW), b AS (PARTITION BY city, day ORDER BY bucket_us + j RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)),
m AS (SELECT *, day AS ev FROM c QUALIFY row_number() OVER (PARTITION BY city, day, bucket_us ORDER BY j DESC) = 1),
u AS (SELECT s.city, s.ev, s.us, s.cl, s.settle_f, z.* EXCLUDE (city, ev, us), z.us AS zu FROM s ASOF LEFT JOIN z ON s.city = z.city AND s.ev = z.ev AND s.us >= z.us),
u1 AS (SELECT u.*, er.em, er.es, er.ea, er.ep, er.en, er.e FROM u ASOF LEFT JOIN er ON u.city = er.city AND u.ev = er.ev AND u.us >= er.us),
u2 AS (SELECT u1.*, g.g, g.gm, g.ga, g.gd, g.trend FROM u1 ASOF LEFT JOIN g ON u1.city = g.city AND u1.ev = g.ev AND u1.us >= g.us),
u3 AS (SELECT u2.*, m.bid, m.ask, m.cum, m.v30, m.v60, m.chg FROM u2 ASOF LEFT JOIN m ON u2.city = m.city AND u2.ev = m.ev AND u2.us > m.bucket_us)
SELECT u.city, u.ev AS event_date, u.us, n AS num_samples_sofar, base AS t_base, hours AS hours_observed, ceil(mx) AS pred_ceil_max_sofar, floor(mx) AS pred_floor_max_sofar, mx AS vc_max_f_sofar, mn AS vc_min_f_sofar, mean AS vc_mean_f_sofar, sd AS vc_std_f_sofar, mx - base AS vc_frac_part_sofar,
 mx - mn AS intraday_range_sofar, CASE WHEN mean > 0 AND n > 1 THEN sd / mean END AS temp_cv_sofar, (zu - near) / 6e7 AS minutes_since_max_observed, 1 - n / greatest(floor((zu - u0) / 3e8) + 1, n) AS missing_fraction_sofar, maxgap / 6e7 AS max_gap_minutes,
 all0 AS minutes_ge_base, all1 AS minutes_ge_base_m1, run0 AS max_run_ge_base, run1 AS max_run_ge_base_m1, coalesce(held, base) AS pred_plateau_20min_sofar, CASE WHEN n >= 3 THEN CAST(top <= greatest(1, n // 10) OR top > n - greatest(1, n // 10) AS INT) END AS edge_max_flag,
 second AS max_minus_second_max, up AS slope_max_30min_up_sofar, down AS slope_max_30min_down_sofar, CASE WHEN n >= 12 THEN temp_rate_last_30min - past END AS temp_acceleration, humidity AS humidity_last_obs, wind AS windspeed_last_obs, cloud AS cloudcover_last_obs, wb AS wetbulb_last_obs, temp_f - wb AS wetbulb_depression,
 CASE WHEN temp_f <= 50 THEN wc END AS windchill_last_obs, CASE WHEN temp_f <= 50 THEN temp_f - wc END AS windchill_depression, CASE WHEN temp_f <= 50 THEN CAST(temp_f - wc > 10 AS INT) END AS strong_windchill_flag, CASE WHEN cloud < 20 THEN 0 WHEN cloud < 70 THEN 1 WHEN cloud IS NOT NULL THEN 2 END AS cloud_regime,
 peak AS fcst_prev_hour_of_max, fmax AS fcst_prev_max_f, fmin AS fcst_prev_min_f, fmean AS fcst_prev_mean_f, fstd AS fcst_prev_std_f, least(fmax - floor(fmax), 1 - (fmax - floor(fmax))) AS fcst_prev_distance_to_int, fmax AS fcst_peak_temp_f, CASE WHEN fmax IS NOT NULL THEN 60 END AS fcst_peak_step_minutes,
 st.tempmax_f AS fcst_station_max_f, st.tempmax_f - fmax AS fcst_city_station_gap, h.ema AS fcst_multi_ema, em AS err_mean_sofar, CASE WHEN em IS NOT NULL THEN es END AS err_std_sofar, ea AS err_abs_mean_sofar, ep AS err_max_pos_sofar, en AS err_max_neg_sofar, e AS err_last1h,
 g AS station_city_temp_gap, gm AS station_city_max_gap_sofar, ga AS station_city_mean_gap_sofar, gd AS station_city_gap_std, trend AS station_city_gap_trend, bid AS market_yes_bid, ask AS market_yes_ask, ask - bid AS market_bid_ask_spread, cum AS cumulative_volume_today, v30 AS volume_last_30min, v60 AS volume_last_60min, chg AS bid_change_last_30min,
 l1.settle_f AS settle_f_lag1, l2.settle_f AS settle_f_lag2, l7.settle_f AS settle_f_lag7, CASE WHEN temp_rate_last_30min > 0.5 THEN 1 WHEN temp_rate_last_30min IS NOT NULL THEN 0 WHEN hour(make_timestamp(u.us)) < 11 THEN 1 ELSE 0 END AS is_heating_phase,
 u.settle_f, u.settle_f - CAST(round_even(fmax, 0) AS BIGINT) AS delta, u.settle_f - base AS delta_obs, fmax - mx AS obs_fcst_max_gap, ln(1 + abs(fmax - mx)) AS log_abs_obs_fcst_gap, mx * ((cl - u.us) / 3.6e9) AS temp_x_hours_remaining,
 {", ".join(["temp_ema_30min", "temp_ema_60min", "max_morning_f_sofar", "max_afternoon_f_sofar", "max_evening_f_sofar", "humidity_mean_last_60min", "humidity_std_last_60min", "windspeed_max_last_60min", "windgust_max_last_60min", "cloudcover_mean_last_60min", "cloudcover_volatility_60min", "cloudcover_rate_last_30min", "wetbulb_mean_last_60min", "wetbulb_depression_mean_60min", "wetbulb_rate_last_30min", "windchill_mean_last_60min", "windchill_warming_rate",
             *[f"temp_{k}_last_{m}min" for m in (30, 60, 120) for k in ("mean", "std", "max", "rate") if m < 120 or k in ("mean", "std")], *[f"vc_q{q}_f_sofar" for q in _QS], *[f"fcst_prev_q{q}_f" for q in _QS]])}
FROM u3 u LEFT JOIN f ON f.city = u.city AND f.ev = u.ev LEFT JOIN h ON h.city = u.city AND h.ev = u.ev LEFT JOIN v_fcst_station st ON st.city = u.city AND st.day = u.ev
 LEFT JOIN v_settle l1 ON l1.city = u.city AND l1.day = u.ev - 1 LEFT JOIN v_settle l2 ON l2.city = u.city AND l2.day = u.ev - 2 LEFT JOIN v_settle l7 ON l7.city = u.city AND l7.day = u.ev - 7"""


@query("feature_snapshot", f"city s, event_date d, us u, {_SNAP_COLUMNS}", _snap(76, 30))
def feature_snapshot(t):
    """All feature groups on a half-hourly spine."""
    return build(D.snapshots(t.settle, 30), D.inputs(t))


@query("dataset_market_clock", "city s, event_date d, n i, avg_max f, avg_gap f, sum_delta i", """
WITH s AS (SELECT city, day, settle_f, epoch_us(day::TIMESTAMP) - 50400000000 AS lo, epoch_us(day::TIMESTAMP) - 50400000000 + i * 300000000 AS us FROM v_settle, range(456) r(i)),
a AS (SELECT s.city, s.day, s.us, any_value(s.settle_f) AS settle_f, max(o.temp_f) AS mx FROM s JOIN v_obs o ON o.city = s.city AND o.us BETWEEN s.lo AND s.us GROUP BY s.city, s.day, s.us),
f AS (SELECT city, day, max(temp_f) AS fm FROM v_fcst_hourly GROUP BY city, day)
SELECT a.city, a.day AS event_date, count(*) AS n, avg(mx) AS avg_max, avg(fm - mx) AS avg_gap, sum(settle_f - CAST(round_even(fm, 0) AS BIGINT)) AS sum_delta FROM a JOIN f USING (city, day) GROUP BY a.city, a.day""")
def dataset_market_clock(t):
    """Five-minute dataset of every event with lags, summarised per event."""
    d = D.market_clock_dataset(t.settle, D.inputs(t), 5)
    return d.groupBy("city", "event_date").agg(F.count(N(1)).alias("n"), F.avg("vc_max_f_sofar").alias("avg_max"), F.avg("obs_fcst_max_gap").alias("avg_gap"),
                                               F.sum("delta").alias("sum_delta"))


_NUMERIC = [c.split()[0] for c in _SNAP_COLUMNS.split(", ")]


@query("dataset_market_clock_columns", "column_name s, n_present i, mean h", f"""
WITH d AS MATERIALIZED (SELECT * FROM ({_snap(456, 5)}) WHERE num_samples_sofar >= 1)
""" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n_present, avg({c}::DOUBLE) AS mean FROM d" for c in _NUMERIC))
def dataset_market_clock_columns(t):
    """Values and their mean of every compared column of the five-minute dataset, all events."""
    d = D.market_clock_dataset(t.settle, D.inputs(t), 5)
    a = d.agg(*[F.struct(F.count(c).alias("n"), F.avg(F.col(c).cast("double")).alias("s")).alias(f"_{i}") for i, c in enumerate(_NUMERIC)])
    cells = F.array(*[F.struct(N(c).alias("column_name"), F.col(f"_{i}.n").alias("n_present"), F.col(f"_{i}.s").alias("mean")) for i, c in enumerate(_NUMERIC)])
    return a.select(F.explode(cells).alias("c")).select("c.*")


@query("dataset_quarter_hours", "city s, event_date d, n i, n_samples i, sum_t_base i, avg_max f, avg_median f, sum_delta i", f"""
WITH v AS (SELECT city, day, us, event_id, settle_f, CASE WHEN {_BAD} THEN NULL ELSE raw_f END AS v, row_number() OVER (PARTITION BY city, day ORDER BY us, event_id) AS rn FROM v_obs JOIN v_settle USING (city, day)), k AS (SELECT * FROM v WHERE v IS NOT NULL),
j AS (SELECT v.*, a.rn AS r0, a.v AS v0, b.rn AS r1, b.v AS v1 FROM v ASOF LEFT JOIN k a ON v.city = a.city AND v.day = a.day AND v.rn >= a.rn ASOF LEFT JOIN k b ON v.city = b.city AND v.day = b.day AND v.rn <= b.rn),
f AS (SELECT city, day, us, event_id, CASE WHEN v IS NOT NULL THEN v WHEN coalesce(rn - r0 <= 3, false) OR coalesce(r1 - rn <= 3, false) THEN CASE WHEN r0 IS NULL THEN v1 WHEN r1 IS NULL THEN v0 ELSE v0 + (rn - r0) * 1.0e0 / (r1 - r0) * (v1 - v0) END END AS x FROM j),
w AS (SELECT *, row_number() OVER o AS n, max(x) OVER o AS mx, quantile_cont(x, 0.5) OVER o AS md FROM f WHERE x IS NOT NULL WINDOW o AS (PARTITION BY city, day ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY city, day, us ORDER BY event_id DESC) = 1),
s AS (SELECT city, day, settle_f, epoch_us(day::TIMESTAMP) + 36000000000 + i * 900000000 AS us FROM v_settle, range(56) r(i))
SELECT s.city, s.day AS event_date, count(*) AS n, sum(n) AS n_samples, sum(CAST(round_even(mx, 0) AS BIGINT)) AS sum_t_base, avg(mx) AS avg_max, avg(md) AS avg_median, sum(settle_f - CAST(round_even(mx, 0) AS BIGINT)) AS sum_delta
FROM s ASOF JOIN l ON s.city = l.city AND s.day = l.day AND s.us >= l.us GROUP BY s.city, s.day""")
def dataset_quarter_hours(t):
    """Quarter hours of the event day from 10:00, on observations of that day whose small gaps are repaired."""
    ctx = replace(D.inputs(t), obs=D.repaired(t.obs), open_hour=24)
    d = D.quarter_hours_dataset(t.settle, ctx, groups=["observed", "quantiles", "labels", "forecast"])
    return d.groupBy("city", "event_date").agg(
        F.count(N(1)).alias("n"), F.sum("num_samples_sofar").alias("n_samples"), F.sum("t_base").alias("sum_t_base"), F.avg("vc_max_f_sofar").alias("avg_max"),
        F.avg("vc_q50_f_sofar").alias("avg_median"), F.sum("delta_obs").alias("sum_delta"))


@query("dataset_hourly_snapshots", "city s, event_date d, us u, num_samples_sofar i, vc_max_f_sofar f, vc_min_f_sofar f, vc_mean_f_sofar f, intraday_range_sofar f, last_temp_f f, temp_mean_last_60min f, temp_max_last_30min f, humidity_mean_last_60min f, cloudcover_last_obs f, fcst_prev_max_f f, fcst_prev_q50_f f, obs_fcst_max_gap f, market_yes_bid f, market_yes_ask f, settle_f_lag1 i, delta i, delta_obs i", """
WITH s AS (SELECT city, day AS event_date, us, settle_f, epoch_us(day::TIMESTAMP) AS d0 FROM v_snap),
r AS (SELECT *, avg(temp_f) OVER h AS m60, max(temp_f) OVER q AS x30, avg(humidity) OVER h AS h60 FROM v_obs WINDOW h AS (PARTITION BY city ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), q AS (PARTITION BY city ORDER BY us RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW)),
a AS (SELECT s.city, s.event_date, s.us, count(*) AS n, max(temp_f) AS mx, min(temp_f) AS mn, avg(temp_f) AS mean, arg_max(temp_f, r.us) AS lt, arg_max(m60, r.us) AS m60, arg_max(x30, r.us) AS x30, arg_max(h60, r.us) AS h60, arg_max(cloud, r.us) AS cl FROM s JOIN r ON r.city = s.city AND r.us >= s.d0 - 50400000000 AND r.us < s.us GROUP BY ALL),
f AS (SELECT city, day, max(temp_f) AS fm, quantile_cont(temp_f, 0.5) AS f50 FROM v_fcst_hourly GROUP BY city, day),
c AS (SELECT *, row_number() OVER (PARTITION BY city, day ORDER BY bucket_us, j) AS o FROM v_candle),
m AS (SELECT s.city, s.event_date, s.us, arg_max(bid, o) AS bid, arg_max(ask, o) AS ask FROM s JOIN c ON c.city = s.city AND c.day = s.event_date AND c.bucket_us < s.us GROUP BY ALL)
SELECT a.city, a.event_date, a.us, n AS num_samples_sofar, mx AS vc_max_f_sofar, mn AS vc_min_f_sofar, mean AS vc_mean_f_sofar, mx - mn AS intraday_range_sofar, lt AS last_temp_f, m60 AS temp_mean_last_60min, x30 AS temp_max_last_30min, h60 AS humidity_mean_last_60min, cl AS cloudcover_last_obs,
 fm AS fcst_prev_max_f, f50 AS fcst_prev_q50_f, fm - mx AS obs_fcst_max_gap, m.bid AS market_yes_bid, m.ask AS market_yes_ask, l.settle_f AS settle_f_lag1, s.settle_f - CAST(round_even(fm, 0) AS BIGINT) AS delta, s.settle_f - CAST(round_even(mx, 0) AS BIGINT) AS delta_obs
FROM a JOIN s ON s.city = a.city AND s.us = a.us JOIN f ON f.city = a.city AND f.day = a.event_date LEFT JOIN m ON m.city = a.city AND m.us = a.us LEFT JOIN v_settle l ON l.city = a.city AND l.day = a.event_date - 1 WHERE n >= 12""")
def dataset_hourly_snapshots(t):
    """Hours 10-23 with at least 12 samples, cutoff exclusive."""
    return D.hourly_dataset(t.settle, D.inputs(t, inclusive=False), 12)


@query("view_midnight_path", "city s, day d, t0 f, t1 f, t2 f, trend_3d f, d1 f, d2 f, peak_hour f, peak_f f, weighted_hour f, settle_f i, actual_hour f, delta_midnight f", """
WITH p AS (SELECT a.city, a.basis AS day, a.tempmax_f AS t0, b.tempmax_f AS t1, c.tempmax_f AS t2 FROM (SELECT * FROM v_fcst WHERE lead = 0) a LEFT JOIN (SELECT * FROM v_fcst WHERE lead = 1) b ON a.city = b.city AND a.basis = b.basis LEFT JOIN (SELECT * FROM v_fcst WHERE lead = 2) c ON a.city = c.city AND a.basis = c.basis),
k AS (SELECT DISTINCT ON (city, day) city, day, hour, temp_f FROM v_fcst_hourly ORDER BY city, day, temp_f DESC, hour), o AS (SELECT DISTINCT ON (city, day) city, day, hour + minute(ts) / 60.0e0 AS hour FROM v_obs ORDER BY city, day, temp_f DESC, us)
SELECT p.*, (coalesce(t2, t1, t0) - t0) / 2 AS trend_3d, t1 - t0 AS d1, t2 - t0 AS d2, k.hour AS peak_hour, k.temp_f AS peak_f, 0.2e0 * coalesce(y.hour, k.hour) + 0.7e0 * k.hour + 0.1e0 * coalesce(n.hour, k.hour) AS weighted_hour, s.settle_f, a.hour AS actual_hour, s.settle_f - t0 AS delta_midnight
FROM p LEFT JOIN k ON k.city = p.city AND k.day = p.day LEFT JOIN o y ON y.city = p.city AND y.day = p.day - 1 LEFT JOIN k n ON n.city = p.city AND n.day = p.day + 1 LEFT JOIN o a ON a.city = p.city AND a.day = p.day LEFT JOIN v_settle s ON s.city = p.city AND s.day = p.day""")
def view_midnight_path(t):
    return V.midnight_path(t)


@query("view_decision_points", "city s, day d, kind s, hour_f f, dec_us u, t0 f, fcst_at f, obs_at f, max_so_far f, settle_f i, win_ticker s", """
WITH p AS (SELECT city, basis AS day, tempmax_f AS t0 FROM v_fcst WHERE lead = 0), k AS (SELECT DISTINCT ON (city, day) city, day, hour FROM v_fcst_hourly ORDER BY city, day, temp_f DESC, hour), o AS (SELECT DISTINCT ON (city, day) city, day, hour + minute(ts) / 60.0e0 AS hour FROM v_obs ORDER BY city, day, temp_f DESC, us),
b AS (SELECT p.*, 0.2e0 * coalesce(y.hour, k.hour) + 0.7e0 * k.hour + 0.1e0 * coalesce(n.hour, k.hour) AS w FROM p LEFT JOIN k ON k.city = p.city AND k.day = p.day LEFT JOIN o y ON y.city = p.city AND y.day = p.day - 1 LEFT JOIN k n ON n.city = p.city AND n.day = p.day + 1),
d AS (SELECT city, day, t0, 'midnight' AS kind, 0.0e0 AS hour_f FROM b UNION ALL SELECT city, day, t0, 'pre_high_2h', greatest(w - 2, 0) FROM b WHERE w IS NOT NULL UNION ALL SELECT city, day, t0, 'pre_high_1h', greatest(w - 1, 0) FROM b WHERE w IS NOT NULL),
e AS (SELECT *, epoch_us(day::TIMESTAMP) + CAST(floor(hour_f * 60) AS BIGINT) * 60000000 AS dec_us FROM d)
SELECT city, day, kind, hour_f, dec_us, t0, (SELECT max(h.temp_f) FROM v_fcst_hourly h WHERE h.city = e.city AND h.day = e.day AND h.hour = floor(e.hour_f)) AS fcst_at,
 (SELECT arg_min(x.temp_f, x.us) FROM v_obs x WHERE x.city = e.city AND x.us >= e.dec_us - 3600000000 AND x.us < e.dec_us + 3600000000) AS obs_at, (SELECT max(x.temp_f) FROM v_obs x WHERE x.city = e.city AND x.day = e.day AND x.us <= e.dec_us) AS max_so_far,
 (SELECT max(s.settle_f) FROM v_settle s WHERE s.city = e.city AND s.day = e.day) AS settle_f, (SELECT min(m.ticker) FROM v_market m WHERE m.city = e.city AND m.day = e.day AND m.result = 'yes') AS win_ticker FROM e""")
def view_decision_points(t):
    return V.decision_points(t)


@query("parity_check", "column_name s, n_rows i, unmatched i, null_a i, null_b i, differ i", """
WITH a AS (SELECT city, day, max(temp_f) AS mx, avg(temp_f) AS mean FROM v_obs GROUP BY ALL), b AS (SELECT city, CASE WHEN day = DATE '2024-01-07' THEN day + 60 ELSE day END AS day, max(temp_f) AS mx, avg(temp_f) AS mean FROM v_obs2 GROUP BY city, v_obs2.day), j AS (SELECT a.mx amx, a.mean am, b.mx bmx, b.mean bm, a.city IS NULL OR b.city IS NULL AS u FROM a FULL JOIN b ON a.city = b.city AND a.day = b.day)
SELECT 'mx' AS column_name, count(*) AS n_rows, count(*) FILTER (u) AS unmatched, count(*) FILTER (amx IS NULL) AS null_a, count(*) FILTER (bmx IS NULL) AS null_b, count(*) FILTER (abs(amx - bmx) > 0.001) AS differ FROM j
UNION ALL SELECT 'mean', count(*), count(*) FILTER (u), count(*) FILTER (am IS NULL), count(*) FILTER (bm IS NULL), count(*) FILTER (abs(am - bm) > 0.001) FROM j""")
def parity_check(t):
    f = lambda d: d.groupBy("city", "day").agg(F.max("temp_f").alias("mx"), F.avg("temp_f").alias("mean"))
    moved = F.when(F.col("day") == F.lit("2024-01-07").cast("date"), F.date_add("day", 60)).otherwise(F.col("day"))
    p = A.parity(f(t.obs), f(t.obs2.withColumn("day", moved)), ["city", "day"], ["mx", "mean"], 1e-3)
    return p.withColumnsRenamed({"column": "column_name", "rows": "n_rows"})


# --- registries and function surface ---

@query("registry_features", "grp s, kind s, column_name s, n_rows i, n_present i")
def registry_features(t):
    """Every column that a registered group adds, with the rows that have a value."""
    owner = {}
    d = build(D.hourly(t.settle), D.inputs(t), owners=owner)
    return per_column(d, [c for c in owner if c in d.columns]).join(
        t.spark.createDataFrame([(c, *v) for c, v in owner.items()], "column_name string, grp string, kind string"), "column_name")


def per_column(d, columns):
    """(column_name, n_rows, n_present) in one aggregation of the rows."""
    a = d.agg(F.count(N(1)).alias("n_rows"), *[F.count(c).alias(f"_{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(N(c).alias("column_name"), F.col(f"_{i}").alias("n_present")) for i, c in enumerate(columns)])
    return a.select("n_rows", F.explode(cells).alias("c")).select("c.*", "n_rows")


@query("registry_rules", "rule s, n i, total i", f"""
WITH p AS ({_RULE_SQL}) SELECT ['max_round','max_of_rounded','ceil_max','floor_max','plateau_20min','ignore_singletons','c_first'][i] AS rule, count(*) AS n, sum([max_round, max_of_rounded, ceil_max, floor_max, plateau_20min, ignore_singletons, c_first][i]) AS total FROM p, range(1, 8) r(i) GROUP BY 1""")
def registry_rules(t):
    from ..functions.derived import RULES
    from ..operators.rules import daily_rules
    r = daily_rules(t.obs).unpivot(["city", "day"], [F.col(c).cast("long").alias(c) for c in RULES], "rule", "v")
    return r.groupBy("rule").agg(F.count("v").alias("n"), F.sum("v").alias("total"))


_RUNS = {"open_maker_base": _T3, "open_maker_next_over": RAW_SQL["strategy_next_over"],
         "open_maker_curve_gap": RAW_SQL["strategy_curve_gap"], "midnight": RAW_SQL["strategy_midnight"]}


@query("registry_strategies", "strategy s, n i, total_pnl f",
       " UNION ALL ".join(f"SELECT '{k}' AS strategy, count(*) AS n, sum(pnl) AS total_pnl FROM ({v})" for k, v in _RUNS.items()))
def registry_strategies(t):
    from ..plans.strategies import STRATEGIES, run_strategy
    out = None
    for name in STRATEGIES:
        r = run_strategy(name, t).agg(F.count(N(1)).alias("n"), F.sum("pnl").alias("total_pnl")).withColumn("strategy", N(name))
        out = r if out is None else out.unionByName(r)
    return out


@query("select_feature_columns", "column_name s, family s, n_rows i, n_present i")
def select_feature_columns(t):
    """Model inputs with the family whose switch removes them, and the rows that have a value."""
    d = D.hourly_dataset(t.settle, D.inputs(t))
    num, cat = feature_columns(d)
    family = {c: "always" for c in num + cat}
    for f in FAMILIES:
        kept = set(feature_columns(d, **{f: False})[0])
        family.update({c: f for c in num if c not in kept})
    return per_column(d, num + cat).join(t.spark.createDataFrame(list(family.items()), "column_name string, family string"), "column_name")


@query("udf_normal_cdf", "event_id i, cdf f", f"SELECT event_id, CASE WHEN z >= 0 THEN 1 - {PHI_SQL.format(z='abs(z)')} ELSE {PHI_SQL.format(z='abs(z)')} END AS cdf FROM (SELECT event_id, (temp_f - 20) / 7 AS z FROM v_obs)")
def udf_normal_cdf(t):
    """The normal distribution function as a vectorised UDF, value by value."""
    @F.pandas_udf("double")
    def phi(z: pd.Series) -> pd.Series:
        return pd.Series(PR.normal_cdf_array(z.to_numpy(dtype=float)))

    return t.obs.select("event_id", phi((F.col("temp_f") - 20) / 7).alias("cdf"))


@query("udaf_longest_run", "city s, day d, run_min i", """
WITH x AS (SELECT o.city, o.day, us, event_id, temp_f >= settle_f // 3 AS f FROM v_obs o JOIN v_settle s ON o.city = s.city AND o.day = s.day), g AS (SELECT *, row_number() OVER (PARTITION BY city, day ORDER BY us, event_id) - row_number() OVER (PARTITION BY city, day, f ORDER BY us, event_id) AS isl FROM x)
SELECT city, day, coalesce(max(n), 0) * 5 AS run_min FROM (SELECT city, day, isl, count(*) FILTER (f) AS n FROM g GROUP BY city, day, isl, f) GROUP BY city, day""")
def udaf_longest_run(t):
    """Longest run as a mergeable state: each chunk reports (length, prefix, suffix,
    longest); chunk summaries of a day are then folded in order. A chunk is a slice of
    at most an hour, and the fold sees at most 24 summaries per day."""
    from pyspark.sql import Window
    from ..operators.chunked import time_chunk
    from ..functions.timeutil import HOUR
    s = t.settle.select("city", "day", F.floor(F.col("settle_f") / 3).alias("b"))
    x = t.obs.select("city", "day", "us", "event_id", "temp_f").join(s, ["city", "day"]).withColumn("f", (F.col("temp_f") >= F.col("b")).cast("int")).withColumn("c", time_chunk("us", HOUR))
    w = Window.partitionBy("city", "day", "c").orderBy("us", "event_id")
    x = x.withColumn("z", F.sum(1 - F.col("f")).over(w))
    r = x.groupBy("city", "day", "c", "z").agg(F.sum("f").alias("n"))
    c = r.groupBy("city", "day", "c").agg(F.max("n").alias("best"), F.max(F.when(F.col("z") == 0, F.col("n"))).alias("pre"), F.max_by("n", "z").alias("suf"), (F.max("z") == 0).alias("whole"))
    parts = F.sort_array(F.collect_list(F.struct("c", F.coalesce("pre", N(0)).alias("pre"), "suf", "best", "whole")))
    step = lambda a, p: F.struct(F.when(p["whole"], a["tail"] + p["suf"]).otherwise(p["suf"]).alias("tail"), F.greatest(a["best"], a["tail"] + p["pre"], p["best"]).alias("best"))
    z = F.struct(N(0).cast("long").alias("tail"), N(0).cast("long").alias("best"))
    return c.groupBy("city", "day").agg((F.aggregate(parts, z, step)["best"] * 5).alias("run_min"))


@query("udtf_brackets", "vec_id i, label s, p f", """
WITH g AS (SELECT 'T_lt_60' AS label, -999 AS fl, 60 AS cp UNION ALL SELECT 'T_' || f || '_' || (f + 5), f, f + 5 FROM range(60, 110, 5) r(f) UNION ALL SELECT 'T_ge_110', 110, 9999)
SELECT vec_id, label, sum(CASE WHEN t_base + k >= fl AND t_base + k < cp THEN p ELSE 0 END) AS p FROM v_probs_long, g GROUP BY vec_id, label""")
def udtf_brackets(t):
    """Row to bracket rows on a five-unit grid with tails, by explode of a literal grid."""
    rel = lambda n: N(n) - F.col("t_base")
    cells = [F.struct(N("T_lt_60").alias("label"), PR.mass("p", "classes", None, rel(59)).alias("p"))]
    cells += [F.struct(N(f"T_{f}_{f + 5}").alias("label"), PR.mass("p", "classes", rel(f), rel(f + 4)).alias("p")) for f in range(60, 110, 5)]
    cells += [F.struct(N("T_ge_110").alias("label"), PR.mass("p", "classes", rel(110), None).alias("p"))]
    return t.probs.select("vec_id", F.explode(F.array(*cells)).alias("b")).select("vec_id", "b.*")
