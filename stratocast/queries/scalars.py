"""Scalar functions: text, dates, formulas, arrays, JSON (C, D, M, Y, N)."""

from pyspark.sql import functions as F

from ..functions import derived as X
from ..functions import meteo, probs, strikes
from ..functions import timeutil as TU
from ..sources import json_rows as J
from .registry import query

N = F.lit


@query("str_parse_ticker", "ticker s, series s, event_date d, strike_type s, floor_s f, cap_s f", """
SELECT ticker, split_part(ticker, '-', 1) AS series, day AS event_date, strike_type,
 CASE WHEN strike_type = 'between' THEN floor_s + 0.5 ELSE floor_s END AS floor_s,
 CASE WHEN strike_type = 'between' THEN floor_s + 2.5 ELSE cap_s END AS cap_s FROM v_market WHERE coalesce(floor_s, cap_s) >= 0""")
def str_parse_ticker(t):
    return t.market.filter("coalesce(floor_s, cap_s) >= 0").select("ticker", strikes.parse_ticker("ticker").alias("p")).select("ticker", "p.*")


@query("str_bracket_label", "label s, fl f, cp f, n i", """
SELECT CASE strike_type WHEN 'less' THEN '<' || CAST(cap_s AS BIGINT) WHEN 'greater' THEN '>' || CAST(floor_s AS BIGINT) ELSE CAST(floor_s AS BIGINT) || '-' || CAST(cap_s AS BIGINT) END AS label,
 CASE WHEN strike_type <> 'less' THEN floor_s END AS fl, CASE WHEN strike_type <> 'greater' THEN cap_s END AS cp, count(*) AS n
FROM v_market WHERE coalesce(floor_s, cap_s) >= 0 GROUP BY ALL""")
def str_bracket_label(t):
    m = t.market.filter("coalesce(floor_s, cap_s) >= 0")
    l = m.groupBy(strikes.bracket_label("strike_type", "floor_s", "cap_s").alias("label")).agg(F.count(N(1)).alias("n"))
    fl, cp = strikes.label_bounds("label")
    return l.withColumns({"fl": fl, "cp": cp})


@query("str_event_key", "ek s, n i, n_b i", """
SELECT split_part(ticker, '-', 1) || '-' || split_part(ticker, '-', 2) AS ek, count(*) AS n, count(*) FILTER (contains(ticker, '-B')) AS n_b FROM v_market GROUP BY 1""")
def str_event_key(t):
    return t.market.groupBy(strikes.event_key("ticker").alias("ek")).agg(
        F.count(N(1)).alias("n"), F.count_if(F.col("ticker").contains("-B")).alias("n_b"))


@query("str_city_one_hot", "event_id i, is_click i, is_error i, is_purchase i, is_signup i, is_view i", """
SELECT event_id, (city='click')::INT is_click, (city='error')::INT is_error, (city='purchase')::INT is_purchase, (city='signup')::INT is_signup, (city='view')::INT is_view FROM v_obs""")
def str_city_one_hot(t):
    from ..plans.tables import CITIES
    return t.obs.withColumns({f"is_{c}": (F.col("city") == c).cast("int") for c in CITIES})


@query("date_market_clock", "city s, day d, hour i, minutes_since_market_open i, hours_since_market_open f, hours_to_event_close f, is_event_day i, is_d_minus_1 i", """
SELECT city, day, hour, (us - o) // 60000000 AS minutes_since_market_open, (us - o) / 3.6e9 AS hours_since_market_open, (c - us) / 3.6e9 AS hours_to_event_close,
 (us >= d0)::INT AS is_event_day, (us < d0)::INT AS is_d_minus_1
FROM (SELECT city, day, hour, us - 9 * 3600000000 AS us, epoch_us(day::TIMESTAMP) d0, epoch_us(day::TIMESTAMP) - 50400000000 AS o, epoch_us(day::TIMESTAMP) + 86100000000 AS c FROM v_snap)""")
def date_market_clock(t):
    s = t.snap.withColumn("us", F.col("us") - 9 * TU.HOUR)
    return s.withColumns(TU.market_clock("day", "us"))


@query("date_snapshot_spine", "city s, day d, n i, t0 u, t1 u, checksum i", """
SELECT city, day, count(*) AS n, min(u) AS t0, max(u) AS t1, sum(u // 60000000) AS checksum FROM (
SELECT city, day, epoch_us(day::TIMESTAMP) - 50400000000 + i * 300000000 AS u FROM v_settle, range(456) r(i)) GROUP BY city, day""")
def date_snapshot_spine(t):
    from ..operators.spine import event_spine
    return event_spine(t.settle, "day").groupBy("city", "day").agg(
        F.count(N(1)).alias("n"), F.min("us").alias("t0"), F.max("us").alias("t1"), F.sum(F.floor(F.col("us") / TU.MINUTE)).alias("checksum"))


@query("date_calendar_features", "event_id i, snapshot_hour i, minute i, minutes_since_midnight i, doy i, week_of_year i, month i, is_weekend i, hour_sin f, hour_cos f, minute_sin f, time_of_day_cos f, doy_sin f, week_cos f", """
SELECT event_id, hour AS snapshot_hour, minute(ts) AS minute, hour * 60 + minute(ts) AS minutes_since_midnight, dayofyear(day) AS doy, weekofyear(day) AS week_of_year, month(day) AS month,
 (isodow(day) >= 6)::INT AS is_weekend, sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos, sin(2 * pi() * minute(ts) / 60) AS minute_sin,
 cos(2 * pi() * (hour * 60 + minute(ts)) / 1440) AS time_of_day_cos, sin(2 * pi() * dayofyear(day) / 365.25e0) AS doy_sin, cos(2 * pi() * weekofyear(day) / 52) AS week_cos FROM v_obs""")
def date_calendar_features(t):
    return t.obs.select("event_id", *[c.alias(n) for n, c in TU.calendar("day", "ts").items()])


@query("date_local_day_utc", "o_orderkey i, zone s, u0 t, u1 t, hours i", """
SELECT o_orderkey, zone, (d::TIMESTAMP AT TIME ZONE zone) AT TIME ZONE 'UTC' AS u0, ((d + 1)::TIMESTAMP AT TIME ZONE zone) AT TIME ZONE 'UTC' AS u1,
 CAST((epoch((d + 1)::TIMESTAMP AT TIME ZONE zone) - epoch(d::TIMESTAMP AT TIME ZONE zone)) / 3600 AS BIGINT) AS hours
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, ['America/Chicago','America/Denver','America/Los_Angeles','America/New_York','UTC'][o_orderkey % 5 + 1] AS zone FROM orders)""")
def date_local_day_utc(t):
    from .scans import ZONES
    zone = F.array(*[N(z) for z in ZONES])[(F.col("o_orderkey") % 5).cast("int")]
    o = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"), zone.alias("zone"))
    a, b = TU.local_day_bounds_utc("d", "zone")
    o = o.withColumns({"u0": a, "u1": b})
    return o.withColumn("hours", F.floor((TU.epoch_us("u1") - TU.epoch_us("u0")) / TU.HOUR))


@query("date_weather_day", "event_id i, wday d, to_midnight i", """
SELECT event_id, CASE WHEN hour < 6 THEN day - 1 ELSE day END AS wday, 86400 - (hour * 3600 + minute(ts) * 60 + second(ts)) AS to_midnight FROM v_obs""")
def date_weather_day(t):
    return t.obs.select("event_id", TU.weather_day("ts").alias("wday"), TU.seconds_to_midnight("ts").alias("to_midnight"))


@query("date_floor_5min", "event_id i, f5 t, f15 t", """
SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts) AS f5, time_bucket(INTERVAL 15 MINUTE, ts) AS f15 FROM v_obs""")
def date_floor_5min(t):
    return t.obs.select("event_id", TU.floor_minutes("ts", 5).alias("f5"), TU.floor_minutes("ts", 15).alias("f15"))


@query("date_weighted_hour", "city s, day d, peak i, w f, at_us u", """
WITH q AS (SELECT city, day, arg_max(hour, struct_pack(a := temp_f, b := -hour)) AS peak FROM v_fcst_hourly GROUP BY ALL),
w AS (SELECT q.city, q.day, q.peak, 0.2e0 * coalesce(y.peak, q.peak) + 0.7e0 * q.peak + 0.1e0 * coalesce(t.peak, q.peak) AS w
FROM q LEFT JOIN q y ON y.city = q.city AND y.day = q.day - 1 LEFT JOIN q t ON t.city = q.city AND t.day = q.day + 1)
SELECT *, epoch_us(day::TIMESTAMP) + CAST(floor(w * 60) AS BIGINT) * 60000000 AS at_us FROM w""")
def date_weighted_hour(t):
    q = t.fcst_hourly.groupBy("city", "day").agg(F.max_by("hour", F.struct(F.col("temp_f"), -F.col("hour"))).alias("peak"))
    y = q.select("city", F.date_add("day", 1).alias("day"), F.col("peak").alias("py"))
    n = q.select("city", F.date_sub("day", 1).alias("day"), F.col("peak").alias("pt"))
    j = q.join(y, ["city", "day"], "left").join(n, ["city", "day"], "left")
    j = j.withColumn("w", TU.weighted_hour("py", "peak", "pt"))
    return j.withColumn("at_us", TU.epoch_us(F.col("day").cast("timestamp_ntz")) + F.floor(F.col("w") * 60) * TU.MINUTE)


_RULE_SQL = """
WITH r AS (SELECT city, day, us, temp_f, CAST(round_even(temp_f, 0) AS BIGINT) AS k, event_id, CAST(round_even(round_even((temp_f - 32.0e0) * 5.0e0 / 9.0e0, 0) * 9.0e0 / 5.0e0 + 32.0e0, 0) AS BIGINT) AS cf FROM v_obs),
g AS (SELECT *, row_number() OVER (PARTITION BY city, day ORDER BY us, event_id) - row_number() OVER (PARTITION BY city, day, k ORDER BY us, event_id) AS isl FROM r),
pl AS (SELECT city, day, max(k) AS pk FROM (SELECT city, day, k, count(*) AS c FROM g GROUP BY city, day, k, isl) WHERE c >= 4 GROUP BY city, day),
sg AS (SELECT city, day, max(k) AS sk FROM (SELECT city, day, k, count(*) AS c FROM r GROUP BY city, day, k) WHERE c >= 2 GROUP BY city, day),
a AS (SELECT city, day, max(temp_f) AS mx, max(k) AS mk, max(cf) AS c_first FROM r GROUP BY city, day)
SELECT a.city, a.day, CAST(round_even(mx, 0) AS BIGINT) AS max_round, mk AS max_of_rounded, CAST(ceil(mx) AS BIGINT) AS ceil_max, CAST(floor(mx) AS BIGINT) AS floor_max,
 coalesce(pk, mk) AS plateau_20min, coalesce(sk, mk) AS ignore_singletons, c_first FROM a LEFT JOIN pl USING (city, day) LEFT JOIN sg USING (city, day)"""


@query("math_rules", "city s, day d, max_round i, max_of_rounded i, ceil_max i, floor_max i, plateau_20min i, ignore_singletons i, c_first i", _RULE_SQL)
def math_rules(t):
    from ..operators.rules import daily_rules
    return daily_rules(t.obs)


@query("math_rule_features", "city s, day d, err_max_round i, err_floor_max i, err_c_first i, range_pred i, n_distinct i, disagree i, agreement f, frac f", f"""
WITH p AS ({_RULE_SQL}), q AS (SELECT *, [max_round, max_of_rounded, ceil_max, floor_max, plateau_20min, ignore_singletons, c_first] AS a FROM p)
SELECT q.city, q.day, max_round - s.settle_f AS err_max_round, floor_max - s.settle_f AS err_floor_max, c_first - s.settle_f AS err_c_first, list_max(a) - list_min(a) AS range_pred,
 len(list_distinct(a)) AS n_distinct, (len(list_distinct(a)) > 1)::INT AS disagree, greatest(0, 1.0e0 - (list_max(a) - list_min(a)) / 3) AS agreement, vc_max_f - max_round AS frac
FROM q JOIN v_settle s ON s.city = q.city AND s.day = q.day""")
def math_rule_features(t):
    from ..operators.rules import daily_rules
    j = daily_rules(t.obs).join(t.settle.select("city", "day", "settle_f", "vc_max_f"), ["city", "day"])
    return j.withColumns(X.rule_disagreement(X.RULES, "settle_f")).withColumn("frac", F.col("vc_max_f") - F.col("max_round"))


def _derived_inputs(t):
    o = t.obs
    null = lambda c, k: F.when(F.col("event_id") % k == 0, None).otherwise(c)
    m = {
        "obs_fcst_max_gap": null(F.col("temp_f") - 20, 7), "temp_rate_last_30min": null((F.col("wind") - 20) / 10, 5),
        "err_mean_sofar": F.col("humidity") / 10 - 5, "temp_std_last_60min": F.col("wind") / 4,
        "intraday_range_sofar": F.col("temp_f"), "expected_delta_uncertainty": F.col("cloud") / 20 - 1,
        "fcst_multi_mean": F.col("temp_f") - 5, "fcst_multi_std": F.col("wind") / 3, "fcst_multi_range": F.col("wind"),
        "humidity_last_obs": F.col("humidity"), "cloudcover_last_obs": F.col("cloud"), "temp_ema_60min": F.col("temp_f"),
        "day_fraction": F.col("hour") / 24, "station_city_temp_gap": (F.col("event_id") % 5).cast("double"),
        "vc_max_f_sofar": F.col("temp_f") - 1, "fcst_prev_max_f": F.col("humidity"), "fcst_prev_mean_f": F.col("humidity") - 10,
        "fcst_prev_std_f": F.col("wind") - 2, "hours_to_event_close": 23 - F.col("hour").cast("double"),
        "minutes_since_market_open": F.col("hour") * 60 - 120,
    }
    return o.select("event_id", "hour", *[c.alias(n) for n, c in m.items()])


_DIN = """SELECT event_id, hour, CASE WHEN event_id % 7 = 0 THEN NULL ELSE temp_f - 20 END AS gap, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (wind - 20) / 10 END AS rate,
 humidity / 10 - 5 AS err, wind / 4 AS sd, temp_f AS rng, cloud / 20 - 1 AS unc, temp_f - 5 AS mean, wind / 3 AS mstd, wind AS mrng, humidity, cloud, temp_f AS ema, hour / 24 AS df,
 event_id % 5 AS scg, temp_f - 1 AS mx, humidity AS fmax, humidity - 10 AS fmean, wind - 2 AS fstd, 23 - hour AS lft, hour * 60 - 120 AS since FROM v_obs"""


@query("math_engineered", "event_id i, log_abs_obs_fcst_gap f, log_temp_std_last_60min f, log_intraday_range f, log_expected_delta_uncertainty f, temp_rate_last_30min_squared f, err_mean_sofar_squared f, obs_fcst_gap_squared f, fcst_multi_cv f, fcst_multi_range_pct f, humidity_x_temp_rate f, cloudcover_x_hour f, temp_ema_x_day_fraction f, station_city_gap_x_fcst_gap f", f"""
SELECT event_id, ln(1 + abs(gap)) AS log_abs_obs_fcst_gap, CASE WHEN sd >= 0 THEN ln(0.1e0 + sd) END AS log_temp_std_last_60min, CASE WHEN rng >= 0 THEN ln(1 + rng) END AS log_intraday_range,
 CASE WHEN unc > 0 THEN ln(unc) END AS log_expected_delta_uncertainty, rate * rate AS temp_rate_last_30min_squared, err * err AS err_mean_sofar_squared, gap * gap AS obs_fcst_gap_squared,
 CASE WHEN abs(mean) > 0.01 THEN mstd / abs(mean) END AS fcst_multi_cv, CASE WHEN abs(mean) > 0.01 THEN mrng / abs(mean) * 100 END AS fcst_multi_range_pct, humidity * rate AS humidity_x_temp_rate,
 cloud * hour AS cloudcover_x_hour, ema * df AS temp_ema_x_day_fraction, scg * gap AS station_city_gap_x_fcst_gap FROM ({_DIN})""")
def math_engineered(t):
    return _derived_inputs(t).withColumns(X.engineered(F.col))


@query("math_interactions", "event_id i, temp_x_hours_remaining f, gap_x_hours_remaining f, temp_x_day_fraction f, fcst_obs_ratio f, log_minutes_since_open f, log_hours_to_close f, temp_zscore_vs_forecast f", f"""
SELECT event_id, mx * lft AS temp_x_hours_remaining, gap * lft AS gap_x_hours_remaining, mx * df AS temp_x_day_fraction, CASE WHEN mx > 0 THEN fmax / mx END AS fcst_obs_ratio,
 CASE WHEN since > 0 THEN ln(since) END AS log_minutes_since_open, CASE WHEN lft > 0 THEN ln(lft) END AS log_hours_to_close, CASE WHEN fstd > 0 THEN (mx - fmean) / fstd END AS temp_zscore_vs_forecast FROM ({_DIN})""")
def math_interactions(t):
    return _derived_inputs(t).withColumns(X.interactions(F.col))


@query("math_regime", "event_id i, is_heating_phase i, is_plateau_phase i, is_cooling_phase i, obs_confidence f, expected_delta_uncertainty f, fcst_importance_weight f, confidence_weighted_gap f, remaining_upside f", f"""
WITH x AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN NULL ELSE humidity END AS sm, event_id % 2 AS ev, humidity / 3 AS ho FROM ({_DIN})),
p AS (SELECT *, CASE WHEN rate > 0.5 THEN 'h' WHEN rate < -0.5 THEN 'c' WHEN rate IS NOT NULL AND sm IS NOT NULL THEN CASE WHEN sm < 30 THEN 'p' ELSE 'c' END
 WHEN hour < 11 THEN 'h' WHEN hour <= 15 THEN 'p' ELSE 'c' END AS ph, CASE WHEN ev = 1 THEN least(1.0e0, greatest(0.0e0, ho - 24) / 10) ELSE least(0.8e0, ho / 30) END AS conf FROM x)
SELECT event_id, (ph = 'h')::INT AS is_heating_phase, (ph = 'p')::INT AS is_plateau_phase, (ph = 'c')::INT AS is_cooling_phase, conf AS obs_confidence, greatest(2.0e0, 8.0e0 - ho * 0.2e0) AS expected_delta_uncertainty,
 1 - conf AS fcst_importance_weight, (fmax - mx) * (1 - conf) AS confidence_weighted_gap, greatest(0.0e0, fmax - mx) * (1 - conf) AS remaining_upside FROM p""")
def math_regime(t):
    d = _derived_inputs(t).drop("expected_delta_uncertainty").withColumns({
        "sm": F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("humidity_last_obs")), "ev": F.col("event_id") % 2, "ho": F.col("humidity_last_obs") / 3})
    return d.withColumns({**X.regime("temp_rate_last_30min", "sm", "hour"), **X.time_confidence("ho", "ev", "vc_max_f_sofar", "fcst_prev_max_f")})


@query("math_wet_bulb", "event_id i, wb f", """
SELECT event_id, ((temp_f - 32) * 5 / 9 * atan(0.151977e0 * sqrt(humidity + 8.313659e0)) + atan((temp_f - 32) * 5 / 9 + humidity) - atan(humidity - 1.676331e0)
 + 0.00391838e0 * pow(humidity, 1.5e0) * atan(0.023101e0 * humidity) - 4.686035e0) * 9 / 5 + 32 AS wb FROM v_obs""")
def math_wet_bulb(t):
    return t.obs.select("event_id", meteo.wet_bulb("temp_f", "humidity").alias("wb"))


@query("math_wind_chill", "event_id i, wc f", """
SELECT event_id, CASE WHEN temp_f > 50 OR wind < 3 THEN temp_f ELSE 35.74e0 + 0.6215e0 * temp_f - 35.75e0 * pow(wind, 0.16e0) + 0.4275e0 * temp_f * pow(wind, 0.16e0) END AS wc FROM v_obs""")
def math_wind_chill(t):
    return t.obs.select("event_id", meteo.wind_chill("temp_f", "wind").alias("wc"))


PHI_SQL = """(0.3989422804014327e0 * exp(-{z} * {z} / 2) * (1 / (1 + 0.2316419e0 * {z})) * (0.319381530e0 + (1 / (1 + 0.2316419e0 * {z})) * (-0.356563782e0 + (1 / (1 + 0.2316419e0 * {z})) * (1.781477937e0
 + (1 / (1 + 0.2316419e0 * {z})) * (-1.821255978e0 + (1 / (1 + 0.2316419e0 * {z})) * 1.330274429e0)))))"""


@query("math_normal_confidence", "event_id i, conf f", f"""
SELECT event_id, CASE WHEN s > 0 THEN 1 - 2 * {PHI_SQL.format(z='z')} ELSE 0.5 END AS conf
FROM (SELECT event_id, s, CASE WHEN s > 0 THEN abs(temp_f - 15) / s END AS z FROM (SELECT event_id, temp_f, sqrt((wind / 4) * (wind / 4) + (cloud / 9) * (cloud / 9)) AS s FROM v_obs))""")
def math_normal_confidence(t):
    o = t.obs.withColumns({"e": F.col("temp_f") - 15, "a": F.col("wind") / 4, "b": F.col("cloud") / 9})
    return o.select("event_id", probs.edge_confidence("e", "a", "b").alias("conf"))


@query("math_guidance", "run_id i, revision f, drift f, z f", """
SELECT run_id, round_even(a - b, 2) AS revision, round_even(b - a, 2) AS drift, CASE WHEN s >= 0.01e0 THEN round_even((a - 40.001234567e0) / s, 3) END AS z
FROM (SELECT run_id, peak_f AS a, CASE WHEN run_id % 6 = 0 THEN NULL ELSE cust / 30.0e0 + 0.001234567e0 END AS b, (run_id % 9) / 4.0e0 AS s FROM v_run)""")
def math_guidance(t):
    r = t.run.withColumns({"b": F.when(F.col("run_id") % 6 == 0, None).otherwise(F.col("cust") / 30.0 + 0.001234567), "s": (F.col("run_id") % 9) / 4.0})
    return r.withColumns(X.guidance("peak_f", "b", F.lit(40.001234567), "s"))


# --- arrays ---

@query("arr_class_probs_to_temp", "vec_id i, temp i, p f", "SELECT vec_id, t_base + k AS temp, p FROM v_probs_long")
def arr_class_probs_to_temp(t):
    return t.probs.select("vec_id", F.explode(probs.temp_map("p", "classes", "t_base")).alias("temp", "p"))


@query("arr_bracket_prob", "vec_id i, p_range f, p_ge_65 f, p_ge_80 f, grid_lt_60 f, grid_60_65 f, grid_ge_100 f", """
SELECT vec_id, sum(CASE WHEN t_base + k >= 70 AND t_base + k < 75 THEN p ELSE 0 END) AS p_range, sum(CASE WHEN t_base + k >= 65 THEN p ELSE 0 END) AS p_ge_65,
 sum(CASE WHEN t_base + k >= 80 THEN p ELSE 0 END) AS p_ge_80, sum(CASE WHEN t_base + k < 60 THEN p ELSE 0 END) AS grid_lt_60, sum(CASE WHEN t_base + k >= 60 AND t_base + k < 65 THEN p ELSE 0 END) AS grid_60_65,
 sum(CASE WHEN t_base + k >= 100 THEN p ELSE 0 END) AS grid_ge_100 FROM v_probs_long GROUP BY vec_id""")
def arr_bracket_prob(t):
    m = lambda lo=None, hi=None: probs.mass("p", "temps", lo, hi)
    d = t.probs.withColumn("temps", F.transform("classes", lambda k: k + F.col("t_base")))
    return d.select("vec_id", m(70, 74).alias("p_range"), m(65).alias("p_ge_65"), m(80).alias("p_ge_80"), m(None, 59).alias("grid_lt_60"),
                    m(60, 64).alias("grid_60_65"), m(100).alias("grid_ge_100"))


@query("arr_strike_prob", "vec_id i, strike s, p f", """
SELECT vec_id, strike, sum(CASE WHEN (kind = 'less' AND t_base + k <= cp) OR (kind = 'greater' AND t_base + k >= fl + 1) OR (kind = 'between' AND t_base + k BETWEEN fl AND cp) THEN p ELSE 0 END) AS p
FROM v_probs_long, (VALUES ('T70LO','less',NULL,70), ('B71','between',71,74), ('B75','between',75,78), ('T78','greater',78,NULL)) m(strike, kind, fl, cp) GROUP BY vec_id, strike""")
def arr_strike_prob(t):
    """Four strikes of one event evaluated inside each row; nothing is joined."""
    rel = lambda n: N(n) - F.col("t_base")
    ps = [("T70LO", None, rel(70)), ("B71", rel(71), rel(74)), ("B75", rel(75), rel(78)), ("T78", rel(79), None)]
    arr = F.array(*[F.struct(N(s).alias("strike"), probs.mass("p", "classes", a, b).alias("p")) for s, a, b in ps])
    return t.probs.select("vec_id", F.explode(arr).alias("m")).select("vec_id", "m.*")


@query("arr_expected_std", "vec_id i, mean f, sd f", """
SELECT vec_id, any_value(t_base) + sum(k * p) AS mean, sqrt(greatest(sum(k * k * p) - sum(k * p) * sum(k * p), 0)) AS sd FROM v_probs_long GROUP BY vec_id""")
def arr_expected_std(t):
    return t.probs.select("vec_id", (F.col("t_base") + probs.expected("p", "classes")).alias("mean"), probs.std("p", "classes").alias("sd"))


@query("arr_shortest_interval", "vec_id i, lo i, hi i", """
WITH c AS (SELECT a.vec_id, a.t_base, a.k AS lo, b.k AS hi, sum(m.p) AS s FROM v_probs_long a JOIN v_probs_long b ON a.vec_id = b.vec_id AND b.k >= a.k JOIN v_probs_long m ON m.vec_id = a.vec_id AND m.k BETWEEN a.k AND b.k GROUP BY ALL)
SELECT vec_id, t_base + lo AS lo, t_base + hi AS hi FROM c WHERE s >= 0.6e0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY hi - lo, lo) = 1""")
def arr_shortest_interval(t):
    b = probs.shortest_interval("p", "classes", 0.6)
    return t.probs.withColumn("b", b).select("vec_id", (F.col("t_base") + F.col("b.lo")).alias("lo"), (F.col("t_base") + F.col("b.hi")).alias("hi"))


@query("arr_isotonic_monotone", "vec_id i, i i, m f, q f", """
WITH x AS (SELECT vec_id, i, p AS c FROM v_probs_long), mm AS (SELECT vec_id, i, max(c) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM x),
d AS (SELECT vec_id, i, greatest(coalesce(lag(m) OVER w, 1.0) - m, 0) AS d FROM mm WINDOW w AS (PARTITION BY vec_id ORDER BY i)
 UNION ALL SELECT vec_id, 7, greatest(m, 0) FROM mm WHERE i = 6)
SELECT d.vec_id, d.i, mm.m, d / sum(d) OVER (PARTITION BY d.vec_id) AS q FROM d LEFT JOIN mm ON d.vec_id = mm.vec_id AND d.i = mm.i""")
def arr_isotonic_monotone(t):
    d = t.probs.select("vec_id", probs.monotone("p").alias("m"), probs.classes_from_cumulative("p").alias("q"))
    return d.select("vec_id", "m", F.posexplode("q").alias("i", "q")).select("vec_id", "i", F.get("m", F.col("i")).alias("m"), "q")


@query("arr_missing_columns", "event_id i, temp_f f, fcst_max f, market_bid f, flag i, has_market i", """
SELECT event_id, temp_f, NULL AS fcst_max, coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE wind END, 0) AS market_bid, 0 AS flag, (event_id % 4 <> 0)::INT AS has_market FROM v_obs""")
def arr_missing_columns(t):
    from ..operators.columns import complete
    d = t.obs.select("event_id", "temp_f", F.when(F.col("event_id") % 4 == 0, None).otherwise(F.col("wind")).alias("market_bid"))
    return complete(d, {"fcst_max": "double", "market_bid": "double", "flag": "int"}, zero=["market_bid", "flag"], flag={"has_market": "market_bid"})


@query("json_message_meta", "event_id i, stream s, topic s", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ticker' WHEN 1 THEN 'trade' ELSE 'unknown' END AS stream, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || '-m' WHEN 2 THEN event_type || '-x' END AS topic FROM events""")
def json_message_meta(t):
    e, y = F.col("event_id"), F.col("event_type")
    msg = F.to_json(F.struct(
        F.when(e % 3 == 0, "ticker").alias("channel"), F.when(e % 3 == 1, "trade").alias("type"),
        F.when(e % 4 == 0, y).alias("ticker"), F.when(e % 4 == 1, F.concat(y, N("-m"))).alias("market_ticker"),
        F.when(e % 4 == 2, F.struct(F.concat(y, N("-x")).alias("market_ticker"))).alias("msg")))
    return t.events.select("event_id", J.message_meta(msg).alias("m")).select("event_id", "m.*")


@query("json_payload_field", "event_id i, k i, n_name s", """
SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, n_name FROM events JOIN nation ON n_nationkey = user_id % 25 WHERE CAST(props->>'$.k' AS BIGINT) > 90""")
def json_payload_field(t):
    e = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).filter("k > 90")
    return e.join(t.nation, F.col("n_nationkey") == F.col("user_id") % 25)
