"""Aggregations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import derived as X
from ..functions import probs as P
from ..functions.quality import valid_temp
from ..functions.timeutil import DAY, HOUR, MINUTE, epoch_us
from ..operators import audit as A
from ..operators import metrics as M
from ..operators import stats as S
from ..operators.asof import asof
from ..operators.sweep import best_threshold, grouped_results, threshold_totals, trade_stats, with_enough
from .joins import _SNAPJ, snap_markets
from .registry import query
from .scalars import _RULE_SQL

N = F.lit
def CNT():
    return F.count(F.lit(1))


K = list(range(-3, 4))


@query("agg_freshness", "src s, city s, n i, first t, last t", """
SELECT 'obs' AS src, city, count(*) AS n, min(ts) AS first, max(ts) AS last FROM v_obs GROUP BY city UNION ALL SELECT 'trade', city, count(*), min(ts), max(ts) FROM v_trade GROUP BY city
UNION ALL SELECT 'orders', o_orderpriority, count(*), min(o_orderdate), max(o_orderdate) FROM orders GROUP BY 2 UNION ALL SELECT 'lineitem', l_returnflag, count(*), min(l_shipdate), max(l_shipdate) FROM lineitem GROUP BY 2""")
def agg_freshness(t):
    src = [("obs", t.obs, "city", "ts"), ("trade", t.trade, "city", "ts"), ("orders", t.orders, "o_orderpriority", "o_orderdate"),
           ("lineitem", t.lineitem, "l_returnflag", "l_shipdate")]
    out = None
    for name, df, key, ts in src:
        f = A.freshness(df.withColumnRenamed(key, "city") if key != "city" else df, ["city"], ts).withColumn("src", N(name))
        out = f if out is None else out.unionByName(f)
    return out


@query("agg_conditional", "model s, n i, n_null i, null_pct f, n_high i, n_urgent i", """
SELECT model, count(*) AS n, count(*) FILTER (v IS NULL) AS n_null, count(*) FILTER (v IS NULL) * 100.0e0 / count(*) AS null_pct, count(*) FILTER (v > 60) AS n_high, sum(CASE WHEN city = '1-URGENT' THEN 1 ELSE 0 END) AS n_urgent
FROM (SELECT *, CASE WHEN cust % 9 = 0 THEN NULL ELSE peak_f END AS v FROM v_run) GROUP BY model""")
def agg_conditional(t):
    r = t.run.withColumn("v", F.when(F.col("cust") % 9 == 0, None).otherwise(F.col("peak_f")))
    nul = F.count_if(F.col("v").isNull())
    return r.groupBy("model").agg(CNT().alias("n"), nul.alias("n_null"), (nul * 100.0 / CNT()).alias("null_pct"),
                                  F.count_if(F.col("v") > 60).alias("n_high"), F.count_if(F.col("city") == "1-URGENT").alias("n_urgent"))


@query("agg_distinct", "city s, n_days i, n_users i, n_hours i", """
SELECT event_type AS city, count(DISTINCT CAST(ts AS DATE)) AS n_days, count(DISTINCT user_id) AS n_users, count(DISTINCT date_trunc('hour', ts)) AS n_hours FROM events GROUP BY 1""")
def agg_distinct(t):
    """Distinct counts by de-duplicating first, so one city's rows are spread over its values."""
    e = t.events.select(F.col("event_type").alias("city"), F.explode(F.array(
        F.struct(N("d").alias("k"), F.to_date("ts").cast("string").alias("v")), F.struct(N("u").alias("k"), F.col("user_id").cast("string").alias("v")),
        F.struct(N("h").alias("k"), F.date_trunc("hour", "ts").cast("string").alias("v")))).alias("x")).select("city", "x.*").distinct()
    c = lambda k: F.count_if(F.col("k") == k)
    return e.groupBy("city").agg(c("d").alias("n_days"), c("u").alias("n_users"), c("h").alias("n_hours"))


@query("agg_coverage_pct", "city s, day d, slots i, n_rows i, n_temp i, pct f", """
WITH s AS (SELECT city, us // 300000000 AS slot, count(*) AS rows_, count(raw_f) AS n_temp FROM v_obs GROUP BY ALL)
SELECT e.city, e.day, count(s.slot) AS slots, CAST(sum(rows_) AS BIGINT) AS n_rows, CAST(sum(n_temp) AS BIGINT) AS n_temp, round_even(count(s.slot) * 100.0e0 / 456, 1) AS pct
FROM v_settle e JOIN s ON e.city = s.city AND s.slot * 300000000 BETWEEN epoch_us(e.day::TIMESTAMP) - 50400000000 AND epoch_us(e.day::TIMESTAMP) + 86100000000 GROUP BY e.city, e.day""")
def agg_coverage_pct(t):
    e = t.settle.select("city", "day").withColumn("d0", epoch_us(F.col("day").cast("timestamp_ntz")))
    c = A.slot_coverage(e, t.obs, ["city", "day"], ["raw_f"], 300_000_000, F.col("d0") - 14 * HOUR, F.col("d0") + 23 * HOUR + 55 * MINUTE)
    return c.select("city", "day", "slots", F.col("rows").alias("n_rows"), F.col("n_raw_f").alias("n_temp"), F.bround(F.col("slots") * 100.0 / 456, 1).alias("pct"))


@query("agg_missing_leads", "city s, day d, present s, missing s", """
SELECT city, day, string_agg(CAST(lead AS VARCHAR), ',' ORDER BY lead) FILTER (ok) AS present, coalesce(string_agg(CAST(lead AS VARCHAR), ',' ORDER BY lead) FILTER (NOT ok), '') AS missing
FROM (SELECT s.city, s.day, r.lead, f.lead IS NOT NULL AS ok FROM v_settle s CROSS JOIN range(7) r(lead) LEFT JOIN v_fcst f ON f.city = s.city AND f.day = s.day AND f.lead = r.lead) GROUP BY city, day""")
def agg_missing_leads(t):
    m = A.missing_leads(t.fcst, ["city", "day"], 6)
    s = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return m.select("city", "day", s("present").alias("present"), s("missing").alias("missing"))


_COV = """
WITH g AS (SELECT mkt, bucket_us, lag(bucket_us) OVER (PARTITION BY mkt ORDER BY bucket_us) AS p FROM v_candle),
a AS (SELECT mkt, sum(greatest((bucket_us - coalesce(p, bucket_us)) // 60000000 - 1, 0)) AS gap, count(*) AS n FROM g GROUP BY mkt),
c AS (SELECT m.mkt, CASE WHEN a.mkt IS NULL THEN 0 ELSE (close_us - listed_us) // 60000000 + 1 END AS expected_minutes, coalesce(n, 0) AS actual_minutes, coalesce(gap, 0) AS gap_minutes FROM v_market m LEFT JOIN a USING (mkt))
SELECT *, greatest(expected_minutes - actual_minutes, 0) AS short_minutes, gap_minutes + greatest(expected_minutes - actual_minutes, 0) AS missing_minutes FROM c"""


@query("agg_minute_gaps", "mkt s, expected_minutes i, actual_minutes i, gap_minutes i, short_minutes i, missing_minutes i", _COV)
def agg_minute_gaps(t):
    return A.market_coverage(t.market, t.candle)


@query("agg_hour_coverage", "city s, day d, n_hours i, share f, earliest i, latest i", """
SELECT city, day, count(DISTINCT hour) AS n_hours, count(DISTINCT hour) FILTER (hour BETWEEN 6 AND 23) / 18.0e0 AS share, min(hour) AS earliest, max(hour) AS latest FROM v_obs GROUP BY city, day""")
def agg_hour_coverage(t):
    return A.hour_coverage(t.obs, ["city", "day"])


@query("agg_ohlc_from_trades", "mkt s, minute u, o i, h i, l i, c i, v i, n i", """
SELECT mkt, us - us % 60000000 AS minute, arg_min(price, struct_pack(a := us, b := seq)) AS o, max(price) AS h, min(price) AS l, arg_max(price, struct_pack(a := us, b := seq)) AS c, sum(cnt) AS v, count(*) AS n FROM v_trade GROUP BY 1, 2""")
def agg_ohlc_from_trades(t):
    from ..operators.candles import ohlc
    return ohlc(t.trade, ["mkt"], MINUTE)


@query("agg_partial_day_stats", "city s, day d, max_f f, min_f f, mean_f f, std_f f, q10_f f, q25_f f, q50_f f, q75_f f, q90_f f, n i, t_base i, frac_part f, range_f f, iqr_f f", """
SELECT *, max_f - min_f AS range_f, q75_f - q25_f AS iqr_f FROM (
SELECT city, day, max(temp_f) AS max_f, min(temp_f) AS min_f, avg(temp_f) AS mean_f, coalesce(stddev_samp(temp_f), 0) AS std_f, quantile_cont(temp_f, 0.1) AS q10_f, quantile_cont(temp_f, 0.25) AS q25_f, quantile_cont(temp_f, 0.5) AS q50_f,
 quantile_cont(temp_f, 0.75) AS q75_f, quantile_cont(temp_f, 0.9) AS q90_f, count(*) AS n, CAST(round_even(max(temp_f), 0) AS BIGINT) AS t_base, max(temp_f) - round_even(max(temp_f), 0) AS frac_part FROM v_obs GROUP BY city, day)""")
def agg_partial_day_stats(t):
    return S.partial_day(t.obs, ["city", "day"], "temp_f")


@query("agg_forecast_static", "city s, day d, max_f f, mean_f f, std_f f, q50_f f, t_base i, hour_idx i, dist_int f, near_flag i", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY city, day ORDER BY hour) - 1 AS i FROM v_fcst_hourly)
SELECT *, (dist_int < 0.25)::INT AS near_flag FROM (SELECT city, day, max(temp_f) AS max_f, avg(temp_f) AS mean_f, stddev_samp(temp_f) AS std_f, quantile_cont(temp_f, 0.5) AS q50_f, CAST(round_even(max(temp_f), 0) AS BIGINT) AS t_base,
 arg_max(i, struct_pack(a := temp_f, b := -i)) AS hour_idx, least(max(temp_f) - floor(max(temp_f)), 1 - (max(temp_f) - floor(max(temp_f)))) AS dist_int FROM r GROUP BY city, day)""")
def agg_forecast_static(t):
    c = t.fcst_hourly.withColumn("i", F.row_number().over(Window.partitionBy("city", "day").orderBy("hour")) - 1)
    top = c.groupBy("city", "day").agg(F.max_by("i", F.struct(F.col("temp_f"), -F.col("i"))).alias("hour_idx"))
    s = S.partial_day(t.fcst_hourly, ["city", "day"], "temp_f", bounded=True).join(top, ["city", "day"])
    fr = F.col("max_f") - F.floor("max_f")
    return s.withColumn("dist_int", F.least(fr, 1 - fr)).withColumn("near_flag", F.col("dist_int") < 0.25)


@query("agg_linear_slope", "city s, day d, n i, rate f, ols f", """
WITH m AS (SELECT city, day, max(us) AS lu FROM v_obs GROUP BY ALL), x AS (SELECT o.city, o.day, temp_f AS y, (us - lu) / 6e7 AS x FROM v_obs o JOIN m USING (city, day) WHERE us >= lu - 7200000000)
SELECT city, day, count(*) AS n, CASE WHEN count(*) >= 2 THEN covar_samp(y, x) / var_pop(x) * 60 END AS rate, regr_slope(y, x) * 60 AS ols FROM x GROUP BY ALL""")
def agg_linear_slope(t):
    return S.tail_slopes(t.obs, ["city", "day"], "us", "temp_f", 120)


@query("agg_ema_decay", "city s, day d, ema f", """
WITH m AS (SELECT city, day, max(us) AS lu FROM v_obs GROUP BY ALL)
SELECT city, day, sum(exp(-0.6931471805599453e0 / 60 * ((lu - us) / 6e7)) * temp_f) / sum(exp(-0.6931471805599453e0 / 60 * ((lu - us) / 6e7))) AS ema FROM v_obs JOIN m USING (city, day) GROUP BY ALL""")
def agg_ema_decay(t):
    return S.ema(t.obs, ["city", "day"], "us", "temp_f", 60)


_BAD = "raw_f IS NULL OR abs(raw_f + 77.9e0) < 0.1e0 OR raw_f NOT BETWEEN -50 AND 150"


@query("agg_having_quality", "city s, day d, n i, bad i, bad_pct f, is_bad_day i", f"""
SELECT *, (bad_pct >= 15)::INT AS is_bad_day FROM (SELECT city, day, count(*) AS n, count(*) FILTER ({_BAD}) AS bad, count(*) FILTER ({_BAD}) * 100.0e0 / count(*) AS bad_pct FROM v_obs GROUP BY city, day) WHERE bad_pct > 0""")
def agg_having_quality(t):
    return A.quality_days(t.obs, ["city", "day"], ~valid_temp("raw_f")).withColumn("is_bad_day", F.col("bad_pct") >= 15)


@query("agg_mode", "city s, day d, consensus i", f"""
WITH p AS ({_RULE_SQL}), l AS (SELECT city, day, i, [max_round, max_of_rounded, ceil_max, floor_max, plateau_20min, ignore_singletons, c_first][i] AS v FROM p, range(1, 8) r(i)),
c AS (SELECT city, day, v, count(*) AS n, min(i) AS fi FROM l GROUP BY city, day, v)
SELECT city, day, v AS consensus FROM c QUALIFY row_number() OVER (PARTITION BY city, day ORDER BY n DESC, fi) = 1""")
def agg_mode(t):
    from ..operators.rules import daily_rules
    return daily_rules(t.obs).select("city", "day", X.consensus(X.RULES).alias("consensus"))


@query("agg_run_metrics", "city s, n_trades i, total_pnl i, avg_pnl f, win_rate f, sharpe f, n_days i, daily_sharpe f, roi_pct f", """
WITH d AS (SELECT city, day, sum(pnl) AS p FROM v_bt GROUP BY ALL), a AS (SELECT city, count(*) AS n_trades, sum(pnl) AS total_pnl, avg(pnl) AS avg_pnl, avg(won) AS win_rate, avg(pnl) / stddev_samp(pnl) AS sharpe, sum(pnl) / (sum(n * price) / 100.0e0) * 100 AS roi_pct FROM v_bt GROUP BY city)
SELECT a.*, x.n_days, x.daily_sharpe FROM a JOIN (SELECT city, count(*) AS n_days, avg(p) / stddev_samp(p) AS daily_sharpe FROM d GROUP BY city) x USING (city)""")
def agg_run_metrics(t):
    from ..operators.strategies import run_metrics
    return run_metrics(t.bt.withColumn("entry", F.col("price").cast("double")), ["city"])


@query("agg_annualised_sharpe", "part s, n_days i, mean_pnl f, sharpe f", """
WITH d AS (SELECT day, CASE WHEN day < DATE '1998-01-01' THEN 'early' ELSE 'late' END AS part, sum(pnl) AS p FROM v_bt GROUP BY ALL)
SELECT part, count(*) AS n_days, avg(p) AS mean_pnl, avg(p) / stddev_samp(p) * sqrt(252) AS sharpe FROM d GROUP BY part""")
def agg_annualised_sharpe(t):
    d = t.bt.groupBy("day").agg(F.sum("pnl").alias("p")).withColumn("part", F.when(F.col("day") < F.lit("1998-01-01").cast("date"), "early").otherwise("late"))
    return d.groupBy("part").agg(CNT().alias("n_days"), F.avg("p").alias("mean_pnl"), (F.avg("p") / F.stddev_samp("p") * F.sqrt(N(252.0))).alias("sharpe"))


@query("agg_by_group", "city s, month d, n i, pnl i, win_rate f", """
SELECT city, CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS n, sum(pnl) AS pnl, avg(won) AS win_rate FROM v_bt GROUP BY 1, 2 HAVING count(*) >= 10""")
def agg_by_group(t):
    return grouped_results(t.bt, ["city", F.to_date(F.date_trunc("month", "day")).alias("month")], min_trades=10)


@query("agg_rule_stats", "rule s, n i, exact i, off_1 i, off_2plus i, mae f, accuracy f", f"""
WITH p AS ({_RULE_SQL}), l AS (SELECT p.city, p.day, ['max_round','max_of_rounded','ceil_max','floor_max','plateau_20min','ignore_singletons','c_first'][i] AS rule, abs([max_round, max_of_rounded, ceil_max, floor_max, plateau_20min, ignore_singletons, c_first][i] - s.settle_f) AS e
 FROM p JOIN v_settle s ON s.city = p.city AND s.day = p.day, range(1, 8) r(i))
SELECT rule, count(*) AS n, count(*) FILTER (e = 0) AS exact, count(*) FILTER (e = 1) AS off_1, count(*) FILTER (e >= 2) AS off_2plus, avg(e) AS mae, avg((e = 0)::INT) AS accuracy FROM l GROUP BY rule""")
def agg_rule_stats(t):
    from ..operators.rules import daily_rules
    j = daily_rules(t.obs).join(t.settle.select("city", "day", "settle_f"), ["city", "day"])
    return rule_stats(j)


def rule_stats(j):
    l = j.unpivot(["city", "day", "settle_f"], [F.col(r).cast("long").alias(r) for r in X.RULES], "rule", "pred")
    e = F.abs(F.col("pred") - F.col("settle_f"))
    return l.filter("pred IS NOT NULL").groupBy("rule").agg(
        CNT().alias("n"), F.count_if(e == 0).alias("exact"), F.count_if(e == 1).alias("off_1"), F.count_if(e >= 2).alias("off_2plus"),
        F.avg(e.cast("double")).alias("mae"), F.avg((e == 0).cast("double")).alias("accuracy"))


_DM = "SELECT vec_id, y, CAST(list_position(p, list_max(p)) - 4 AS BIGINT) AS pred FROM v_probs"


@query("agg_delta_metrics", "n i, accuracy f, mae f, off_by_1 f, off_by_2plus f, within_1 f, within_2 f", f"""
SELECT count(*) AS n, avg((e = 0)::INT) AS accuracy, avg(e) AS mae, avg((e = 1)::INT) AS off_by_1, avg((e >= 2)::INT) AS off_by_2plus, avg((e <= 1)::INT) AS within_1, avg((e <= 2)::INT) AS within_2 FROM (SELECT abs(y - pred) AS e FROM ({_DM}))""")
def agg_delta_metrics(t):
    return M.delta_metrics(t.probs.withColumn("pred", P.mode("p", "classes")), "y", "pred")


@query("agg_ordinal_metrics", "n i, mean_rank_error f, ordinal_loss f", f"""
SELECT count(*) AS n, avg(abs(d.y - d.pred)) AS mean_rank_error, avg(l.sq) AS ordinal_loss FROM ({_DM}) d JOIN (SELECT vec_id, sum(p * (k - y) * (k - y)) AS sq FROM v_probs_long GROUP BY vec_id) l USING (vec_id)""")
def agg_ordinal_metrics(t):
    return M.ordinal_metrics(t.probs)


@query("agg_brier_cumulative", "k i, score f, cum_acc f", """
SELECT kk AS k, avg((q - h) * (q - h)) AS score, avg(((q > 0.5) = (h = 1))::INT) AS cum_acc FROM (SELECT vec_id, kk, sum(CASE WHEN k >= kk THEN p ELSE 0 END) AS q, max((y >= kk)::INT) AS h FROM v_probs_long, range(-2, 4) r(kk) GROUP BY vec_id, kk) GROUP BY kk""")
def agg_brier_cumulative(t):
    b = M.cumulative_brier(t.probs, K)
    return b.join(M.cumulative_accuracy(t.probs, K).withColumnRenamed("score", "cum_acc"), "k")


@query("agg_brier_bracket", "n i, mean_prob f, hit_rate f, brier f", """
SELECT count(*) AS n, avg(q) AS mean_prob, avg(h) AS hit_rate, avg((q - h) * (q - h)) AS brier FROM (SELECT vec_id, sum(CASE WHEN t_base + k >= 80 THEN p ELSE 0 END) AS q, max((t_base + y >= 80)::INT) AS h FROM v_probs_long GROUP BY vec_id)""")
def agg_brier_bracket(t):
    return M.bracket_brier(t.probs.withColumn("settled", F.col("t_base") + F.col("y")), 80, "settled")


@query("agg_logloss_ece", "n i, log_loss f, ece f", """
WITH b AS (SELECT k, CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS mp, avg((y = k)::INT) AS ob FROM v_probs_long GROUP BY 1, 2)
SELECT count(*) AS n, avg(-ln(greatest(1e-15, least(1 - 1e-15, p)))) AS log_loss, (SELECT sum(n * abs(mp - ob)) / sum(n) FROM b) AS ece FROM v_probs_long WHERE y = k""")
def agg_logloss_ece(t):
    e = M.expected_calibration_error(t.probs_long.withColumn("hit", F.col("y") == F.col("k")))
    return M.log_loss(t.probs).withColumn("ece", e.scalar())


@query("agg_calibration_curve", "bin i, n i, mean_pred f, observed f", """
SELECT CAST(least(floor(prob * 10), 9) AS INT) AS bin, count(*) AS n, avg(prob) AS mean_pred, avg(won) AS observed FROM v_bt GROUP BY 1""")
def agg_calibration_curve(t):
    return M.calibration_bins(t.bt, "prob", "won")


@query("agg_settlement_metrics", "n i, accuracy f, mae f, rmse f", """
SELECT count(*) AS n, avg((e = 0)::INT) AS accuracy, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM (SELECT settle_f - (CAST(round_even(vc_max_f, 0) AS BIGINT) + di % 3 - 1) AS e FROM v_settle)""")
def agg_settlement_metrics(t):
    e = (F.col("settle_f") - (F.bround("vc_max_f", 0).cast("long") + F.col("di") % 3 - 1)).cast("double")
    return t.settle.select(e.alias("e")).agg(CNT().alias("n"), F.avg((F.col("e") == 0).cast("double")).alias("accuracy"),
                                             F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))


_SK = """WITH x AS (SELECT price % 22 AS h, CAST(round_even(edge, 0) AS BIGINT) AS raw, greatest(-2, least(10, CAST(round_even(edge, 0) AS BIGINT))) AS y, sk % 5 - 1 AS pred FROM v_bt),
b AS (SELECT CASE WHEN h < 2 THEN '0-2h' WHEN h < 6 THEN '2-6h' WHEN h < 12 THEN '6-12h' WHEN h < 18 THEN '12-18h' WHEN h < 24 THEN '18-24h' ELSE '24h+' END AS bucket, * FROM x),
s AS (SELECT n.bucket, count(b.h) AS n, avg((y = pred)::INT) AS accuracy, avg((abs(y - pred) <= 1)::INT) AS within_1, avg((abs(y - pred) <= 2)::INT) AS within_2, avg(abs(y - pred)) AS mae, stddev_pop(raw) AS raw_std, avg(raw) AS raw_mean,
 avg((raw < -2)::INT) * 100 AS clip_low_pct, avg((raw > 10)::INT) * 100 AS clip_high_pct FROM (VALUES ('0-2h'),('2-6h'),('6-12h'),('12-18h'),('18-24h'),('24h+')) n(bucket) LEFT JOIN b USING (bucket) GROUP BY n.bucket)"""


def _skill(t):
    raw = F.bround("edge", 0).cast("long")
    x = t.bt.select((F.col("price") % 22).alias("h"), raw.alias("raw"), F.greatest(N(-2), F.least(N(10), raw)).alias("y"), (F.col("sk") % 5 - 1).alias("pred"))
    return M.skill_by_horizon(x, "h", "y", "pred", "raw")


@query("agg_skill_by_horizon", "bucket s, n i, accuracy f, within_1 f, within_2 f, mae f, raw_std f, raw_mean f, clip_low_pct f, clip_high_pct f", f"{_SK} SELECT * FROM s")
def agg_skill_by_horizon(t):
    return _skill(t)


@query("agg_risk_multipliers", "bucket s, raw_std f, size_mult f, edge_mult f", f"""{_SK}
SELECT s.bucket, s.raw_std, least(1, greatest(0.05e0, b.raw_std * b.raw_std / (s.raw_std * s.raw_std))) AS size_mult, greatest(1, least(3, s.raw_std / b.raw_std)) AS edge_mult FROM s, (SELECT raw_std FROM s WHERE bucket = '0-2h') b WHERE s.raw_std > 0""")
def agg_risk_multipliers(t):
    return M.risk_multipliers(_skill(t))


@query("agg_null_profile", "column_name s, n_rows i, non_null i, rate f", """
SELECT 'raw_f' AS column_name, count(*) AS n_rows, count(raw_f) AS non_null, count(raw_f) * 1.0e0 / count(*) AS rate FROM v_obs UNION ALL SELECT 'temp_f', count(*), count(temp_f), count(temp_f) * 1.0e0 / count(*) FROM v_obs
UNION ALL SELECT 'wind', count(*), count(wind), count(wind) * 1.0e0 / count(*) FROM v_obs""")
def agg_null_profile(t):
    return A.null_profile(t.obs, ["raw_f", "temp_f", "wind"]).withColumnsRenamed({"column": "column_name", "rows": "n_rows"})


@query("agg_error_history", "city s, day d, lag1 f, mean7 f, mae f, bias f", """
WITH e AS (SELECT f.city, f.day, s.settle_f - f.tempmax_f AS e FROM v_fcst f JOIN v_settle s USING (city, day) WHERE lead = 1)
SELECT city, day, lag(e) OVER w AS lag1, avg(e) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean7, avg(abs(e)) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS mae, avg(e) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS bias FROM e WINDOW w AS (PARTITION BY city ORDER BY day)""")
def agg_error_history(t):
    """One row per (city, day): the window partition is bounded by calendar days."""
    e = t.fcst.filter("lead = 1").join(t.settle.select("city", "day", "settle_f"), ["city", "day"]).withColumn("e", F.col("settle_f") - F.col("tempmax_f"))
    w = Window.partitionBy("city").orderBy("day")
    return e.select("city", "day", F.lag("e").over(w).alias("lag1"), F.avg("e").over(w.rowsBetween(-7, -1)).alias("mean7"),
                    F.avg(F.abs("e")).over(w.rowsBetween(-30, -1)).alias("mae"), F.avg("e").over(w.rowsBetween(-30, -1)).alias("bias"))


@query("agg_series_comparison", "city s, day d, n i, max_a f, max_b f, max_diff f, at_us u, mean_diff f, std_diff f, max_abs f", """
SELECT a.city, a.day, count(*) AS n, max(a.temp_f) AS max_a, max(b.temp_f) AS max_b, max(a.temp_f) - max(b.temp_f) AS max_diff, arg_max(a.us, struct_pack(a := a.temp_f, b := -a.us)) AS at_us, avg(a.temp_f - b.temp_f) AS mean_diff, stddev_samp(a.temp_f - b.temp_f) AS std_diff, max(abs(a.temp_f - b.temp_f)) AS max_abs
FROM v_obs a JOIN v_obs2 b ON a.city = b.city AND a.event_id = b.event_id GROUP BY a.city, a.day""")
def agg_series_comparison(t):
    b = t.obs2.select("city", "day", "us", "event_id", F.col("temp_f").alias("b"))
    j = t.obs.select("city", "day", "us", "event_id", F.col("temp_f").alias("a")).join(b, ["city", "day", "us", "event_id"])
    d = F.col("a") - F.col("b")
    return j.groupBy("city", "day").agg(CNT().alias("n"), F.max("a").alias("max_a"), F.max("b").alias("max_b"), (F.max("a") - F.max("b")).alias("max_diff"),
                                        F.max_by("us", F.struct(F.col("a"), -F.col("us"))).alias("at_us"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("std_diff"), F.max(F.abs(d)).alias("max_abs"))




@query("agg_threshold_sweep", "thr f, n i, mean_pnl f, std_pnl f, sharpe f, hit_rate f, total i, best i", """
WITH s AS (SELECT i * 0.5e0 AS thr, count(*) AS n, avg(pnl) AS mean_pnl, stddev_pop(pnl) AS std_pnl, avg(pnl) / stddev_pop(pnl) AS sharpe, avg(won) AS hit_rate, sum(pnl) AS total FROM v_bt, range(0, 25) r(i) WHERE abs(edge) >= i * 0.5e0 GROUP BY i)
SELECT *, (thr = (SELECT thr FROM s WHERE n >= 100 ORDER BY sharpe DESC, thr LIMIT 1))::INT AS best FROM s""")
def agg_threshold_sweep(t):
    s = sweep(t.bt, F.abs("edge"), [i * 0.5 for i in range(25)])
    return s.withColumn("best", F.col("thr") == best_threshold(s, min_trades=100).scalar())


def sweep(bt, value, thresholds, by=()):
    sums = {"n": N(1), "s": F.col("pnl"), "ss": F.col("pnl") * F.col("pnl"), "w": F.col("won")}
    return trade_stats(threshold_totals(bt, value, thresholds, sums, by)).withColumn("total", F.col("s"))


@query("agg_decision_threshold_curve", "thr f, n i, mean_pnl f, sharpe f, hit_rate f", """
SELECT CAST(i AS DOUBLE) / 100 AS thr, count(*) AS n, CASE WHEN count(*) >= 200 THEN avg(pnl) END AS mean_pnl, CASE WHEN count(*) >= 200 THEN avg(pnl) / stddev_pop(pnl) END AS sharpe, CASE WHEN count(*) >= 200 THEN avg(won) END AS hit_rate FROM v_bt, range(50, 100) r(i) WHERE prob >= CAST(i AS DOUBLE) / 100 GROUP BY i""")
def agg_decision_threshold_curve(t):
    s = sweep(t.bt, "prob", [i / 100 for i in range(50, 100)])
    return with_enough(s, ["mean_pnl", "sharpe", "hit_rate"], min_trades=200)


@query("agg_auc", "n_pos i, n_neg i, auc f", """
WITH r AS (SELECT won, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0e0 AS rk FROM v_bt)
SELECT sum(won) AS n_pos, count(*) - sum(won) AS n_neg, (sum(CASE WHEN won = 1 THEN rk END) - sum(won) * (sum(won) + 1) / 2.0e0) / (sum(won) * (count(*) - sum(won))) AS auc FROM r""")
def agg_auc(t):
    return M.auc(t.bt, "prob", "won")


@query("agg_forecast_drift", "city s, day d, n_leads i, drift_std f, max_upside f, max_downside f, mean_delta f, slope_per_lead f", """
SELECT city, day, count(*) AS n_leads, coalesce(stddev_samp(x), 0) AS drift_std, max(x) - a AS max_upside, min(x) - a AS max_downside, avg(x) - a AS mean_delta, regr_slope(x, lead) AS slope_per_lead
FROM (SELECT city, day, lead, tempmax_f AS x, first_value(tempmax_f) OVER (PARTITION BY city, day ORDER BY (lead <> 1)::INT, lead) AS a FROM v_fcst) GROUP BY city, day, a""")
def agg_forecast_drift(t):
    return S.drift(t.fcst, ["city", "day"])


@query("agg_multi_horizon", "city s, day d, multi_mean f, multi_median f, multi_ema f, multi_std f, multi_range f, t1_t2_diff f, drift f", """
SELECT city, day, avg(tempmax_f) AS multi_mean, median(tempmax_f) AS multi_median, sum(exp(-0.15e0 * (lead - 1)) * tempmax_f) / sum(exp(-0.15e0 * (lead - 1))) AS multi_ema, coalesce(stddev_samp(tempmax_f), 0) AS multi_std, max(tempmax_f) - min(tempmax_f) AS multi_range,
 max(tempmax_f) FILTER (lead = 1) - max(tempmax_f) FILTER (lead = 2) AS t1_t2_diff, max(tempmax_f) FILTER (lead = 1) - max(tempmax_f) FILTER (lead = 6) AS drift FROM v_fcst WHERE lead BETWEEN 1 AND 6 GROUP BY city, day""")
def agg_multi_horizon(t):
    return S.multi_horizon(t.fcst, ["city", "day"])


@query("agg_forecast_multivar", "city s, day d, humidity_mean f, humidity_min f, humidity_max f, humidity_range f, cloud_mean f, cloud_range f, dew_mean f, dew_min f, dew_max f, am_humidity f, pm_humidity f", """
SELECT city, day, avg(humidity) AS humidity_mean, min(humidity) AS humidity_min, max(humidity) AS humidity_max, max(humidity) - min(humidity) AS humidity_range, avg(cloud) AS cloud_mean, max(cloud) - min(cloud) AS cloud_range, avg(dew) AS dew_mean, min(dew) AS dew_min, max(dew) AS dew_max,
 avg(humidity) FILTER (hour BETWEEN 6 AND 11) AS am_humidity, avg(humidity) FILTER (hour BETWEEN 12 AND 18) AS pm_humidity FROM v_fcst_hourly GROUP BY city, day""")
def agg_forecast_multivar(t):
    return S.multivar(t.fcst_hourly, ["city", "day"])


@query("agg_peak_window", "city s, day d, peak_f f, peak_hour f, band_width_min i", """
WITH r AS (SELECT *, max(temp_f) OVER (PARTITION BY city, day) AS m, row_number() OVER (PARTITION BY city, day ORDER BY hour) AS i FROM v_fcst_hourly)
SELECT city, day, max(temp_f) AS peak_f, min(hour) FILTER (temp_f = m) AS peak_hour, (max(i) FILTER (temp_f >= m - 1) - min(i) FILTER (temp_f >= m - 1) + 1) * 60 AS band_width_min FROM r GROUP BY city, day""")
def agg_peak_window(t):
    return S.peak_window(t.fcst_hourly, ["city", "day"])


@query("agg_station_city_gap", "city s, day d, n i, gap_last f, max_gap f, mean_gap f, gap_std f, warmer i, gap_trend f", """
WITH j AS (SELECT a.city, a.day, a.temp_f AS a, b.temp_f AS b, a.temp_f - b.temp_f AS g, row_number() OVER (PARTITION BY a.city, a.day ORDER BY a.us, a.event_id) AS rn, count(*) OVER (PARTITION BY a.city, a.day) AS n FROM v_obs a JOIN v_obs2 b ON a.event_id = b.event_id)
SELECT city, day, count(*) AS n, arg_max(g, rn) AS gap_last, max(a) - max(b) AS max_gap, avg(g) AS mean_gap, stddev_pop(g) AS gap_std, (arg_max(g, rn) < 0)::INT AS warmer, CASE WHEN count(*) >= 4 THEN avg(g) FILTER (rn > n // 2) - avg(g) FILTER (rn <= n // 2) END AS gap_trend FROM j GROUP BY city, day""")
def agg_station_city_gap(t):
    return S.station_gap(t.obs, t.obs2, ["city", "day"], ["us", "event_id"])


@query("agg_market_entropy", "city s, day d, us u, argmax_idx i, max_prob f, entropy f, upper_mass f", f"""
WITH q AS (SELECT s.city, s.day, s.us, s.j, c.bid / 100.0e0 AS p FROM ({_SNAPJ}) s ASOF JOIN v_candle c ON s.mkt = c.mkt AND s.us > c.bucket_us),
n AS (SELECT *, p / sum(p) OVER (PARTITION BY city, day, us) AS q, row_number() OVER (PARTITION BY city, day, us ORDER BY j) - 1 AS i, count(*) OVER (PARTITION BY city, day, us) AS n FROM q)
SELECT city, day, us, arg_max(i, struct_pack(a := q, b := -i)) AS argmax_idx, max(q) AS max_prob, -sum(q * ln(q + 1e-10)) AS entropy, sum(CASE WHEN i >= n // 2 THEN q ELSE 0 END) AS upper_mass FROM n GROUP BY city, day, us""")
def agg_market_entropy(t):
    q = asof(snap_markets(t), t.candle, ["mkt"], "us", "bucket_us", {"bid": "bid"}, inclusive=False)
    return S.bracket_entropy(q, ["city", "day", "us"], "j", "bid")


@query("agg_horizon_coverage_72h", "city s, basis d, n i, h0 i, h1 i, complete i, share f", """
SELECT city, basis, count(*) AS n, min(lh) AS h0, max(lh) AS h1, (count(*) = 72 AND min(lh) = 0 AND max(lh) = 71)::INT AS complete, count(*) / 72.0e0 AS share FROM (SELECT city, day - CAST(k AS INT) AS basis, k * 24 + hour AS lh FROM v_fcst_hourly, range(3) r(k)) GROUP BY city, basis""")
def agg_horizon_coverage_72h(t):
    h = t.fcst_hourly.select("city", "day", "hour", F.explode(F.array(N(0), N(1), N(2))).alias("k")).select("city", F.date_sub("day", F.col("k")).alias("basis"), (F.col("k") * 24 + F.col("hour")).alias("lh"))
    g = h.groupBy("city", "basis").agg(CNT().alias("n"), F.min("lh").alias("h0"), F.max("lh").alias("h1"))
    return g.withColumns({"complete": (F.col("n") == 72) & (F.col("h0") == 0) & (F.col("h1") == 71), "share": F.col("n") / 72.0})


@query("agg_staleness_check", "city s, last_us u, age_min i, status s", """
SELECT c.city, last_us, (1706572800000000 - last_us) // 60000000 AS age_min, CASE WHEN last_us IS NULL THEN 'missing' WHEN 1706572800000000 - last_us > 1800000000 THEN 'stale' ELSE 'pass' END AS status
FROM (SELECT DISTINCT event_type AS city FROM events) c LEFT JOIN (SELECT city, max(us) AS last_us FROM (SELECT city, us + CASE WHEN city = 'signup' THEN 5184000000000 ELSE 0 END AS us FROM v_obs) WHERE us <= 1706572800000000 GROUP BY city) o USING (city)""")
def agg_staleness_check(t):
    now = 1_706_572_800_000_000
    # One city's rows are sixty days later, so that at this time nothing of it is known.
    o = t.obs.withColumn("us", F.col("us") + F.when(F.col("city") == "signup", 60 * DAY).otherwise(0))
    return A.staleness(t.events.select(F.col("event_type").alias("city")).distinct(), o.filter(F.col("us") <= now), ["city"], "us", now, 30 * MINUTE)


@query("agg_infer_step", "city s, step_min i", """
WITH d AS (SELECT city, (us - lag(us) OVER (PARTITION BY city ORDER BY us)) // 1000000 AS g FROM v_obs) SELECT city, CAST(round_even(median(g) / 60, 0) AS BIGINT) AS step_min FROM d GROUP BY city""")
def agg_infer_step(t):
    return A.step_minutes(t.obs, ["city"], "us")


@query("agg_opportunity_summary", "city s, n i, total_ev f, avg_ev f, best_pk i, take i, make i", """
SELECT city, count(*) AS n, sum(ev) AS total_ev, avg(ev) AS avg_ev, arg_max(pk, struct_pack(a := ev, b := -pk)) AS best_pk, count(*) FILTER (mode = 'take') AS take, count(*) FILTER (mode = 'make') AS make
FROM (SELECT city, pk, CAST(round(prob * 1000) AS BIGINT) - 10 * price AS ev, CASE WHEN sk % 2 = 0 THEN 'take' ELSE 'make' END AS mode FROM v_bt) WHERE ev > 0 GROUP BY city""")
def agg_opportunity_summary(t):
    o = t.bt.select("city", "pk", (F.round(F.col("prob") * 1000).cast("long") - 10 * F.col("price")).alias("ev"), F.when(F.col("sk") % 2 == 0, "take").otherwise("make").alias("mode")).filter("ev > 0")
    return o.groupBy("city").agg(CNT().alias("n"), F.sum("ev").alias("total_ev"), F.avg("ev").alias("avg_ev"), F.max_by("pk", F.struct(F.col("ev"), -F.col("pk"))).alias("best_pk"),
                                 F.count_if(F.col("mode") == "take").alias("take"), F.count_if(F.col("mode") == "make").alias("make"))


@query("agg_date_overlap", "d0 d, d1 d, n_days i", """
SELECT greatest(a0, b0) AS d0, least(a1, b1) AS d1, least(a1, b1) - greatest(a0, b0) + 1 AS n_days FROM (SELECT min(CAST(o_orderdate AS DATE)) a0, max(CAST(o_orderdate AS DATE)) a1 FROM orders), (SELECT min(CAST(l_shipdate AS DATE)) b0, max(CAST(l_shipdate AS DATE)) b1 FROM lineitem)""")
def agg_date_overlap(t):
    span = lambda df, c: df.agg(F.to_date(F.min(c)).alias("lo"), F.to_date(F.max(c)).alias("hi"))
    j = span(t.orders, "o_orderdate").union(span(t.lineitem, "l_shipdate")).agg(F.max("lo").alias("d0"), F.min("hi").alias("d1"))
    return j.withColumn("n_days", F.datediff("d1", "d0") + 1)


@query("agg_probability_histogram", "bin i, n i", "SELECT CAST(least(floor(prob * 20), 19) AS INT) + 1 AS bin, count(*) AS n FROM v_bt GROUP BY 1")
def agg_probability_histogram(t):
    return t.bt.groupBy(F.least(F.width_bucket(F.col("prob"), N(0.0), N(1.0), N(20)), N(20)).alias("bin")).agg(CNT().alias("n"))


@query("agg_sanity_checks", "n_rows i, bid_range i, ask_range i, bid_le_ask i, has_volume i", """
SELECT count(*) AS n_rows, count(*) FILTER (NOT bid BETWEEN 5 AND 100) AS bid_range, count(*) FILTER (NOT ask BETWEEN 0 AND 90) AS ask_range, count(*) FILTER (NOT bid <= ask) AS bid_le_ask, count(*) FILTER (NOT volume > 0) AS has_volume FROM v_quote""")
def agg_sanity_checks(t):
    return A.violations(t.quote, {"bid_range": F.col("bid").between(5, 100), "ask_range": F.col("ask").between(0, 90), "bid_le_ask": F.col("bid") <= F.col("ask"), "has_volume": F.col("volume") > 0})


@query("agg_value_counts", "pnl i, n i", "SELECT pnl, count(*) AS n FROM v_bt GROUP BY pnl ORDER BY n DESC, pnl LIMIT 15")
def agg_value_counts(t):
    return t.bt.groupBy("pnl").agg(CNT().alias("n")).orderBy(F.desc("n"), "pnl").limit(15)


@query("agg_column_health", "city s, n_rows i, n_days i, d0 d, d1 d, fill_raw f, mean_temp f, ok i", """
SELECT city, count(*) AS n_rows, count(DISTINCT day) AS n_days, min(day) AS d0, max(day) AS d1, count(raw_f) * 1.0e0 / count(*) AS fill_raw, avg(temp_f) AS mean_temp, (count(*) >= 60 * count(DISTINCT day) AND avg(temp_f) BETWEEN -50 AND 150)::INT AS ok FROM v_obs GROUP BY city""")
def agg_column_health(t):
    d = t.obs.groupBy("city", "day").agg(CNT().alias("n"), F.count("raw_f").alias("r"), F.sum("temp_f").alias("s"), F.count("temp_f").alias("c"))
    g = d.groupBy("city").agg(F.sum("n").alias("n_rows"), CNT().alias("n_days"), F.min("day").alias("d0"), F.max("day").alias("d1"), (F.sum("r") / F.sum("n")).alias("fill_raw"), (F.sum("s") / F.sum("c")).alias("mean_temp"))
    return g.withColumn("ok", (F.col("n_rows") >= 60 * F.col("n_days")) & F.col("mean_temp").between(-50, 150))
