"""Projections, filters, sets and splits."""

from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions.trades import valid_quote
from ..operators import splits as S
from .registry import query

N = F.lit


@query("filter_ranges", "city s, n_half_open i, n_inclusive i", """
SELECT city, count(*) FILTER (ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10') AS n_half_open,
  count(*) FILTER (day BETWEEN DATE '2024-01-05' AND DATE '2024-01-10') AS n_inclusive FROM v_obs GROUP BY city""")
def filter_ranges(t):
    o = t.obs.filter("ts >= TIMESTAMP_NTZ'2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ'2024-01-11 00:00:00'")
    return o.groupBy("city").agg(
        F.count_if(F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).alias("n_half_open"),
        F.count_if(F.col("day").between("2024-01-05", "2024-01-10")).alias("n_inclusive"))


@query("filter_asof_cutoff", "city s, day d, hour i, n_incl i, n_excl i, max_f f", """
SELECT s.city, s.day, s.hour, count(*) FILTER (o.us <= s.us) AS n_incl, count(*) FILTER (o.us < s.us) AS n_excl, max(temp_f) AS max_f
FROM v_snap s JOIN v_obs o ON o.city = s.city AND o.day = s.day AND o.us <= s.us GROUP BY ALL""")
def filter_asof_cutoff(t):
    """Rows at or before each cutoff, without joining rows to cutoffs: hourly
    partial aggregates are accumulated over the day's 24 buckets."""
    from ..operators.cumulative import so_far
    return so_far(t.obs, t.snap, {"n_incl": ("sum", N(1)), "n_excl": ("sum", N(1)), "max_f": ("max", F.col("temp_f"))},
                  exact={"n_excl": False})


@query("filter_valid_temp", "event_id i, raw_f f", """
SELECT event_id, raw_f FROM v_obs WHERE raw_f IS NOT NULL AND abs(raw_f + 77.9e0) >= 0.1e0 AND raw_f BETWEEN -50 AND 150""")
def filter_valid_temp(t):
    return t.obs.filter(Q.valid_temp("raw_f"))


@query("filter_valid_quote", "event_id i, bid i, ask i", "SELECT event_id, bid_n AS bid, ask FROM v_quote WHERE bid_n > 0 AND ask < 100 AND ask > bid_n")
def filter_valid_quote(t):
    return t.quote.select("event_id", F.col("bid_n").alias("bid"), "ask").filter(valid_quote("bid", "ask"))


@query("sample_every_nth", "city s, day d, hour i", """
SELECT city, day, hour FROM (SELECT *, dense_rank() OVER (PARTITION BY city, day ORDER BY hour) AS k FROM (SELECT DISTINCT city, day, hour FROM v_obs)) WHERE (k - 1) % 3 = 0""")
def sample_every_nth(t):
    from pyspark.sql import Window
    d = t.obs.select("city", "day", "hour").distinct()
    k = F.dense_rank().over(Window.partitionBy("city", "day").orderBy("hour"))
    return d.withColumn("k", k).filter("(k - 1) % 3 = 0")


@query("filter_edge_threshold", "ok i, ln i, pk i, sk i, edge f, pnl i", "SELECT ok, ln, pk, sk, edge, pnl FROM v_bt WHERE abs(edge) >= 10 AND pnl IS NOT NULL")
def filter_edge_threshold(t):
    return t.bt.filter((F.abs("edge") >= 10) & F.col("pnl").isNotNull())


@query("filter_quarter_hours", "event_id i, city s, day d, hour i, m i", """
SELECT event_id, city, day, hour, minute(ts) AS m FROM v_obs WHERE hour BETWEEN 10 AND 23 AND minute(ts) IN (0, 15, 30, 45)""")
def filter_quarter_hours(t):
    return t.obs.withColumn("m", F.minute("ts")).filter(F.col("hour").between(10, 23) & F.col("m").isin(0, 15, 30, 45))


@query("filter_last_n_days", "event_id i, day d", """
SELECT event_id, day FROM v_obs WHERE day IN (SELECT DISTINCT day FROM v_obs ORDER BY day DESC LIMIT 7)""")
def filter_last_n_days(t):
    return S.last_days(t.obs, "day", 7)


@query("filter_not_null_flagged", "city s, n i, sum_f f", """
SELECT city, count(*) AS n, sum(CAST(round(temp_f * 100) AS BIGINT)) / 100.0 AS sum_f FROM v_obs
WHERE NOT coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 9 = 0 END, false) AND NOT (event_id % 13 = 0) GROUP BY city""")
def filter_not_null_flagged(t):
    e = F.col("event_id")
    o = t.obs.withColumns({"ff": F.when(e % 5 == 0, None).otherwise(e % 9 == 0), "ex": e % 13 == 0})
    return o.filter(Q.unflagged("ff") & Q.unflagged("ex")).groupBy("city").agg(
        F.count(N(1)).alias("n"), (F.sum(F.round(F.col("temp_f") * 100).cast("long")) / 100).alias("sum_f"))


@query("project_first_existing", "mkt s, bucket_us u, price i", "SELECT mkt, bucket_us, coalesce(bid_n, ask) AS price FROM v_candle")
def project_first_existing(t):
    from ..sources.readers import first_existing, normalise_quotes
    c = normalise_quotes(t.candle.withColumnRenamed("bid_n", "yes_bid").withColumnRenamed("ask", "yes_ask"))
    return c.withColumn("price", F.coalesce(first_existing(c, "yes_bid_c", "yes_bid_close"), first_existing(c, "yes_ask_close")))


@query("temp_unit_normalise", "event_id i, v f, deg_f f", """
SELECT event_id, v, CASE WHEN v BETWEEN 200 AND 350 THEN round_even((v - 273.15e0) * 9 / 5 + 32, 2) WHEN v BETWEEN -50 AND 150 THEN round_even(v, 2) END AS deg_f
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN value + 260 WHEN 1 THEN value ELSE value + 400 END AS v FROM events)""")
def temp_unit_normalise(t):
    v = F.col("value") + F.when(F.col("event_id") % 3 == 0, 260).when(F.col("event_id") % 3 == 1, 0).otherwise(400)
    return t.events.withColumn("v", v).withColumn("deg_f", Q.fahrenheit("v"))


RANGES = [(-12, 12), (-10, 10), (-8, 8), (-6, 6), (-5, 5), (-4, 4), (-3, 3), (-2, 10), (-1, 1)]


@query("clip_label_range", "lo i, hi i, n i, sum_delta i, n_clipped i", """
SELECT lo, hi, count(*) AS n, sum(greatest(lo, least(hi, d))) AS sum_delta, count(*) FILTER (d < lo OR d > hi) AS n_clipped
FROM (SELECT CAST(round_even(edge, 0) AS BIGINT) AS d FROM v_bt),
 (VALUES (-12,12),(-10,10),(-8,8),(-6,6),(-5,5),(-4,4),(-3,3),(-2,10),(-1,1)) r(lo, hi) GROUP BY lo, hi""")
def clip_label_range(t):
    """Labels are counted first, so the sweep multiplies distinct labels, not rows."""
    d = t.bt.groupBy(F.bround("edge", 0).cast("long").alias("d")).agg(F.count(N(1)).alias("c"))
    r = F.explode(F.array(*[F.struct(N(a).alias("lo"), N(b).alias("hi")) for a, b in RANGES]))
    g = d.select("d", "c", r.alias("r")).select("d", "c", "r.*")
    inside = F.greatest("lo", F.least("hi", "d"))
    return g.groupBy("lo", "hi").agg(F.sum("c").alias("n"), F.sum(inside * F.col("c")).alias("sum_delta"),
                                     F.sum(F.when(inside != F.col("d"), F.col("c")).otherwise(0)).alias("n_clipped"))


@query("filter_lead_band", "city s, lead i, n_days i, d0 d, d1 d", """
SELECT city, lead_hours // 24 AS lead, count(DISTINCT day) AS n_days, min(day) AS d0, max(day) AS d1
FROM (SELECT *, lead * 24 + hour AS lead_hours FROM (SELECT f.city, f.day, f.lead, h.hour FROM v_fcst f JOIN v_fcst_hourly h USING (city, day))) WHERE lead_hours // 24 BETWEEN 1 AND 3 GROUP BY 1, 2""")
def filter_lead_band(t):
    h = t.fcst.select("city", "day", "lead").join(t.fcst_hourly.select("city", "day", "hour"), ["city", "day"])
    h = h.withColumn("lead_hours", F.col("lead") * 24 + F.col("hour"))
    band = h.filter((F.col("lead_hours") >= 24) & (F.col("lead_hours") < 96)).select(
        "city", "day", F.floor(F.col("lead_hours") / 24).alias("lead")).distinct()
    return band.groupBy("city", "lead").agg(F.count(N(1)).alias("n_days"), F.min("day").alias("d0"), F.max("day").alias("d1"))


# --- set operations and splits ---

@query("union_sources", "src s, city s, n i, n_dew i", """
SELECT 'obs' AS src, city, count(*) AS n, 0 AS n_dew FROM v_obs GROUP BY city
UNION ALL SELECT 'fcst', city, count(*), count(dew) FROM v_fcst_hourly GROUP BY city""")
def union_sources(t):
    u = t.obs.select("city", "temp_f").withColumn("src", N("obs")).unionByName(
        t.fcst_hourly.select("city", "temp_f", "dew").withColumn("src", N("fcst")), allowMissingColumns=True)
    return u.groupBy("src", "city").agg(F.count(N(1)).alias("n"), F.count("dew").alias("n_dew"))


@query("union_all_decisions", "city s, day d, kind s, hour_f f", """
WITH p AS (SELECT city, day, arg_max(hour, struct_pack(a := temp_f, b := -hour)) AS peak FROM v_fcst_hourly GROUP BY city, day)
SELECT city, day, 'midnight' AS kind, 0.0 AS hour_f FROM p UNION ALL SELECT city, day, 'pre_2h', greatest(peak - 2.0, 0) FROM p
UNION ALL SELECT city, day, 'pre_1h', greatest(peak - 1.0, 0) FROM p""")
def union_all_decisions(t):
    p = t.fcst_hourly.groupBy("city", "day").agg(
        F.max_by("hour", F.struct(F.col("temp_f"), -F.col("hour"))).cast("double").alias("peak"))
    k = F.array(F.struct(N("midnight").alias("kind"), N(0.0).alias("hour_f")),
                F.struct(N("pre_2h").alias("kind"), F.greatest(F.col("peak") - 2.0, N(0.0)).alias("hour_f")),
                F.struct(N("pre_1h").alias("kind"), F.greatest(F.col("peak") - 1.0, N(0.0)).alias("hour_f")))
    return p.select("city", "day", F.explode(k).alias("k")).select("city", "day", "k.*")


@query("distinct_combos", "city s, day d", "SELECT DISTINCT city, day FROM v_obs WHERE hour >= 10")
def distinct_combos(t):
    return t.obs.filter("hour >= 10").select("city", "day").distinct()


@query("set_union_dates", "day d", """
SELECT day FROM v_obs UNION SELECT day FROM v_run""")
def set_union_dates(t):
    return t.obs.select("day").union(t.run.select("day")).distinct()


@query("set_except", "city s, day d, lead i", """
SELECT DISTINCT city, day, l AS lead FROM v_settle, range(7) r(l) EXCEPT SELECT city, day, lead FROM v_fcst""")
def set_except(t):
    want = t.settle.select("city", "day", F.explode(F.sequence(N(0), N(6))).alias("lead"))
    return want.subtract(t.fcst.select("city", "day", "lead"))


@query("set_intersect_check", "n_overlap i, train_max d, test_min d, ordered i", """
WITH p AS (SELECT day, day < DATE '2024-01-21' AS tr FROM v_settle)
SELECT (SELECT count(*) FROM (SELECT day FROM p WHERE tr INTERSECT SELECT day FROM p WHERE NOT tr)) AS n_overlap,
 max(day) FILTER (tr) AS train_max, min(day) FILTER (NOT tr) AS test_min, (max(day) FILTER (tr) < min(day) FILTER (NOT tr))::INT AS ordered FROM p""")
def set_intersect_check(t):
    p = S.by_date(t.settle, "day", "2024-01-21")
    tr, te = p.filter("part = 'train'").select("day"), p.filter("part = 'test'").select("day")
    n = tr.intersect(te).agg(F.count(N(1)).alias("n_overlap"))
    m = p.agg(F.max(F.when(F.col("part") == "train", F.col("day"))).alias("train_max"),
              F.min(F.when(F.col("part") == "test", F.col("day"))).alias("test_min"))
    return m.withColumn("n_overlap", n.scalar()).withColumn("ordered", F.col("train_max") < F.col("test_min"))


@query("split_by_date", "part s, n i", "SELECT CASE WHEN day < DATE '2024-01-21' THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM v_obs GROUP BY 1")
def split_by_date(t):
    return S.by_date(t.obs, "day", "2024-01-21").groupBy("part").agg(F.count(N(1)).alias("n"))


@query("split_by_ratio", "part s, n i, d0 d, d1 d", """
WITH d AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS nd FROM (SELECT DISTINCT day FROM v_bt))
SELECT CASE WHEN k > nd - greatest(1, CAST(floor(nd * 0.2e0) AS BIGINT)) THEN 'test' ELSE 'train' END AS part, count(*) AS n, min(day) AS d0, max(day) AS d1
FROM v_bt JOIN d USING (day) GROUP BY 1""")
def split_by_ratio(t):
    return S.by_ratio(t.bt, "day", 0.2).groupBy("part").agg(F.count(N(1)).alias("n"), F.min("day").alias("d0"), F.max("day").alias("d1"))


@query("cv_day_folds", "fold i, part s, n_days i, d0 d, d1 d", """
WITH d AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM v_bt))
SELECT fold, CASE WHEN k <= n // 6 * fold - 2 THEN 'train' ELSE 'val' END AS part, count(*) AS n_days, min(day) AS d0, max(day) AS d1
FROM d, range(1, 6) r(fold) WHERE k <= n // 6 * fold - 2 OR (k > n // 6 * fold AND k <= n // 6 * (fold + 1)) GROUP BY 1, 2""")
def cv_day_folds(t):
    return S.expanding_folds(t.bt, "day", 5, gap=2).groupBy("fold", "part").agg(
        F.count(N(1)).alias("n_days"), F.min("day").alias("d0"), F.max("day").alias("d1"))
