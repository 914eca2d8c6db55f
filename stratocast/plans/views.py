"""SQL views over the domain tables."""

from copy import copy

from pyspark.sql import functions as F

from ..functions.timeutil import HOUR, MINUTE, epoch_us
from ..operators.asof import asof
from ..operators.chunked import prefix_scan, time_chunk
from ..session import written

MIDNIGHT = """
WITH path AS (
  SELECT city, basis AS day, max(CASE WHEN lead = 0 THEN tempmax_f END) AS t0,
         max(CASE WHEN lead = 1 THEN tempmax_f END) AS t1, max(CASE WHEN lead = 2 THEN tempmax_f END) AS t2
  FROM {fcst} WHERE lead <= 2 GROUP BY city, basis
), peak AS (
  SELECT city, day, max_by(hour, struct(temp_f, -hour)) AS hour, max(temp_f) AS temp_f FROM {curve} GROUP BY city, day
), actual AS (
  SELECT city, day, max_by(hour + minute(ts) / 60.0D, struct(temp_f, -us)) AS hour FROM {obs} GROUP BY city, day
)
SELECT p.city, p.day, p.t0, p.t1, p.t2, (coalesce(p.t2, p.t1, p.t0) - p.t0) / 2 AS trend_3d,
       p.t1 - p.t0 AS d1, p.t2 - p.t0 AS d2, k.hour AS peak_hour, k.temp_f AS peak_f,
       0.2D * coalesce(y.hour, k.hour) + 0.7D * k.hour + 0.1D * coalesce(n.hour, k.hour) AS weighted_hour,
       s.settle_f, a.hour AS actual_hour, s.settle_f - p.t0 AS delta_midnight
FROM path p
LEFT JOIN peak k ON k.city = p.city AND k.day = p.day
LEFT JOIN actual y ON y.city = p.city AND y.day = date_sub(p.day, 1)
LEFT JOIN peak n ON n.city = p.city AND n.day = date_add(p.day, 1)
LEFT JOIN actual a ON a.city = p.city AND a.day = p.day
LEFT JOIN {settle} s ON s.city = p.city AND s.day = p.day
WHERE p.t0 IS NOT NULL
"""


def midnight_path(t):
    """Three-day path, predicted, weighted and actual peak hours and the label, per (city, day)."""
    return t.spark.sql(MIDNIGHT, fcst=t.fcst, curve=t.fcst_hourly, obs=t.obs, settle=t.settle)


def decision_points(t, window_min=60):
    """Three decision rows per event with forecast, observation and maximum at that time."""
    t = copy(t)  # the caller's tables stay as they are
    t.settle = written(t.settle, "settle")  # it feeds nearly every other table
    b = midnight_path(t).select("city", "day", "t0", "weighted_hour", "settle_f")
    at = lambda h, name: F.struct(F.lit(name).alias("kind"), h.alias("hour_f"))
    w = F.col("weighted_hour")
    kinds = F.array(at(F.lit(0.0), "midnight"), at(F.greatest(w - 2.0, F.lit(0.0)), "pre_high_2h"), at(F.greatest(w - 1.0, F.lit(0.0)), "pre_high_1h"))
    d = b.select("city", "day", "t0", "weighted_hour", "settle_f", F.explode(kinds).alias("k")).select("city", "day", "t0", "weighted_hour", "settle_f", "k.*")
    d = d.filter((F.col("kind") == "midnight") | F.col("weighted_hour").isNotNull())
    d = d.withColumn("dec_us", epoch_us(F.col("day").cast("timestamp_ntz")) + F.floor(F.col("hour_f") * 60).cast("long") * MINUTE)
    h = t.fcst_hourly.select("city", "day", F.col("hour").alias("_h"), F.col("temp_f").alias("fcst_at"))
    d = d.withColumn("_h", F.floor("hour_f")).join(h, ["city", "day", "_h"], "left").drop("_h")
    half = window_min * MINUTE
    d = d.withColumn("_lo", F.col("dec_us") - half)
    d = asof(d, t.obs, ["city"], "_lo", "us", {"obs_at": "temp_f"}, direction="forward", tolerance=2 * half - 1, matched="_m").drop("_m", "_lo")
    top = prefix_scan(t.obs.select("city", "day", "us", "temp_f"), ["city", "day"], ["us"], time_chunk("us", 6 * HOUR), {"mx": ("max", "temp_f")})
    d = asof(d, top, ["city", "day"], "dec_us", "us", {"max_so_far": "mx"}, matched="_m").drop("_m")
    win = t.market.filter("result = 'yes'").groupBy("city", "day").agg(F.min("ticker").alias("win_ticker"))
    return d.join(win, ["city", "day"], "left")
