"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from ..functions.strikes import event_key
from ..functions.timeutil import HOUR, epoch_us
from ..session import scratch
from ..sources import json_rows as J
from ..sources import sinks, upsert
from .registry import query


@query("scan_parquet_lake", "src s, city s, n i, d0 d, d1 d", """
SELECT 'obs' AS src, city, count(*) AS n, min(day) AS d0, max(day) AS d1 FROM v_obs GROUP BY city
UNION ALL SELECT 'city_obs', city, count(*), min(day), max(day) FROM v_obs2 GROUP BY city
UNION ALL SELECT 'settle', city, count(*), min(day), max(day) FROM v_settle GROUP BY city
UNION ALL SELECT 'fcst', city, count(*), min(day), max(day) FROM v_fcst GROUP BY city
UNION ALL SELECT 'fcst_hourly', city, count(*), min(day), max(day) FROM v_fcst_hourly GROUP BY city
UNION ALL SELECT 'guidance', city, count(*), min(day), max(day) FROM v_run GROUP BY city
UNION ALL SELECT 'candle', city, count(*), min(day), max(day) FROM v_candle GROUP BY city""")
def scan_parquet_lake(t):
    parts = {"obs": t.obs, "city_obs": t.obs2, "settle": t.settle, "fcst": t.fcst,
             "fcst_hourly": t.fcst_hourly, "guidance": t.run, "candle": t.candle}
    out = None
    for name, df in parts.items():
        g = df.groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("d0"), F.max("day").alias("d1"))
        g = g.withColumn("src", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return out


@query("scan_obs", "city s, ts t, temp_f f, humidity f, wind f, cloud f, event_id i", """
SELECT city, ts, temp_f, humidity, wind, cloud, event_id FROM v_obs
WHERE city = 'click' AND day >= DATE '2024-01-05' AND day < DATE '2024-01-12'""")
def scan_obs(t):
    return t.obs.filter("city = 'click' AND ts >= TIMESTAMP_NTZ'2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ'2024-01-12 00:00:00'")


@query("scan_city_obs", "city s, ts t, temp_f f, event_id i", """
SELECT city, ts, temp_f, event_id FROM v_obs2 WHERE city = 'view' AND day >= DATE '2024-01-05' AND day < DATE '2024-01-12'""")
def scan_city_obs(t):
    return t.obs2.filter("city = 'view' AND ts >= TIMESTAMP_NTZ'2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ'2024-01-12 00:00:00'")


@query("scan_settlements", "city s, day d, settle_f i", """
SELECT city, day, settle_f FROM v_settle WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'
AND city IN ('click','error','view') AND settle_f IS NOT NULL""")
def scan_settlements(t):
    d = F.col("day")
    return t.settle.filter(d.between("2024-01-03", "2024-01-20") & F.col("city").isin("click", "error", "view")
                           & F.col("settle_f").isNotNull())


@query("scan_forecast_hourly", "city s, basis d, day d, hour i, temp_f f, cloud f", """
SELECT city, day - 1 AS basis, day, hour, temp_f, cloud FROM v_fcst_hourly WHERE day - 1 = DATE '2024-01-09' AND hour BETWEEN 0 AND 23""")
def scan_forecast_hourly(t):
    return t.fcst_hourly.withColumn("basis", F.date_sub("day", 1)).filter("basis = DATE'2024-01-09' AND hour BETWEEN 0 AND 23")


@query("scan_forecast_minutes", "city s, us u, temp_f f, event_id i", """
SELECT city, us, temp_f, event_id FROM (
SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 9 = 0 END AS ff FROM v_obs) WHERE NOT coalesce(ff, false)""")
def scan_forecast_minutes(t):
    e = F.col("event_id")
    filled = F.when(e % 5 == 0, None).otherwise(e % 9 == 0)
    return t.obs.filter(~F.coalesce(filled, F.lit(False)))


@query("scan_candles", "ticker s, bucket_us u, bid i, ask i, volume i", """
SELECT m.ticker, c.bucket_us, c.bid, c.ask, c.volume FROM v_candle c JOIN v_market m USING (mkt)
WHERE (m.ticker LIKE 'HIGHCLI-24JAN0%' OR m.ticker LIKE 'HIGHVIE-24JAN1%')
AND c.bucket_us >= m.listed_us AND c.bucket_us < m.close_us""")
def scan_candles(t):
    """LIKE batches become an equi join on the parsed event key."""
    m = t.market.select("mkt", "ticker", "listed_us", "close_us", event_key("ticker").alias("ek"))
    m = m.filter(F.col("ek").startswith("HIGHCLI-24JAN0") | F.col("ek").startswith("HIGHVIE-24JAN1"))
    return t.candle.join(m, "mkt").filter("bucket_us >= listed_us AND bucket_us < close_us")


@query("scan_markets", "city s, day d, ticker s, strike_type s, floor_s f, cap_s f, pos i", """
SELECT *, row_number() OVER (PARTITION BY city, day ORDER BY floor_s NULLS FIRST) AS pos FROM v_market""")
def scan_markets(t):
    from ..operators.brackets import neighbours
    return neighbours(t.market, ["city", "day"]).withColumn("pos", F.col("idx") + 1)


def _timeline_text(t):
    e = F.col("event_id")
    s = F.floor(epoch_us("ts") / 1_000_000)
    minute = lambda i: F.struct((s + 60 * i).alias("datetimeEpoch"), (F.col("value") + i).alias("temp"),
                                (F.col("user_id") % 101).cast("double").alias("humidity"),
                                F.array(F.lit("rain"), F.lit("snow")).alias("preciptype"))
    minutes = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: minute(i))
    hour = F.struct(s.alias("datetimeEpoch"), F.col("value").alias("temp"),
                    F.slice(minutes, F.lit(1), (e % 3).cast("int")).alias("minutes"))
    day = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("datetime"), F.array(hour).alias("hours"))
    return t.events.select("event_id", F.to_json(F.struct(F.array(day).alias("days"))).alias("body"))


@query("json_timeline_flatten", "event_id i, day s, epoch i, temp_f f, humidity f, preciptype s, local_ts t, from_hour i", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) // 1000000 + 60 * i AS epoch, value + i AS temp_f,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id % 101 END AS humidity,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE 'rain,snow' END AS preciptype,
  make_timestamp((epoch_us(ts) // 1000000 + 60 * i) * 1000000) - INTERVAL 6 HOUR AS local_ts, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS from_hour
FROM events, range(2) r(i) WHERE i < greatest(event_id % 3, 1)""")
def json_timeline_flatten(t):
    return J.timeline_minutes(_timeline_text(t), "body", ["event_id"], zone="America/Chicago")


@query("json_forecast_rows", "o_orderkey i, basis d, target d, lead_days i, tempmax_f f, temp_f f, lead_hours i", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS basis, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 AS INTEGER) AS target,
  o_orderkey % 6 AS lead_days, o_totalprice / 1000 AS tempmax_f, o_totalprice / 1000 - h AS temp_f, (o_orderkey % 6) * 24 + h AS lead_hours
FROM orders, range(3) r(h)""")
def json_forecast_rows(t):
    lead = (F.col("o_orderkey") % 6).cast("int")
    day = F.to_date("o_orderdate")
    target = F.date_add(day, lead)
    e0 = F.floor(epoch_us(target.cast("timestamp_ntz")) / 1_000_000)
    top = F.col("o_totalprice") / 1000
    hours = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda h: F.struct(
        (e0 + h * 3600 + 59).alias("datetimeEpoch"), (top - h).alias("temp")))
    body = F.to_json(F.struct(F.date_format(day, "yyyy-MM-dd").alias("basis"), F.array(F.struct(
        F.date_format(target, "yyyy-MM-dd").alias("datetime"), top.alias("tempmax"), hours.alias("hours"))).alias("days")))
    return J.forecast_rows(t.orders.select("o_orderkey", body.alias("body")), "body", ["o_orderkey"])


def _candle_text(t):
    e = F.col("event_id")
    side = lambda c: F.struct(F.col(c).alias("open"), (F.col(c) + 2).alias("high"), (F.col(c) - 1).alias("low"),
                              (F.col(c) + 1).alias("close"))
    return t.quote.select("event_id", F.to_json(F.struct(
        F.floor(F.col("us") / 1_000_000).alias("end_period_ts"), F.col("volume"),
        F.when(e % 3 == 0, None).otherwise(F.col("bid") / 100).alias("price"),
        F.when(e % 2 == 0, F.col("bid") + 5).alias("yes_bid_close"), side("bid").alias("yes_bid"),
        side("ask").alias("yes_ask"))).alias("body"))


@query("candle_json_normalise", "event_id i, yes_bid_open i, yes_bid_close i, yes_ask_open i, yes_ask_close i, price_c i, end_ts i", """
SELECT event_id, bid AS yes_bid_open, CASE WHEN event_id % 2 = 0 THEN bid + 5 ELSE bid + 1 END AS yes_bid_close,
  ask AS yes_ask_open, ask + 1 AS yes_ask_close, CASE WHEN event_id % 3 = 0 THEN NULL ELSE bid END AS price_c, us // 1000000 AS end_ts
FROM v_quote""")
def candle_json_normalise(t):
    return J.candle_prices(_candle_text(t), "body", ["event_id"])


@query("candle_row_map", "event_id i, bucket_s i, open_c i, close_c i, volume i", """
SELECT event_id, us // 1000000 - 60 AS bucket_s, CASE WHEN event_id % 3 = 0 THEN ask ELSE bid END AS open_c,
  CASE WHEN event_id % 3 = 0 THEN ask + 1 ELSE bid END AS close_c, volume FROM v_quote""")
def candle_row_map(t):
    return J.candle_row(J.candle_prices(_candle_text(t), "body", ["event_id"]))


@query("settlement_source_parse", "event_id i, raw s, val f, val_i i", """
WITH r AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'M' WHEN 1 THEN 'T' WHEN 2 THEN '' WHEN 3 THEN 'm' WHEN 4 THEN 'x?' ELSE CAST(value AS VARCHAR) END AS raw, value FROM events),
v AS (SELECT *, CASE WHEN event_id % 9 IN (0, 2, 3, 4) THEN NULL WHEN event_id % 9 = 1 THEN 0.001 ELSE value END::DOUBLE AS val FROM r)
SELECT event_id, raw, val, CAST(round_even(val, 0) AS BIGINT) AS val_i FROM v""")
def settlement_source_parse(t):
    e = F.col("event_id") % 9
    raw = (F.when(e == 0, "M").when(e == 1, "T").when(e == 2, "").when(e == 3, "m").when(e == 4, "x?")
           .otherwise(F.col("value").cast("string")))
    r = t.events.select("event_id", raw.alias("raw"))
    return r.withColumn("val", J.daily_value("raw")).withColumn("val_i", F.bround("val", 0))


@query("read_param_grid", "event_id i, alpha i, bias f, bet f", """
SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS alpha, 0.0 AS bias, CASE WHEN CAST(props->>'$.k' AS BIGINT) > 50 THEN 200.0 ELSE 50.0 END AS bet FROM events""")
def read_param_grid(t):
    """Tuned parameters with per-field defaults for absent fields."""
    p = t.events.select("event_id", F.from_json("props", "k bigint, bias double, bet double").alias("p"))
    return p.select("event_id", F.coalesce("p.k", F.lit(0)).alias("alpha"), F.coalesce("p.bias", F.lit(0.0)).alias("bias"),
                    F.coalesce(F.col("p.bet"), F.when(F.col("p.k") > 50, 200.0).otherwise(50.0)).alias("bet"))


@query("sink_parquet_train_test", "split s, city s, n i, settle_sum i", """
SELECT CASE WHEN day < DATE '2024-01-21' THEN 'train' ELSE 'test' END AS split, city, count(*) AS n, sum(settle_f) AS settle_sum
FROM v_settle GROUP BY 1, 2""")
def sink_parquet_train_test(t):
    path = sinks.write_split(t.settle, scratch(t.spark, "split"), "day", "2024-01-21")
    return t.spark.read.parquet(path).groupBy("split", "city").agg(
        F.count(F.lit(1)).alias("n"), F.sum("settle_f").alias("settle_sum"))


@query("sink_csv_reports", "city s, day d, settle_f i, base_f i", """
SELECT city, day, settle_f, CAST(floor(vc_max_f) AS BIGINT) AS base_f FROM v_settle WHERE settle_f <> floor(vc_max_f)""")
def sink_csv_reports(t):
    rep = t.settle.withColumn("base_f", F.floor("vc_max_f")).filter("settle_f <> base_f").select("city", "day", "settle_f", "base_f")
    return t.spark.read.csv(sinks.write_csv(rep, scratch(t.spark, "csv")), header=True,
                            schema="city string, day date, settle_f bigint, base_f bigint")


@query("upsert_latest", "user_id i, event_type s, value f, event_id i", """
SELECT user_id, event_type, value, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def upsert_latest(t):
    e = t.events.select("user_id", "event_type", "value", "event_id", "ts")
    return upsert.upsert_latest(e.filter("ts < TIMESTAMP_NTZ'2024-01-16 00:00:00'"),
                                e.filter("ts >= TIMESTAMP_NTZ'2024-01-16 00:00:00'"), ["user_id", "event_type"], "ts", "event_id")


@query("upsert_precedence", "city s, day d, val i, src s", """
WITH o AS (SELECT city, day, settle_f AS val, CASE WHEN di % 3 = 0 THEN 'cli' ELSE 'cf6' END AS src FROM v_settle WHERE di < 20),
n AS (SELECT city, day, settle_f + 1 AS val, CASE WHEN di % 4 = 0 THEN 'cli' ELSE 'cf6' END AS src FROM v_settle WHERE di >= 10)
SELECT coalesce(o.city, n.city) AS city, coalesce(o.day, n.day) AS day,
  CASE WHEN n.src IS NULL OR (o.src = 'cli' AND n.src <> 'cli') THEN o.val ELSE n.val END AS val,
  CASE WHEN n.src IS NULL OR (o.src = 'cli' AND n.src <> 'cli') THEN o.src ELSE n.src END AS src
FROM o FULL JOIN n ON o.city = n.city AND o.day = n.day""")
def upsert_precedence(t):
    src = lambda k: F.when(F.col("di") % k == 0, "cli").otherwise("cf6").alias("src")
    old = t.settle.filter("di < 20").select("city", "day", F.col("settle_f").alias("val"), src(3))
    new = t.settle.filter("di >= 10").select("city", "day", (F.col("settle_f") + 1).alias("val"), src(4))
    return upsert.upsert_precedence(old, new, ["city", "day"], "val", "src")


@query("append_if_absent", "o_orderkey i, o_totalprice f, batch s", """
SELECT o_orderkey, o_totalprice, 'old' AS batch FROM orders WHERE o_orderstatus <> 'O'
UNION ALL SELECT o_orderkey, o_totalprice, 'new' FROM orders n WHERE o_orderpriority <> '1-URGENT'
AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus <> 'O' AND o.o_orderkey = n.o_orderkey)""")
def append_if_absent(t):
    o = t.orders
    old = o.filter("o_orderstatus <> 'O'").select("o_orderkey", "o_totalprice", F.lit("old").alias("batch"))
    new = o.filter("o_orderpriority <> '1-URGENT'").select("o_orderkey", "o_totalprice", F.lit("new").alias("batch"))
    return upsert.append_if_absent(old, new, ["o_orderkey"])


@query("incremental_append", "city s, day d, settle_f i, gen s", """
SELECT city, day, settle_f, CASE WHEN day <= DATE '2024-01-15' THEN 'old' ELSE 'new' END AS gen FROM v_settle""")
def incremental_append(t):
    s = t.settle.select("city", "day", "settle_f")
    return upsert.incremental_append(s.filter("day <= DATE'2024-01-15'").withColumn("gen", F.lit("old")),
                                     s.withColumn("gen", F.lit("new")), "day")


@query("replace_range", "mkt s, bucket_us u, bid i, gen s", """
WITH nw AS (SELECT mkt, bucket_us, bid + 1 AS bid, 'new' AS gen FROM v_candle WHERE hour(make_timestamp(bucket_us)) BETWEEN 8 AND 15),
sp AS (SELECT mkt, min(bucket_us) AS lo, max(bucket_us) AS hi FROM nw GROUP BY mkt)
SELECT c.mkt, c.bucket_us, c.bid, 'old' AS gen FROM v_candle c LEFT JOIN sp USING (mkt) WHERE lo IS NULL OR bucket_us < lo OR bucket_us > hi
UNION ALL SELECT mkt, bucket_us, bid, gen FROM nw""")
def replace_range(t):
    c = t.candle.select("mkt", "bucket_us", "bid", F.lit("old").alias("gen"))
    hour = F.floor(F.pmod(F.col("bucket_us"), F.lit(24 * HOUR)) / HOUR)
    new = c.filter(hour.between(8, 15)).withColumns({"bid": F.col("bid") + 1, "gen": F.lit("new")})
    return upsert.replace_range(c, new, ["mkt"], "bucket_us")


# Zone names by region key.
ZONES = ["America/Chicago", "America/Denver", "America/Los_Angeles", "America/New_York", "UTC"]


@query("dim_city", "n_nationkey i, city s, region s, zone s, prefix s, n_cust i", """
SELECT n_nationkey, n_name AS city, r_name AS region,
  ['America/Chicago','America/Denver','America/Los_Angeles','America/New_York','UTC'][r_regionkey + 1] AS zone,
  'HIGH' || upper(substr(n_name, 1, 3)) || n_nationkey AS prefix, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS n_cust
FROM nation n JOIN region ON n_regionkey = r_regionkey""")
def dim_city(t):
    zone = F.array(*[F.lit(z) for z in ZONES])[F.col("r_regionkey")]
    n_cust = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_cust"))
    d = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    d = d.join(n_cust, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return d.select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("region"), zone.alias("zone"),
                    F.concat(F.lit("HIGH"), F.upper(F.substring("n_name", 1, 3)), F.col("n_nationkey").cast("string")).alias("prefix"),
                    F.coalesce("n_cust", F.lit(0)).alias("n_cust"))
