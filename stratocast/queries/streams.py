"""Streaming operators (R1-R15), each drained to completion and compared with batch SQL."""

from pyspark.sql import functions as F

from ..operators import edge as E
from ..sources import json_rows as J
from ..session import scratch
from ..streaming import runner as R
from ..streaming import sources as SRC
from ..streaming import state as ST
from .registry import query
from .scalars import PHI_SQL
from .strategies import PICK, base

N = F.lit


def events(t):
    """The event table as five micro-batches in the order of event time."""
    return SRC.replayed_events(t.spark, t.events)


@query("stream_raw_ingest", "id i, stream s, topic s, bad i", """
SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN 'raw_error' WHEN event_id % 3 = 0 THEN 'ticker' WHEN event_id % 3 = 1 THEN 'trade' ELSE 'unknown' END AS stream,
 CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_type || '-' || user_id END AS topic, (event_id % 50 = 0)::INT AS bad FROM events""")
def stream_raw_ingest(t):
    """Raw text lines; an undecodable line is kept as raw_error."""
    e = F.col("event_id")
    good = F.to_json(F.struct(e.alias("id"), F.when(e % 3 == 0, "ticker").alias("channel"), F.when(e % 3 == 1, "trade").alias("type"),
                              F.struct(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("market_ticker")).alias("msg")))
    src = scratch(t.spark, "raw")
    t.events.select(F.when(e % 50 == 0, F.concat(N('{"id":'), e.cast("string"), N(',"oops'))).otherwise(good).alias("value")).write.text(src)
    raw = t.spark.readStream.option("maxFilesPerTrigger", 100).text(src).withColumn("arrived", F.current_timestamp())
    bad = F.get_json_object("value", "$").isNull()
    m = J.message_meta("value")
    out = raw.select(F.regexp_extract("value", r'"id":(\d+)', 1).cast("bigint").alias("id"), F.when(bad, "raw_error").otherwise(m["stream"]).alias("stream"),
                     F.when(~bad, m["topic"]).alias("topic"), bad.cast("int").alias("bad"), "arrived", F.col("value").alias("payload"))
    return R.run_to_parquet(t.spark, out, "raw_ingest")


_SQ = """SELECT event_type AS city, CAST(ts AS DATE) AS day, event_type || '|' || strftime(ts, '%Y%m%d') || '|' || (user_id % 6) AS mkt, epoch_us(ts) AS us, event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 1 + event_id % 90 END AS bid,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE 2 + event_id % 90 + event_id % 7 END AS ask, user_id % 5 AS volume FROM events"""
_ST = f"""SELECT mkt, arg_max(bid, us) FILTER (bid IS NOT NULL) AS bid, arg_max(ask, us) FILTER (ask IS NOT NULL) AS ask, arg_max(volume, us) AS volume, max(us) AS last_us, count(*) AS n_msgs FROM ({_SQ}) GROUP BY mkt"""


@query("stream_quote_state", "mkt s, bid i, ask i, volume i, n_msgs i, n_hist i, sum_bid f", f"""
SELECT s.*, h.n_hist, h.sum_bid FROM ({_ST}) s LEFT JOIN (SELECT mkt, count(*) AS n_hist, sum(bid) AS sum_bid FROM (SELECT * FROM ({_SQ}) WHERE bid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mkt ORDER BY us DESC, event_id DESC) <= 100) GROUP BY mkt) h USING (mkt)""")
def stream_quote_state(t):
    q = SRC.quotes(events(t))
    s = R.run_updates(t.spark, ST.latest_known(q, ["mkt"], ["bid", "ask", "volume"], ["us", "event_id"], "1 day"), ["mkt"], "quote_state")
    R.use_rocksdb(t.spark)
    h = R.run_to_parquet(t.spark, ST.price_history(q, "mkt"), "quote_history")
    h = h.groupBy("mkt").agg(F.max_by(F.struct("n_hist", "sum_bid"), F.struct("newest_us", "n_hist")).alias("h")).select("mkt", "h.*")
    return s.join(h, "mkt", "left")


@query("stream_book_top", "event_id i, best_bid i, best_ask i, spread i", """
SELECT event_id, 1 + event_id % 90 AS best_bid, 2 + event_id % 90 + event_id % 7 AS best_ask, 1 + event_id % 7 AS spread FROM events WHERE event_id % 4 > 0 AND event_id % 5 > 0""")
def stream_book_top(t):
    """Best prices of depth messages; updates with an empty side are skipped."""
    e = F.col("event_id")
    side = lambda top, n, step: F.transform(F.slice(F.sequence(N(0), N(4)), N(1), n.cast("int")), lambda i: F.array(top + step * i, 10 + i))
    msg = F.to_json(F.struct(F.struct(F.struct(side(1 + e % 90, e % 4, -1).alias("bid"), side(2 + e % 90 + e % 7, e % 5, 1).alias("ask")).alias("yes")).alias("msg")))
    s = events(t).select("event_id", F.from_json(msg, "msg struct<yes:struct<bid:array<array<bigint>>,ask:array<array<bigint>>>>").alias("j"))
    b, a = F.col("j.msg.yes.bid"), F.col("j.msg.yes.ask")
    s = s.filter((F.size(b) > 0) & (F.size(a) > 0)).select("event_id", F.array_max(F.transform(b, lambda x: x[0])).alias("best_bid"), F.array_min(F.transform(a, lambda x: x[0])).alias("best_ask"))
    return R.run_to_parquet(t.spark, s.withColumn("spread", F.col("best_ask") - F.col("best_bid")), "book_top")


@query("stream_lifecycle_state", "market i, status s, open_us u, close_us u, title i, is_open i", """
WITH m AS (SELECT user_id AS market, epoch_us(ts) AS us, event_id, CASE event_type WHEN 'click' THEN 'created' WHEN 'view' THEN 'open' WHEN 'purchase' THEN 'closed' WHEN 'signup' THEN 'settled' END AS st, CASE WHEN event_type = 'error' THEN event_id END AS title FROM events)
SELECT market, arg_max(st, us) FILTER (st IS NOT NULL) AS status, min(us) FILTER (st = 'open') AS open_us, max(us) FILTER (st = 'closed') AS close_us, arg_max(title, us) FILTER (title IS NOT NULL) AS title, (arg_max(st, us) FILTER (st IS NOT NULL) = 'open')::INT AS is_open FROM m GROUP BY market""")
def stream_lifecycle_state(t):
    """Market status by event time; metadata is merged field by field."""
    st = F.create_map(N("click"), N("created"), N("view"), N("open"), N("purchase"), N("closed"), N("signup"), N("settled"))[F.col("event_type")]
    m = events(t).select(F.col("user_id").alias("market"), "us", "event_id", st.alias("st"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("title"))
    pos = F.struct("us", "event_id")
    s = m.groupBy("market").agg(F.max_by("st", F.when(F.col("st").isNotNull(), pos)).alias("status"), F.min(F.when(F.col("st") == "open", F.col("us"))).alias("open_us"),
                                F.max(F.when(F.col("st") == "closed", F.col("us"))).alias("close_us"), F.max_by("title", F.when(F.col("title").isNotNull(), pos)).alias("title"))
    return R.run_updates(t.spark, s, ["market"], "lifecycle").withColumn("is_open", (F.col("status") == "open").cast("int"))


@query("stream_first_seen", "mkt s, first_us u, first_id i", f"SELECT mkt, min(us) AS first_us, arg_min(event_id, us) AS first_id FROM ({_SQ}) GROUP BY mkt")
def stream_first_seen(t):
    """First open event of each market, once, however late duplicates arrive."""
    s = ST.per_event_day(SRC.quotes(events(t)), ["mkt"]).agg(F.min("us").alias("first_us"), F.min_by("event_id", F.struct("us", "event_id")).alias("first_id"))
    s = s.select("mkt", "first_us", "first_id")
    return R.run_updates(t.spark, s, ["mkt"], "first_seen")


@query("stream_rolling_volume", "mkt s, end_us u, contracts i", f"""
WITH w AS (SELECT mkt, date_trunc('minute', ts) + INTERVAL 1 MINUTE * (k + 1) AS end_ts, cnt FROM v_trade, range(0, 30) r(k)) SELECT mkt, epoch_us(end_ts) AS end_us, sum(cnt) AS contracts FROM w GROUP BY mkt, end_ts""")
def stream_rolling_volume(t):
    """Contracts of the last 30 minutes on a sliding window; late trades within 10 minutes count."""
    s = SRC.trades(events(t)).withWatermark("ets", "10 minutes").groupBy(F.window("ets", "30 minutes", "1 minute").alias("w"), "mkt").agg(F.sum("cnt").alias("contracts"))
    return R.run_updates(t.spark, s.select("mkt", F.unix_micros("w.end").alias("end_us"), "contracts"), ["mkt", "end_us"], "rolling_volume")


@query("stream_minute_candles", "mkt s, minute u, o i, h i, l i, c i, v i, n i", f"""
SELECT mkt, epoch_us(date_trunc('minute', ts)) AS minute, arg_min(price, us) AS o, max(price) AS h, min(price) AS l, arg_max(price, us) AS c, sum(cnt) AS v, count(*) AS n FROM v_trade GROUP BY mkt, date_trunc('minute', ts)""")
def stream_minute_candles(t):
    pos = F.struct("us", "seq")
    s = SRC.trades(events(t)).withWatermark("ets", "10 minutes").groupBy(F.window("ets", "1 minute").alias("w"), "mkt").agg(
        F.min_by("price", pos).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", pos).alias("c"), F.sum("cnt").alias("v"), F.count(N(1)).alias("n"))
    return R.run_updates(t.spark, s.select("mkt", F.unix_micros("w.start").alias("minute"), "o", "h", "l", "c", "v", "n"), ["mkt", "minute"], "minute_candles")


@query("stream_dense_fill", "mkt s, n i, n_synth i, bid_sum i, last_us u", f"""
WITH b AS (SELECT mkt, us - us % 60000000 AS bucket_us, arg_max(bid, us) FILTER (bid IS NOT NULL) AS bid, epoch_us(any_value(day)::TIMESTAMP) + 79200000000 AS close_us FROM ({_SQ}) GROUP BY 1, 2), nw AS (SELECT max(bucket_us) AS nw FROM b),
g AS (SELECT mkt, unnest(range(lo, least(nw, cl) + 1, 60000000)) AS bucket_us FROM (SELECT mkt, min(bucket_us) AS lo, max(close_us) AS cl FROM b GROUP BY mkt), nw),
d AS (SELECT g.mkt, g.bucket_us, b.mkt IS NULL AS syn, last_value(bid IGNORE NULLS) OVER (PARTITION BY g.mkt ORDER BY g.bucket_us) AS bid FROM g LEFT JOIN b USING (mkt, bucket_us))
SELECT mkt, count(*) AS n, count(*) FILTER (syn) AS n_synth, sum(bid) AS bid_sum, max(bucket_us) AS last_us FROM d GROUP BY mkt""")
def stream_dense_fill(t):
    """Each cycle extends every open market to the newest minute with its last prices."""
    q = SRC.quotes(events(t))

    def cycle(df, i, root):
        bars = df.groupBy("mkt", SRC.minute_of("us").alias("bucket_us")).agg(
            F.max_by("bid", F.when(F.col("bid").isNotNull(), F.struct("us", "event_id"))).alias("bid"),
            (F.datediff(F.max("day"), N("1970-01-01").cast("date")).cast("long") * 86_400_000_000 + 79_200_000_000).alias("close_us"))
        ST.extend_dense(df.sparkSession, bars, i, root, "mkt", ["bid"], "close_us")

    root = R.run_batches(t.spark, q, cycle, "dense_fill")
    return t.spark.read.parquet(f"{root}/dense").groupBy("mkt").agg(F.count(N(1)).alias("n"), F.sum("is_synthetic").alias("n_synth"), F.sum("bid").alias("bid_sum"), F.max("bucket_us").alias("last_us"))


@query("stream_late_upsert", "city s, slot u, temp_f f, event_id i", """
SELECT city, us - us % 3600000000 AS slot, arg_max(raw_f, us) AS temp_f, arg_max(event_id, us) AS event_id FROM v_obs WHERE raw_f IS NOT NULL GROUP BY 1, 2""")
def stream_late_upsert(t):
    """Re-polled rows overwrite by (city, hour slot); only the touched days are rewritten."""
    e = F.col("event_id")
    raw = F.when(e % 17 == 0, None).when(e % 29 == 0, -77.9).when(e % 31 == 0, 151.0).otherwise(F.col("value"))
    s = events(t).select(F.col("event_type").alias("city"), F.to_date("ts").alias("day"), (F.col("us") - F.pmod(F.col("us"), N(3_600_000_000))).alias("slot"), "us", "event_id", raw.alias("temp_f")).filter("temp_f IS NOT NULL")
    root = R.run_batches(t.spark, s, lambda df, i, root: ST.merge_days(df.sparkSession, df, i, root, ["city", "slot", "day"], "us", "day"), "late_upsert")
    return t.spark.read.schema(s.schema).parquet(f"{root}/table")


@query("stream_static_enrich", "event_id i, city s, day d, ticker s, fcst_f f, entry f", f"""
SELECT o.event_id, p.city, p.day, p.ticker, p.fcst_f, 30.0 AS entry FROM v_obs o JOIN ({PICK.format(bias='1.0e0')}) p ON p.city = o.city AND p.day = o.day""")
def stream_static_enrich(t):
    """Market-open messages joined with the static strategy rows of their event."""
    static = base(t).select("city", "day", "ticker", "fcst_f", "entry")
    s = events(t).select("event_id", F.col("event_type").alias("city"), F.to_date("ts").alias("day"))
    return R.run_to_parquet(t.spark, s.join(static, ["city", "day"]), "static_enrich")


def market_snapshot(t):
    q = SRC.quotes(events(t))
    s = R.run_updates(t.spark, ST.latest_known(q, ["mkt"], ["bid", "ask", "volume"], ["us", "event_id"], "1 day"), ["mkt"], "snapshot_state")
    return s.join(t.market, "mkt")


@query("stream_market_snapshot", "city s, day d, n i, best_bid i, best_ask i, brackets s", f"""
SELECT m.city, m.day, count(*) AS n, max(bid) AS best_bid, min(ask) AS best_ask, string_agg(m.ticker, ',' ORDER BY m.j) AS brackets FROM ({_ST}) s JOIN v_market m USING (mkt) GROUP BY m.city, m.day""")
def stream_market_snapshot(t):
    """Quote state with metadata per event; the array holds the event's six brackets."""
    b = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", "ticker"))), lambda x: x["ticker"]), ",")
    return market_snapshot(t).groupBy("city", "day").agg(F.count(N(1)).alias("n"), F.max("bid").alias("best_bid"), F.min("ask").alias("best_ask"), b.alias("brackets"))


@query("stream_fill_matching", "order_id i, order_us u, fill_us u, taker i", """
SELECT o.event_id // 2 AS order_id, epoch_us(o.ts) AS order_us, epoch_us(f.ts) AS fill_us, (f.user_id % 2 = 0)::INT AS taker FROM events o JOIN events f ON f.event_id // 2 = o.event_id // 2 AND o.event_id % 2 = 0 AND f.event_id % 2 = 1 AND f.ts BETWEEN o.ts AND o.ts + INTERVAL 30 MINUTE""")
def stream_fill_matching(t):
    """Stream-stream join of fills to orders by id within 30 minutes."""
    oid = F.floor(F.col("event_id") / 2)
    e = events(t)
    o = e.filter("event_id % 2 = 0").select(oid.alias("order_id"), F.col("us").alias("order_us"), F.col("ets").alias("o_ts")).withWatermark("o_ts", "1 hour")
    f = e.filter("event_id % 2 = 1").select(oid.alias("fill_id"), F.col("us").alias("fill_us"), F.col("ets").alias("f_ts"), (F.col("user_id") % 2 == 0).cast("int").alias("taker")).withWatermark("f_ts", "1 hour")
    j = o.join(f, F.expr("order_id = fill_id AND f_ts >= o_ts AND f_ts <= o_ts + INTERVAL 30 MINUTES"))
    return R.run_to_parquet(t.spark, j, "fill_matching")


@query("stream_daily_loss", "city s, day d, pnl i, halted i", """
SELECT city, day, sum(CAST(round(temp_f * 100) AS BIGINT) - 1500) AS pnl, (sum(CAST(round(temp_f * 100) AS BIGINT) - 1500) <= -10000)::INT AS halted FROM v_obs GROUP BY city, day""")
def stream_daily_loss(t):
    p = F.round(F.col("value") * 100).cast("long") - 1500
    s = events(t).withWatermark("ets", "1 day").groupBy(F.window("ets", "1 day").alias("w"), F.col("event_type").alias("city")).agg(F.sum(p).alias("pnl"))
    s = s.select("city", F.date_add(N("1970-01-01").cast("date"), F.floor(F.unix_seconds("w.start") / 86400).cast("int")).alias("day"), "pnl")
    return R.run_updates(t.spark, s, ["city", "day"], "daily_loss").withColumn("halted", (F.col("pnl") <= -10000).cast("int"))


@query("stream_cooldown", "city s, bucket u", "SELECT DISTINCT city, us - us % 30000000 AS bucket FROM v_obs")
def stream_cooldown(t):
    """At most one prediction per city in a 30-second bucket."""
    s = events(t).select(F.col("event_type").alias("city"), (F.col("us") - F.pmod(F.col("us"), N(30_000_000))).alias("bucket"), "ets")
    return R.run_to_parquet(t.spark, s.withWatermark("ets", "1 minute").dropDuplicatesWithinWatermark(["city", "bucket"]).select("city", "bucket"), "cooldown")


@query("stream_scan_opportunities", "city s, day d, mkt_implied f, edge f, confidence f, signal s", f"""
WITH q AS (SELECT m.city, m.day, m.floor_s, bid / 100.0e0 AS b, ask / 100.0e0 AS a FROM ({_ST}) s JOIN v_market m USING (mkt) WHERE m.strike_type = 'between' AND bid IS NOT NULL AND ask IS NOT NULL),
l AS (SELECT city, day, count(*) AS n, 2 * avg(a - b) AS unc, list(floor_s ORDER BY floor_s) AS t, list((a + b) / 2 ORDER BY floor_s) AS m FROM q GROUP BY city, day),
x AS (SELECT city, day, unc, CASE WHEN i = 0 THEN t[1] - 1 WHEN i = n THEN t[n] + 1 ELSE (t[i] + t[i + 1]) / 2 END AS mid, greatest((CASE WHEN i = 0 THEN 1.0e0 ELSE m[i] END) - (CASE WHEN i = n THEN 0 ELSE m[i + 1] END), 0) AS q FROM l, range(0, 7) r(i) WHERE i <= n),
e AS (SELECT x.city, x.day, sum(mid * q) / sum(q) AS mkt_implied, max(unc) AS unc FROM x GROUP BY x.city, x.day), z AS (SELECT e.*, f.tempmax_f - mkt_implied AS edge, abs(f.tempmax_f - mkt_implied) / sqrt(0.25e0 + unc * unc) AS z FROM e JOIN v_fcst f ON f.city = e.city AND f.day = e.day AND f.lead = 1)
SELECT * FROM (SELECT city, day, mkt_implied, edge, 1 - 2 * {PHI_SQL.format(z='z')} AS confidence, CASE WHEN abs(edge) >= 1.5 AND 1 - 2 * {PHI_SQL.format(z='z')} >= 0.6 THEN CASE WHEN edge > 0 THEN 'buy_high' ELSE 'buy_low' END ELSE 'no_trade' END AS signal FROM z) WHERE signal <> 'no_trade'""")
def stream_scan_opportunities(t):
    """Quote state scored against the forecast, tradeable ones ranked by edge."""
    q = market_snapshot(t).filter("strike_type = 'between'")
    m = E.market_implied(q, ["city", "day"])
    f = t.fcst.filter("lead = 1").select("city", "day", F.col("tempmax_f").alias("fcst"))
    e = E.with_edge(m.join(f, ["city", "day"]), "fcst", "mkt_implied", N(0.5), "mkt_unc")
    return e.filter("signal <> 'no_trade'").orderBy(F.desc(F.abs("edge")), "city", "day")
