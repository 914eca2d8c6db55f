"""State carried over several micro-batches."""

from pyspark.sql import functions as F

from stratocast.functions.timeutil import DAY, MINUTE
from stratocast.queries import QUERIES, streams
from stratocast.session import scratch
from stratocast.streaming import runner, sources, state

SF = "/root/testdata/sf0.001"


def test_dense_fill_continues_between_cycles(spark):
    m, root = MINUTE, scratch(spark, "cycles")
    schema = "mkt string, bucket_us long, bid int, close_us long"
    first = spark.createDataFrame([("x", 0, 5, 100 * m), ("y", 2 * m, 7, 3 * m)], schema)
    second = spark.createDataFrame([("x", 6 * m, 9, 100 * m)], schema)
    for i, b in enumerate([first, spark.createDataFrame([], schema), second]):
        state.extend_dense(spark, b, i, root, "mkt", ["bid"], "close_us")
    rows = spark.read.parquet(f"{root}/dense").orderBy("mkt", "bucket_us").collect()
    x = [(r.bucket_us // m, r.bid, r.is_synthetic) for r in rows if r.mkt == "x"]
    assert x == [(0, 5, 0)] + [(i, 5, 1) for i in range(1, 6)] + [(6, 9, 0)]
    y = [(r.bucket_us // m, r.bid) for r in rows if r.mkt == "y"]
    assert y == [(2, 7), (3, 7)]


def test_late_rows_overwrite_only_when_newer(spark):
    root = scratch(spark, "merge")
    schema = "k string, day string, ver long, v int"
    a = spark.createDataFrame([("a", "d1", 1, 1), ("b", "d2", 5, 5)], schema)
    b = spark.createDataFrame([("a", "d1", 2, 2), ("c", "d1", 1, 9)], schema)
    old = spark.createDataFrame([("b", "d2", 3, 3)], schema)
    for i, d in enumerate([a, b, old, b]):
        state.merge_days(spark, d, i, root, ["k", "day"], "ver", "day")
    got = {r.k: r.v for r in spark.read.schema(schema).parquet(f"{root}/table").collect()}
    assert got == {"a": 2, "b": 5, "c": 9}


def test_quote_state_over_files(spark):
    src = scratch(spark, "quotes")
    schema = "mkt string, us long, event_id long, bid double, ask double, volume double"
    # The newest message arrives first; absent fields keep the older value.
    parts = [[("x", 9, 3, None, 8.0, 1.0)], [("x", 1, 1, 4.0, 6.0, 0.0), ("x", 5, 2, 5.0, None, 0.0)]]
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = runner.run_updates(spark, state.latest_known(s, ["mkt"], ["bid", "ask", "volume"], ["us", "event_id"]), ["mkt"], "q").first()
    assert (q.bid, q.ask, q.volume, q.n_msgs) == (5.0, 8.0, 1.0, 3)


def drained(spark, stream, mode):
    """Progress of every micro-batch of a drained stream."""
    root = scratch(spark, "drained")
    runner.use_rocksdb(spark)
    q = (stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: df.write.format("noop").mode("append").save())
         .option("checkpointLocation", root).trigger(availableNow=True).start())
    q.awaitTermination()
    return [p for p in q.recentProgress if p["numInputRows"] or p["stateOperators"]]


def market_messages(spark, late=()):
    """Three days of messages of two markets a day, then one message of each row in ``late``."""
    rows = [(f"m{d}{k}", d * DAY + h * 60 * MINUTE, 100 * d + h, 1.0 * h) for d in range(5) for k in "ab" for h in range(24)]
    src = scratch(spark, "messages")
    schema = "mkt string, us long, event_id long, bid double"
    for part in [[r for r in rows if r[1] // DAY == d] for d in range(5)] + ([list(late)] if late else []):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    return s.withColumn("ets", F.timestamp_micros("us"))


def test_state_of_a_market_goes_after_its_day(spark):
    s = market_messages(spark, late=[("m0a", 5 * MINUTE, 9999, 3.0), ("m4a", 4 * DAY + MINUTE, 9998, 3.0)])
    p = drained(spark, state.latest_known(s, ["mkt"], ["bid"], ["us", "event_id"], "6 hours"), "update")
    rows = [x["stateOperators"][0]["numRowsTotal"] for x in p]
    # Of ten markets at most those of two days are held; the late message of the first day is dropped and counted.
    assert len(p) >= 6 and max(rows) <= 4 and rows[-1] <= 2
    assert sum(x["stateOperators"][0]["numRowsDroppedByWatermark"] for x in p) == 1


def test_price_history_expires_by_timer(spark):
    p = drained(spark, state.price_history(market_messages(spark), "mkt", "6 hours"), "append")
    rows = [x["stateOperators"][0]["numRowsTotal"] for x in p]
    held = drained(spark, state.price_history(market_messages(spark), "mkt", "4000 days"), "append")
    assert len(p) >= 5 and max(rows[:-1]) < max(x["stateOperators"][0]["numRowsTotal"] for x in held)
    assert rows[-1] < held[-1]["stateOperators"][0]["numRowsTotal"]


def test_replay_keeps_order_and_rows(spark, tables):
    seen = []

    def save(df, i):
        r = df.agg(F.count(F.lit(1)), F.min("us"), F.max("us")).first()
        seen.append(tuple(r))

    q = sources.replayed_events(spark, tables.events).writeStream.foreachBatch(save).option("checkpointLocation", scratch(spark, "replay-test")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 5 and sum(n for n, _, _ in seen) == tables.events.count() and min(n for n, _, _ in seen) > 0
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))


def test_one_batch_gives_the_same_result(spark, monkeypatch):
    names = ["stream_quote_state", "stream_first_seen", "stream_minute_candles", "stream_dense_fill", "stream_late_upsert"]
    many = {n: sorted(map(str, QUERIES[n](spark, SF).collect())) for n in names}
    monkeypatch.setattr(streams, "events", lambda t: sources.read_events(t.spark, t.dir))
    assert many == {n: sorted(map(str, QUERIES[n](spark, SF).collect())) for n in names}
