"""Stateful stream operators."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.timeutil import DAY, MINUTE
from ..session import written
from ..sources.upsert import latest

HISTORY = 100


def per_event_day(stream, keys, late="1 day"):
    """Grouping of messages that belong to one event day per key (a market does): state of a
    day goes when the watermark has passed its end, messages that come later still are dropped."""
    return stream.withWatermark("ets", late).groupBy(F.window("ets", "1 day"), *keys)


def latest_known(stream, keys, fields, order, late=None):
    """Newest non-NULL value of every field per key, whatever the arrival order.

    One state row per key; partial aggregates are combined before the shuffle. ``late``: how
    long after its event day a key is kept (``per_event_day``), None for ever.
    """
    pos = F.struct(*order)
    groups = stream.groupBy(*keys) if late is None else per_event_day(stream, keys, late)
    return groups.agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), pos)).alias(f) for f in fields],
                      F.max(order[0]).alias("last_us"), F.count(F.lit(1)).alias("n_msgs")).select(*keys, *fields, "last_us", "n_msgs")


class PriceHistory(StatefulProcessor):
    """Keeps the newest ``HISTORY`` prices of a market, by time; arrival order does not matter.

    A timer at the end of the market's event day, in event time, drops its state.
    """

    def init(self, handle):
        self.handle = handle
        self.prices = handle.getValueState("prices", "us array<bigint>, id array<bigint>, bid array<double>")

    def handleInputRows(self, key, rows, timerValues):
        held = self.prices.get() if self.prices.exists() else ([], [], [])
        kept = pd.DataFrame({"us": held[0], "event_id": held[1], "bid": held[2]})
        for pdf in rows:
            pdf = pdf.loc[pdf["bid"].notna(), ["us", "event_id", "bid"]]
            kept = pdf if kept.empty else pd.concat([kept, pdf]) if len(pdf) else kept
            kept = kept.sort_values(["us", "event_id"]).tail(HISTORY)
        if len(kept):
            if not held[0]:
                self.handle.registerTimer(int(kept["us"].iloc[0]) // DAY * (DAY // 1000) + DAY // 1000)
            self.prices.update((kept["us"].astype("int64").tolist(), kept["event_id"].astype("int64").tolist(), kept["bid"].astype(float).tolist()))
            yield pd.DataFrame({"mkt": [key[0]], "n_hist": [len(kept)], "sum_bid": [float(kept["bid"].sum())],
                                "newest_us": [int(kept["us"].iloc[-1])]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.prices.clear()
        yield from ()

    def close(self):
        pass


def price_history(stream, key, late="1 day"):
    s = stream.withWatermark("ets", late).select(key, "us", "ets", "event_id", F.col("bid").cast("double").alias("bid"))
    return s.groupBy(key).transformWithStateInPandas(
        PriceHistory(), outputStructType=f"{key} string, n_hist long, sum_bid double, newest_us long",
        outputMode="Append", timeMode="EventTime")


def merge_days(spark, df, batch_id, root, keys, version, day):
    """Upsert a batch into a day-partitioned table, touching only the days it holds.

    Replaying a batch gives the same table: the newest version of a key wins.
    """
    path = f"{root}/table"
    touched = df.select(day).distinct()
    try:
        old = spark.read.schema(df.schema).parquet(path).join(touched, day, "left_semi")
        df = df.unionByName(old)
    except Exception as e:  # first batch: no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    latest(df, keys, version).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def extend_dense(spark, bars, batch_id, root, key, prices, close, us="bucket_us"):
    """One fill cycle: extend every market from its last bar to the cycle's newest minute.

    The state is one row per market (its last minute and prices), written per
    cycle; rows already emitted are never rewritten.
    """
    bars = written(bars, "bars")  # one row per market and minute, read several times below
    now = bars.agg(F.max(us)).first()[0]
    if now is None:
        if batch_id > 0:
            spark.read.parquet(f"{root}/last/cycle={batch_id - 1}").write.mode("overwrite").parquet(f"{root}/last/cycle={batch_id}")
        return
    bars = bars.withColumn("_real", F.lit(1))
    if batch_id > 0:
        prior = spark.read.parquet(f"{root}/last/cycle={batch_id - 1}")
        bars = bars.unionByName(prior.withColumn("_real", F.lit(0)), allowMissingColumns=True)
    span = bars.groupBy(key).agg(F.min(us).alias("_lo"), F.max(close).alias(close))
    top = F.least(F.lit(now), F.col(close))
    grid = span.filter(top >= F.col("_lo")).select(key, close, F.explode(F.sequence("_lo", top, F.lit(MINUTE))).alias(us))
    from ..operators.chunked import prefix_scan, time_chunk
    d = grid.join(bars.drop(close), [key, us], "left")
    d = prefix_scan(d, [key], [us, F.coalesce("_real", F.lit(0))], time_chunk(us), {p: ("last", p) for p in prices})
    d.filter(F.coalesce("_real", F.lit(2)) != 0).withColumn("is_synthetic", F.col("_real").isNull().cast("int")).select(
        key, us, *prices, "is_synthetic").write.mode("overwrite").parquet(f"{root}/dense/cycle={batch_id}")
    d.groupBy(key).agg(F.max(us).alias(us), F.max(close).alias(close), *[F.max_by(p, us).alias(p) for p in prices]).write.mode(
        "overwrite").parquet(f"{root}/last/cycle={batch_id}")
