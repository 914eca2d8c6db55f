"""Binding of the domain model to the star-schema parquet tables.

The given tables hold no weather or markets, so observations, settlements,
forecasts, brackets, quotes, trades and class probabilities are derived from
them. Every derived table is a lazy DataFrame that scans the whole source.
"""

from functools import cached_property

from pyspark.sql import functions as F

from ..functions.timeutil import HOUR, MINUTE, day_index, epoch_us
from ..sources.readers import read_table

LEADS = range(7)
HOURS = range(24)
STRIKES = range(6)
CITIES = ["click", "error", "purchase", "signup", "view"]


class Tables:
    def __init__(self, spark, sf_dir):
        self.spark, self.dir = spark, sf_dir

    def read(self, name):
        return read_table(self.spark, self.dir, name)

    def __getattr__(self, name):
        if name in ("region nation customer supplier part orders lineitem events documents "
                    "embeddings pages benchmark labels conversations").split():
            return self.read(name)
        raise AttributeError(name)

    @cached_property
    def obs(self):
        """Station observations; ``raw_f`` also carries NULLs, sentinels and outliers."""
        e = F.col("event_id")
        return self.events.select(
            F.col("event_type").alias("city"), "ts", F.to_date("ts").alias("day"),
            F.hour("ts").alias("hour"), epoch_us("ts").alias("us"), "event_id",
            F.col("value").alias("temp_f"),
            F.when(e % 17 == 0, None).when(e % 29 == 0, -77.9).when(e % 31 == 0, 151.0)
            .otherwise(F.col("value")).alias("raw_f"),
            (F.col("user_id") % 101).cast("double").alias("humidity"),
            ((e * 7) % 40).cast("double").alias("wind"), ((e * 7) % 40 + (e * 11) % 15).cast("double").alias("gust"),
            ((e * 13) % 101).cast("double").alias("cloud"),
        )

    @cached_property
    def obs2(self):
        """City-aggregate series: the station series with an offset."""
        return self.obs.withColumn("temp_f", F.col("temp_f") - F.col("event_id") % 5)

    @cached_property
    def settle(self):
        return self.obs.groupBy("city", "day").agg(
            F.bround(F.max("temp_f"), 0).cast("long").alias("settle_f"),
            F.max("temp_f").alias("vc_max_f"),
        ).withColumn("di", day_index("day"))

    @cached_property
    def fcst(self):
        """Daily forecast highs of seven leads; some leads are missing."""
        return (
            self.settle.select("city", "day", "di", "settle_f",
                               F.explode(F.array(*[F.lit(i) for i in LEADS])).alias("lead"))
            .filter((F.col("di") + F.col("lead")) % 11 != 0)
            .select("city", "day", "di", "lead",
                    F.date_sub("day", F.col("lead")).alias("basis"),
                    (F.col("settle_f") + (F.col("di") * F.col("lead")) % 7 - 3).cast("double").alias("tempmax_f"))
        )

    @cached_property
    def fcst_station(self):
        """Forecast high of the station, made the day before."""
        f = self.fcst.filter("lead = 1")
        return f.select("city", "day", (F.col("tempmax_f") + F.col("di") % 3 - 1).alias("tempmax_f"))

    @cached_property
    def fcst_hourly(self):
        """Hourly forecast curve peaking near 15:00; some hours are missing."""
        d, h = F.col("di"), F.col("hour")
        t = F.col("settle_f") - 0.2 * (h - 15) * (h - 15) + ((d + h) % 3) * 0.5
        return (
            self.settle.select("city", "day", "di", "settle_f",
                               F.explode(F.array(*[F.lit(i) for i in HOURS])).alias("hour"))
            .filter((d + h) % 13 != 0)
            .select("city", "day", "di", "hour",
                    (F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * 24 * HOUR + h * HOUR).alias("us"),
                    t.alias("temp_f"), ((d * 7 + h * 13) % 101).cast("double").alias("cloud"),
                    ((d * 5 + h * 11) % 101).cast("double").alias("humidity"), (t - 5 - h % 4).alias("dew"))
        )

    @cached_property
    def market(self):
        """Six brackets per (city, day): low tail, four ranges, high tail."""
        c = F.col("settle_f") + (F.col("di") * 3) % 9 - 4
        j = F.col("j")
        floor = F.when(j.between(1, 4), c - 5 + 2 * (j - 1)).when(j == 5, c + 2)
        cap = F.when(j == 0, c - 6).when(j.between(1, 4), c - 4 + 2 * (j - 1))
        stem = F.concat(F.lit("HIGH"), F.upper(F.substring("city", 1, 3)), F.lit("-"),
                        F.upper(F.date_format("day", "yyMMMdd")), F.lit("-"))
        tail = (F.when(j == 0, F.concat(F.lit("T"), cap.cast("string"), F.lit("LO")))
                .when(j == 5, F.concat(F.lit("T"), floor.cast("string")))
                .otherwise(F.concat(F.lit("B"), floor.cast("string"), F.lit(".5"))))
        base = self.settle.select("city", "day", "di", "settle_f",
                                  F.explode(F.array(*[F.lit(i) for i in STRIKES])).alias("j"))
        won = F.when(j == 0, F.col("settle_f") <= cap).when(j == 5, F.col("settle_f") >= floor + 1).otherwise(
            F.col("settle_f").between(floor, cap))
        return base.select(
            "city", "day", "di", "j",
            F.concat_ws("|", "city", F.date_format("day", "yyyyMMdd"), j.cast("string")).alias("mkt"),
            F.concat(stem, tail).alias("ticker"),
            F.when(j == 0, "less").when(j == 5, "greater").otherwise("between").alias("strike_type"),
            floor.cast("double").alias("floor_s"), cap.cast("double").alias("cap_s"),
            (F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * 24 * HOUR - 10 * HOUR).alias("listed_us"),
            (F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * 24 * HOUR + 22 * HOUR).alias("close_us"),
            F.when(won, "yes").otherwise("no").alias("result"),
        )

    @cached_property
    def quote(self):
        """Raw quote ticks, spread over the six brackets of the day."""
        e = F.col("event_id")
        j = (F.col("user_id") % 6).cast("int")
        us = epoch_us("ts")
        return self.events.select(
            F.col("event_type").alias("city"), F.to_date("ts").alias("day"), j.alias("j"),
            F.concat_ws("|", "event_type", F.date_format("ts", "yyyyMMdd"), j.cast("string")).alias("mkt"),
            us.alias("us"), (us - F.pmod(us, F.lit(MINUTE))).alias("bucket_us"), "event_id",
            (1 + e % 90).alias("bid"), (1 + e % 90 + 1 + e % 7).alias("ask"),
            F.when(e % 11 == 0, None).otherwise(1 + e % 90).alias("bid_n"),
            (F.col("user_id") % 5).alias("volume"), (e % 1000).alias("oi"))

    @cached_property
    def candle(self):
        """One row per (market, minute): last quote of the minute, summed volume."""
        return self.quote.groupBy("city", "day", "j", "mkt", "bucket_us").agg(
            F.max_by("bid", "event_id").alias("bid"), F.max_by("ask", "event_id").alias("ask"),
            F.max_by("bid_n", F.when(F.col("bid_n").isNotNull(), F.col("event_id"))).alias("bid_n"),
            F.sum("volume").alias("volume"), F.max_by("oi", "event_id").alias("oi"))

    @cached_property
    def trade(self):
        e = F.col("event_id")
        j = (F.col("user_id") % 6).cast("int")
        return self.events.select(
            F.col("event_type").alias("city"), F.to_date("ts").alias("day"), j.alias("j"),
            F.concat_ws("|", "event_type", F.date_format("ts", "yyyyMMdd"), j.cast("string")).alias("mkt"),
            "ts", epoch_us("ts").alias("us"), e.alias("seq"), (1 + e % 98).alias("price"),
            (1 + F.col("user_id") % 5).alias("cnt"))

    @cached_property
    def snap(self):
        """Hourly snapshot cutoffs, hours 10-23 of every (city, event day)."""
        return self.settle.select(
            "city", "day", "di", "settle_f", F.explode(F.sequence(F.lit(10), F.lit(23))).alias("hour")
        ).withColumn("us", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * 24 * HOUR
                     + F.col("hour") * HOUR)

    @cached_property
    def probs(self):
        """Seven-class probability vectors, classes -3..3: all components, folded by position modulo 7."""
        def share(k):
            own = F.filter("embedding", lambda x, i: i % 7 == k)
            return F.aggregate(own, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))

        raw = F.array(*[share(k) for k in range(7)])
        return self.embeddings.withColumn("_r", raw).withColumn(
            "_s", F.aggregate("_r", F.lit(0.0), lambda a, x: a + x)
        ).select(
            "vec_id", F.transform("_r", lambda x: x / F.col("_s")).alias("p"),
            F.array(*[F.lit(k) for k in range(-3, 4)]).alias("classes"),
            (F.pmod(F.col("label"), F.lit(7)) - 3).cast("int").alias("y"),
            (60 + F.col("vec_id") % 40).cast("int").alias("t_base"))

    @cached_property
    def probs_long(self):
        return self.probs.select("vec_id", "y", "t_base", F.posexplode("p").alias("i", "p")).withColumn(
            "k", F.col("i") - 3)

    @cached_property
    def bt(self):
        """Back-test trades: integer-cent P&L, edge, probability, outcome."""
        disc = F.round(F.col("l_discount") * 100).cast("long")
        return self.lineitem.select(
            F.concat_ws("-", "l_returnflag", "l_linestatus").alias("city"),
            F.to_date("l_shipdate").alias("day"), F.col("l_orderkey").alias("ok"),
            F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
            ((F.col("l_quantity") - 25) / 2).alias("edge"),
            F.floor((disc - 5) * F.col("l_extendedprice") / 1000).cast("long").alias("pnl"),
            (((F.col("l_partkey") * 37 + F.col("l_orderkey") * 11) % 1000) / 1000).alias("prob"),
            (1 + F.col("l_partkey") % 98).alias("price"),
            (1 + F.col("l_suppkey") % 20).alias("n"),
            ((F.col("l_suppkey") + F.col("l_orderkey")) % 5 < 2).cast("int").alias("won"))

    @cached_property
    def run(self):
        """Guidance runs: customer segment as city, order date as run time."""
        c = F.col("o_custkey")
        return self.orders.select(
            F.col("o_orderpriority").alias("city"), F.to_date("o_orderdate").alias("day"),
            F.array(F.lit("nbm"), F.lit("hrrr"), F.lit("ndfd"))[(F.col("o_orderkey") % 3).cast("int")].alias("model"),
            F.col("o_orderkey").alias("run_id"), (F.col("o_totalprice") / 5000).alias("peak_f"), c.alias("cust"))

    @cached_property
    def guidance(self):
        """Runs of three models for the observed cities, spread over January."""
        o = F.col("o_orderkey")
        return self.orders.select(
            F.array(*[F.lit(c) for c in CITIES])[(F.col("o_custkey") % 5).cast("int")].alias("city"),
            F.date_add(F.lit("2024-01-01").cast("date"), (o % 30).cast("int")).alias("day"),
            F.array(F.lit("nbm"), F.lit("hrrr"), F.lit("ndfd"))[(o % 3).cast("int")].alias("model"),
            o.alias("run_id"), (F.col("o_totalprice") / 5000).alias("peak_f"),
            ((F.datediff(F.lit("2024-01-01").cast("date"), F.lit("1970-01-01").cast("date")) + (o % 30)) * 24 * HOUR + (o % 45 - 24) * HOUR).cast("long").alias("run_us"))
