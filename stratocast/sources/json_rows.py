"""Nested JSON documents to typed rows."""

from pyspark.sql import functions as F

from ..functions.timeutil import col, epoch_us, from_us

MINUTE_T = "datetimeEpoch bigint, temp double, humidity double, dew double, preciptype array<string>"
TIMELINE = (f"days array<struct<datetime:string,tempmax:double,hours:array<struct<datetimeEpoch:bigint,"
            "temp:double,minutes:array<struct<datetimeEpoch:bigint,temp:double,humidity:double,dew:double,"
            "preciptype:array<string>>>>>>>")
FORECAST = ("basis string, days array<struct<datetime:string,tempmax:double,"
            "hours:array<struct<datetimeEpoch:bigint,temp:double>>>>")
OHLC = "open int, high int, low int, close int"


def timeline_minutes(df, text, keep, zone="UTC"):
    """One row per minute; an hour without minutes yields the hour itself."""
    d = df.select(*keep, F.from_json(text, TIMELINE).alias("_j"))
    d = d.select(*keep, F.explode_outer("_j.days").alias("_d"))
    d = d.select(*keep, F.col("_d.datetime").alias("day"), F.explode_outer("_d.hours").alias("_h"))
    d = d.select(*keep, "day", "_h", F.explode_outer("_h.minutes").alias("_m"))
    epoch = F.coalesce("_m.datetimeEpoch", "_h.datetimeEpoch")
    return d.select(*keep, "day", epoch.alias("epoch"),
                    F.coalesce("_m.temp", "_h.temp").alias("temp_f"),
                    F.col("_m.humidity").alias("humidity"),
                    F.concat_ws(",", "_m.preciptype").alias("preciptype"),
                    F.convert_timezone(F.lit("UTC"), F.lit(zone), from_us(epoch * 1_000_000)).alias("local_ts"),
                    F.col("_m").isNull().cast("int").alias("from_hour")).filter("epoch IS NOT NULL")


def forecast_rows(df, text, keep):
    """Daily and hourly forecast rows with lead_days and floor lead_hours."""
    d = df.select(*keep, F.from_json(text, FORECAST).alias("_j"))
    basis = F.to_date(F.col("_j.basis"))
    d = d.select(*keep, basis.alias("basis"), F.explode("_j.days").alias("_d"))
    target = F.to_date(F.col("_d.datetime"))
    d = d.select(*keep, "basis", target.alias("target"), F.datediff(target, "basis").alias("lead_days"),
                 F.col("_d.tempmax").alias("tempmax_f"), F.explode_outer("_d.hours").alias("_h"))
    b = F.floor(epoch_us(F.col("basis").cast("timestamp_ntz")) / 1_000_000)
    return d.select(*keep, "basis", "target", "lead_days", "tempmax_f",
                    F.col("_h.temp").alias("temp_f"),
                    F.floor((F.col("_h.datetimeEpoch") - b) / 3600).alias("lead_hours"))


def candle_prices(df, text, keep):
    """Flat price columns win; nested open/high/low/close fill what is NULL."""
    sides = ("yes_bid", "yes_ask")
    flat = ", ".join(f"{s}_{p} int" for s in sides for p in ("open", "close"))
    schema = f"end_period_ts bigint, volume bigint, price double, {flat}, " + ", ".join(
        f"{s} struct<{OHLC.replace(' int', ':int').replace(', ', ',')}>" for s in sides)
    j = df.select(*keep, F.from_json(text, schema).alias("_j"))
    out = [F.coalesce(f"_j.{s}_{p}", f"_j.{s}.{p}").alias(f"{s}_{p}") for s in sides for p in ("open", "close")]
    return j.select(*keep, F.col("_j.end_period_ts").alias("end_ts"),
                    F.bround(F.col("_j.price") * 100, 0).cast("long").alias("price_c"), *out,
                    F.col("_j.volume").alias("volume"))


def candle_row(df):
    """Table row of a candle: starts 60 s before its end, trade price falls back to ask."""
    return df.withColumns({"bucket_s": F.col("end_ts") - 60,
                           "close_c": F.coalesce("price_c", "yes_ask_close"),
                           "open_c": F.coalesce("price_c", "yes_ask_open")})


def message_meta(text):
    """Stream and topic of a raw message with the usual fallbacks."""
    g = lambda p: F.get_json_object(col(text), p)
    return F.struct(
        F.coalesce(g("$.channel"), g("$.type"), F.lit("unknown")).alias("stream"),
        F.coalesce(g("$.ticker"), g("$.market_ticker"), g("$.msg.ticker"), g("$.msg.market_ticker")).alias("topic"))


def daily_value(raw):
    """Climate report text to a whole number: M or blank is missing, T is a trace."""
    s = F.trim(col(raw))
    v = F.when(F.upper(s).isin("M", ""), None).when(F.upper(s) == "T", 0.001).otherwise(s.try_cast("double"))
    return v
