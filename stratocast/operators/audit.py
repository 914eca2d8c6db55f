"""Coverage, freshness and sanity audits."""

from pyspark.sql import functions as F

from ..functions.timeutil import MINUTE, col
from .chunked import prefix_scan, time_chunk


def freshness(df, keys, ts):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def previous(df, keys, us, name="prev_us"):
    """Previous distinct-order time per key, across chunk borders."""
    return prefix_scan(df, keys, [us], time_chunk(us), {name: ("last", us)}, inclusive=False)


def minute_gaps(df, keys, us):
    """Minutes missing between consecutive rows, per key."""
    d = previous(df.select(*keys, us), keys, us)
    gap = F.floor((F.col(us) - F.col("prev_us")) / MINUTE) - 1
    return d.groupBy(*keys).agg(F.sum(F.coalesce(F.greatest(gap, F.lit(0)), F.lit(0))).alias("gap_minutes"),
                                F.count(F.lit(1)).alias("actual_minutes"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


def market_coverage(markets, candles, key="mkt"):
    """Gap minutes plus expected-minus-actual, both parts kept."""
    g = minute_gaps(candles.select(key, "bucket_us").distinct(), [key], "bucket_us")
    j = markets.select(key, "listed_us", "close_us").join(g, key, "left")
    exp = F.when(F.col("first_us").isNull(), 0).otherwise(
        F.floor((F.col("close_us") - F.col("listed_us")) / MINUTE) + 1)
    short = F.greatest(exp - F.coalesce("actual_minutes", F.lit(0)), F.lit(0))
    return j.select(key, exp.alias("expected_minutes"), F.coalesce("actual_minutes", F.lit(0)).alias("actual_minutes"),
                    F.coalesce("gap_minutes", F.lit(0)).alias("gap_minutes"), short.alias("short_minutes"),
                    (F.coalesce("gap_minutes", F.lit(0)) + short).alias("missing_minutes"))


def slot_coverage(events, obs, keys, cols, step_us, lo, hi):
    """Filled slots of an event window against its expected slots.

    Observations are reduced to (slot) rows first; the window spans two local
    days, so each slot is offered to at most two events and no range join runs.
    """
    slots = obs.groupBy("city", F.floor(F.col("us") / step_us).alias("slot")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in cols])
    slots = slots.withColumn("_d", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("slot") * step_us / 86_400_000_000).cast("int")))
    s = slots.withColumn("day", F.explode(F.array(F.col("_d"), F.date_add("_d", 1)))).drop("_d")
    j = events.join(s, keys, "left").filter((F.col("slot") * step_us >= lo) & (F.col("slot") * step_us <= hi))
    return j.groupBy(*keys).agg(F.count("slot").alias("slots"), F.sum("rows").alias("rows"), *[F.sum(c).alias(f"n_{c}") for c in cols])


def missing_leads(fcst, keys, max_lead):
    have = F.collect_set(F.when(F.col("lead") <= max_lead, F.col("lead")))
    return fcst.groupBy(*keys).agg(
        F.array_sort(have).alias("present"),
        F.array_sort(F.array_except(F.sequence(F.lit(0), F.lit(max_lead)), have)).alias("missing"))


def hour_coverage(obs, keys, lo=6, hi=23):
    hours = F.collect_set("hour")
    seen = F.size(F.array_intersect(hours, F.sequence(F.lit(lo), F.lit(hi))))
    return obs.groupBy(*keys).agg(F.size(hours).alias("n_hours"), (seen / F.lit(hi - lo + 1)).alias("share"),
                                  F.min("hour").alias("earliest"), F.max("hour").alias("latest"))


def null_profile(df, cols, by=()):
    """(column, non-null count, rate): one pass, one row per column."""
    n = F.count(F.lit(1))
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("non_null"), (F.count(c) / n).alias("rate")) for c in cols])
    return df.groupBy(*by).agg(n.alias("rows"), items.alias("_i")).select(*by, "rows", F.explode("_i").alias("_x")).select(*by, "rows", "_x.*")


def quality_days(obs, keys, invalid, min_pct=0.0):
    """Share of invalid rows per key, only keys above ``min_pct``."""
    bad = F.count_if(invalid)
    return obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), bad.alias("bad"),
                                  (bad * 100.0 / F.count(F.lit(1))).alias("bad_pct")).filter(F.col("bad_pct") > min_pct)


def step_minutes(obs, keys, us, default=15):
    """Median spacing of a series in minutes. Spacings are whole seconds, so the exact
    median works on a bounded set of distinct values."""
    d = previous(obs.select(*keys, us), keys, us)
    gap = F.floor((F.col(us) - F.col("prev_us")) / 1_000_000)
    return d.groupBy(*keys).agg(F.coalesce(F.bround(F.median(gap) / 60, 0).cast("long"), F.lit(default)).alias("step_min"))


def staleness(expected, df, keys, us, now_us, limit_us):
    """pass / stale / missing per expected key."""
    last = df.groupBy(*keys).agg(F.max(us).alias("last_us"))
    j = expected.join(last, list(keys), "left")
    age = F.lit(now_us) - F.col("last_us")
    return j.withColumns({"age_min": F.floor(age / MINUTE),
                          "status": F.when(F.col("last_us").isNull(), "missing").when(age > limit_us, "stale").otherwise("pass")})


def violations(df, checks, by=()):
    """Number of rows breaking each named rule, in one pass."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])


def parity(a, b, keys, cols, tol=1e-6):
    """Per column: rows compared, missing on either side, and values beyond tolerance."""
    l = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(1).alias("_a"))
    r = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(1).alias("_b"))
    j = l.join(r, list(keys), "full")
    item = lambda c: F.struct(
        F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"),
        F.count_if(F.col(f"a_{c}").isNull()).alias("null_a"), F.count_if(F.col(f"b_{c}").isNull()).alias("null_b"),
        F.count_if(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > tol).alias("differ"))
    return j.agg(F.array(*[item(c) for c in cols]).alias("_x")).select(F.explode("_x").alias("x")).select("x.*")
