"""Bars from trades, and the dense one-minute grid."""

from pyspark.sql import functions as F

from ..functions.timeutil import MINUTE, col


def ohlc(trades, keys, step, us="us", seq="seq", price="price", count="cnt"):
    """First/max/min/last price, volume and trade count per fixed step."""
    pos = F.struct(us, seq)
    return trades.filter(col(price).isNotNull()).groupBy(*keys, (col(us) - F.pmod(col(us), F.lit(step))).alias("minute")).agg(
        F.min_by(price, pos).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, pos).alias("c"),
        F.sum(count).alias("v"), F.count(F.lit(1)).alias("n"))
