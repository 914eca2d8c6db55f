"""Joins of values to the brackets of their event."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.strikes import contains, type_priority
from ..functions.timeutil import col


def join_bracket(df, markets, keys, value, cols, mode="real", kinds=None):
    """One bracket per row: equi join on the event, best matching type first.

    The few brackets of an event are packed into one ordered array row, so the
    join keeps one row per input row and needs no aggregation afterwards. Rows
    outside every bracket are dropped.
    """
    m = markets if kinds is None else markets.filter(col("strike_type").isin(*kinds))
    own = [c for c in cols if c not in ("strike_type", "floor_s", "cap_s")]
    item = F.struct(type_priority("strike_type").alias("_r"), F.coalesce(col("floor_s"), F.lit(-1e9)).alias("_f"),
                    "strike_type", "floor_s", "cap_s", *own)
    ev = m.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_b"))
    hit = F.get(F.filter("_b", lambda b: contains(b["strike_type"], b["floor_s"], b["cap_s"], value, mode)), F.lit(0))
    j = df.join(ev, list(keys)).withColumn("_h", hit).filter("_h IS NOT NULL")
    return j.select(*df.columns, *[F.col(f"_h.{c}").alias(c) for c in cols])


def neighbours(markets, keys, name="ticker"):
    """Index of each bracket by floor (NULL first) and its next/previous ticker.

    Partitions are one event, i.e. a handful of brackets.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("floor_s").asc_nulls_first())
    return markets.withColumns({
        "idx": F.row_number().over(w) - 1, "up": F.lead(name).over(w), "down": F.lag(name).over(w),
        "total": F.count(F.lit(1)).over(Window.partitionBy(*keys))})


def winner(df, markets, keys):
    """Attach the winning bracket; between first, then highest greater, then lowest less."""
    rank = (F.when(F.col("strike_type") == "between", F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("b")))
            .when(F.col("strike_type") == "greater", F.struct(F.lit(1).alias("a"), (-F.col("floor_s")).alias("b")))
            .otherwise(F.struct(F.lit(2).alias("a"), F.col("cap_s").alias("b"))))
    w = markets.filter("result = 'yes'").groupBy(*keys).agg(
        F.min_by(F.struct("ticker", "strike_type", "floor_s", "cap_s"), rank).alias("_w"))
    return df.join(w, list(keys), "left").select(
        *df.columns, F.col("_w.ticker").alias("win_ticker"), F.col("_w.strike_type").alias("win_type"))
