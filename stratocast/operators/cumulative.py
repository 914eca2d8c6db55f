"""Aggregates of a day up to each hourly cutoff.

Rows are reduced to one partial per (city, day, hour) before anything is
ordered, so a busy city costs a map-side combine, and the running part works on
24 rows per day instead of one copy of the day per cutoff.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.timeutil import HOUR, col

FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def so_far(obs, snap, specs, exact=None, keys=("city", "day")):
    """``specs``: name -> (sum|max|min, column). A cutoff sees rows up to and
    including its own instant; ``exact[name] = False`` leaves the instant out."""
    keys, exact = list(keys), exact or {}
    # Rows exactly on the hour belong to that cutoff, all others to the next one.
    after = (F.pmod(col("us"), F.lit(HOUR)) > 0).cast("int")
    hour = F.hour("ts")
    aggs = []
    for n, (kind, c) in specs.items():
        aggs.append(FOLD[kind](c).alias(n))
        if exact.get(n) is False:
            aggs.append(FOLD[kind](F.when(after == 0, c)).alias("_at_" + n))
    p = obs.groupBy(*keys, (hour + after).alias("hour")).agg(*aggs)
    spine = snap.select(*keys, "hour").withColumn("_snap", F.lit(1))
    allh = p.join(spine, [*keys, "hour"], "full")
    w = Window.partitionBy(*keys).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    cum = {n: FOLD[k](F.col(n)).over(w) for n, (k, _) in specs.items()}
    out = allh.withColumns(cum)
    for n, v in exact.items():
        if v is False:
            out = out.withColumn(n, F.col(n) - F.coalesce(F.col("_at_" + n), F.lit(0)))
    first = next(iter(specs))
    return out.filter(F.col("_snap").isNotNull() & F.col(first).isNotNull()).select(*keys, "hour", *specs)
