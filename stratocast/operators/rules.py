"""Settlement rules per (city, day)."""

from pyspark.sql import functions as F

from ..functions.derived import via_celsius
from .chunked import runs, time_chunk


def plateau(obs, min_rows, keys=("city", "day"), order=("us", "event_id")):
    """Highest rounded value held for ``min_rows`` consecutive rows."""
    r = obs.select(*keys, *order, F.bround("temp_f", 0).cast("long").alias("k"))
    r = runs(r, keys, order, time_chunk("us"), "k")
    held = r.groupBy(*keys, "run_id").agg(F.first("k").alias("k"), F.count(F.lit(1)).alias("c"))
    return held.filter(F.col("c") >= min_rows).groupBy(*keys).agg(F.max("k").alias("plateau_k"))


def daily_rules(obs, keys=("city", "day"), min_minutes=20, step_minutes=5):
    """The seven rules. Value counts are a hash aggregate, only the plateau needs order."""
    keys = list(keys)
    k = F.bround("temp_f", 0).cast("long")
    counts = obs.groupBy(*keys, k.alias("k")).agg(
        F.count(F.lit(1)).alias("c"), F.max("temp_f").alias("mx"), F.max(via_celsius("temp_f")).alias("cf"))
    d = counts.groupBy(*keys).agg(
        F.max("mx").alias("mx"), F.max("k").alias("max_of_rounded"), F.max("cf").alias("c_first"),
        F.max(F.when(F.col("c") >= 2, F.col("k"))).alias("_rep"))
    d = d.join(plateau(obs, max(1, min_minutes // step_minutes), keys), keys, "left")
    top = F.col("max_of_rounded")
    return d.select(*keys, F.bround("mx", 0).cast("long").alias("max_round"), "max_of_rounded",
                    F.ceil("mx").alias("ceil_max"), F.floor("mx").alias("floor_max"),
                    F.coalesce("plateau_k", top).alias("plateau_20min"),
                    F.coalesce("_rep", top).alias("ignore_singletons"), "c_first")
