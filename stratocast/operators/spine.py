"""Snapshot grids."""

from pyspark.sql import functions as F

from ..functions.timeutil import DAY, HOUR, MINUTE, epoch_us


def event_spine(events, day, step_min=5, open_hour=10):
    """Every ``step_min`` minutes from D-1 ``open_hour`` to D 23:55 (456 rows at 5 min)."""
    d0 = epoch_us(F.col(day).cast("timestamp_ntz"))
    grid = F.sequence(d0 - DAY + open_hour * HOUR, d0 + 23 * HOUR + 55 * MINUTE, F.lit(step_min * MINUTE))
    return events.select("*", F.explode(grid).alias("us"))
