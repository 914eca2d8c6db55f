"""As-of joins: one shuffle of the union of both sides on (keys, time chunk).

Both sides are interleaved by time and the newest right row is carried
forward; the carry between chunks is one row per (key, chunk). There is no
range join, so neither side is ever multiplied or broadcast.
"""

from dataclasses import dataclass
from typing import Any

from pyspark.sql import functions as F

from ..functions.timeutil import col
from .chunked import CHUNK_US, prefix_scan, time_chunk


@dataclass
class Source:
    """Right side of an as-of join: time column, output name -> column, tie-break."""
    df: Any
    us: str
    values: dict
    tie: Any = None
    inclusive: bool = True


def _interleave(left, sources, keys, left_us):
    """Union of left rows and every source; at equal times inclusive sources come first."""
    keys = list(keys)
    empty = [F.lit(None).alias(f"_r{i}") for i in range(len(sources))]
    u = left.select(*keys, col(left_us).alias("_t"), F.lit(1).alias("_s"), F.lit(None).cast("long").alias("_tie"),
                    F.struct(*[F.col(c) for c in left.columns]).alias("_l"), *empty)
    for i, src in enumerate(sources):
        # As in SQL, a NULL key matches nothing.
        known = col(src.us).isNotNull()
        for k in keys:
            known = known & F.col(k).isNotNull()
        item = F.struct(col(src.us).alias("_us"), *[col(c).alias(n) for n, c in src.values.items()])
        r = src.df.filter(known).select(
            *keys, col(src.us).alias("_t"), F.lit(0 if src.inclusive else 2).alias("_s"),
            (col(src.tie).cast("long") if src.tie is not None else F.lit(0).cast("long")).alias("_tie"),
            F.lit(None).alias("_l"), *[item.alias(f"_r{j}") if j == i else F.lit(None).alias(f"_r{j}") for j in range(len(sources))])
        u = u.unionByName(r)
    return u


ORDER = ["_t", "_s", "_tie"]


def asof_many(left, sources, keys, left_us, width=CHUNK_US):
    """Newest row of every source at or before each left row, in a single shuffle."""
    u = _interleave(left, sources, keys, left_us)
    s = prefix_scan(u, keys, ORDER, time_chunk("_t", width), {f"_m{i}": ("last", f"_r{i}") for i in range(len(sources))})
    s = s.filter("_s = 1").select("_l.*", *[f"_m{i}" for i in range(len(sources))])
    return s.select(*left.columns, *[F.col(f"_m{i}.{n}").alias(n) for i, src in enumerate(sources) for n in src.values])


def asof(left, right, keys, left_us, right_us, values, tie=None, tolerance=None,
         inclusive=True, direction="backward", width=CHUNK_US, matched="match_us"):
    """Attach to each left row the right row nearest in time on one side.

    ``values`` maps output names to right columns. Equal right times are
    resolved by the highest ``tie`` column (backward) or the lowest (forward).
    Unmatched left rows keep NULLs.
    """
    back = direction == "backward"
    # Rows that must be reachable at an equal time stand before (backward) or after (forward) the left row.
    src = Source(right, right_us, values, tie, inclusive if back else not inclusive)
    u = _interleave(left, [src], keys, left_us)
    s = prefix_scan(u, keys, ORDER, time_chunk("_t", width), {"_m": ("last" if back else "next", "_r0")})
    m = F.col("_m")
    if tolerance is not None:
        m = F.when(F.abs(F.col("_m._us") - F.col("_t")) <= F.lit(tolerance), m)
    s = s.filter("_s = 1").select("_l.*", m.alias("_m"))
    return s.select(*left.columns, F.col("_m._us").alias(matched), *[F.col(f"_m.{n}").alias(n) for n in values])


def _both(left, right, keys, left_us, right_us, values, tie, width):
    """Left rows with the right row at or before (``_b``) and the one after (``_f``)."""
    u = _interleave(left, [Source(right, right_us, values, tie)], keys, left_us)
    s = prefix_scan(u, keys, ORDER, time_chunk("_t", width), {"_b": ("last", "_r0"), "_f": ("next", "_r0")})
    return s.filter("_s = 1").select("_l.*", "_t", "_b", "_f")


def asof_nearest(left, right, keys, left_us, right_us, values, window, tie=None, width=CHUNK_US):
    """Nearest right row within ``window`` on either side; the earlier one wins a tie."""
    d = _both(left, right, keys, left_us, right_us, values, tie, width)
    b, f, t = F.col("_b._us"), F.col("_f._us"), F.col("_t")
    m = F.when(b.isNull() | ((f - t) < (t - b)), F.col("_f")).otherwise(F.col("_b"))
    d = d.withColumn("_m", m).withColumn("_m", F.when(F.abs(F.col("_m._us") - t) <= F.lit(window), F.col("_m")))
    return d.select(*left.columns, F.col("_m._us").alias("match_us"), *[F.col(f"_m.{n}").alias(n) for n in values])


def interpolate_at(left, curve, keys, left_us, curve_us, value, out, width=CHUNK_US):
    """Linear interpolation of a sparse curve at arbitrary times, ends held."""
    d = _both(left, curve.filter(col(value).isNotNull()), keys, left_us, curve_us, {"v": value}, None, width)
    b, f = F.col("_b"), F.col("_f")
    w = (F.col("_t") - b["_us"]) / (f["_us"] - b["_us"])
    y = F.coalesce(b["v"] + w * (f["v"] - b["v"]), b["v"], f["v"])
    return d.select(*left.columns, y.alias(out))
