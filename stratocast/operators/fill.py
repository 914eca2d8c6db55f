"""Gap repair: carry-forward, interpolation, dense grids."""

from pyspark.sql import functions as F

from ..functions.timeutil import MINUTE, col
from .chunked import CHUNK_ROWS, numbered, prefix_scan, time_chunk


def locf(df, keys, us, tie, x, valid, out, flag):
    """Carry the last valid value over invalid rows; leading invalid rows stay as they are."""
    ok = F.when(valid, col(x))
    s = prefix_scan(df, keys, [us, tie], time_chunk(us), {"_carry": ("last", ok)})
    fill = ~valid & F.col("_carry").isNotNull()
    return s.withColumns({out: F.when(fill, F.col("_carry")).otherwise(col(x)), flag: fill.cast("int")}).drop("_carry")


def locf_except_bad_days(df, keys, day, us, tie, x, valid, max_bad_pct, out, flag, exclude):
    """LOCF on good days; invalid rows of bad days are excluded instead. The carry
    crosses bad days and their valid rows feed it."""
    bad = df.groupBy(*keys, day).agg((F.count_if(~valid) * 100.0 / F.count(F.lit(1)) >= max_bad_pct).alias("_bad"))
    s = locf(df.join(bad, [*keys, day]), keys, us, tie, x, valid, "_f", "_fl")
    fill = (F.col("_fl") == 1) & ~F.col("_bad")
    return s.withColumns({out: F.when(fill, F.col("_f")).otherwise(col(x)), flag: fill.cast("int"),
                          exclude: (~valid & F.col("_bad")).cast("int")}).drop("_f", "_fl", "_bad")


def fill_latest(df, keys, us, tie, x, since_us, out):
    """Every NULL at or after ``since_us`` gets the key's single newest real value."""
    last = df.filter(col(x).isNotNull()).groupBy(*keys).agg(F.max_by(x, F.struct(us, tie)).alias("_last"))
    return df.join(last, list(keys), "left").withColumn(
        out, F.when(col(us) >= since_us, F.coalesce(col(x), F.col("_last"))).otherwise(col(x))).drop("_last")


def sides(df, keys, rn, x, names=("_p", "_n")):
    """Nearest non-NULL (rn, value) at or before and at or after each row."""
    item = F.when(col(x).isNotNull(), F.struct(col(rn).alias("rn"), col(x).alias("v")))
    chunk = F.floor(col(rn) / F.lit(CHUNK_ROWS)).cast("long")
    return prefix_scan(df, keys, [rn], chunk, {names[0]: ("last", item), names[1]: ("next", item)})


def _between(rn):
    p, n = F.col("_p"), F.col("_n")
    w = (col(rn) - p["rn"]) / F.nullif(n["rn"] - p["rn"], F.lit(0))
    return F.coalesce(p["v"] + F.coalesce(w, F.lit(0.0)) * (n["v"] - p["v"]), p["v"], n["v"])


def interpolate_positional(points, curve, keys, us, curve_us, value, out):
    """Linear by position in the union of both time sets, ends held.

    Duplicate curve times are averaged. Weights count positions, not time.
    """
    c = curve.filter(col(value).isNotNull()).groupBy(*keys, col(curve_us).alias("_t")).agg(F.avg(value).alias("_v"))
    u = points.select(*keys, col(us).alias("_t")).distinct().join(c, [*keys, "_t"], "full")
    u = numbered(u, keys, ["_t"], time_chunk("_t"))
    u = sides(u, keys, "rn", "_v").select(*keys, "_t", _between("rn").alias(out))
    return points.join(u.withColumnRenamed("_t", us) if isinstance(us, str) else u, [*keys, us], "left")


def interpolate_small_gaps(df, keys, us, tie, x, out, limit=3):
    """Fill NULL runs from both sides, at most ``limit`` rows from each."""
    d = numbered(df, keys, [us, tie], time_chunk(us))
    d = sides(d, keys, "rn", x)
    near = ((F.col("rn") - F.col("_p.rn")) <= limit) | ((F.col("_n.rn") - F.col("rn")) <= limit)
    return d.withColumn(out, F.coalesce(col(x), F.when(F.coalesce(near, (F.col("rn") - F.col("_p.rn")) <= limit,
                                                                  (F.col("_n.rn") - F.col("rn")) <= limit), _between("rn")))).drop("_p", "_n", "rn")


def dense_grid(sparse, markets, key, prices, rank="source_rank", us="bucket_us", step=MINUTE):
    """Sparse to dense one-minute rows per market.

    Sources of one minute are merged column by column (first non-NULL by rank);
    the grid runs from the first to the last bar clamped to listing and close,
    prices are carried forward, volume is zero on synthetic rows.
    """
    m = sparse.groupBy(key, us).agg(
        *[F.min_by(p, F.when(F.col(p).isNotNull(), F.col(rank))).alias(p) for p in prices],
        F.min_by("volume", F.when(F.col("volume").isNotNull(), F.col(rank))).alias("volume"))
    span = m.groupBy(key).agg(F.min(us).alias("_lo"), F.max(us).alias("_hi")).join(
        markets.select(key, "listed_us", "close_us"), key, "left")
    fl = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(step))
    lo, hi = F.greatest("_lo", fl("listed_us")), F.least("_hi", fl("close_us"))
    grid = span.select(key, F.explode(F.when(lo <= hi, F.sequence(lo, hi, F.lit(step))).otherwise(
        F.sequence("_lo", "_hi", F.lit(step)))).alias(us))
    d = grid.join(m.withColumn("_real", F.lit(1)), [key, us], "left")
    d = prefix_scan(d, [key], [us], time_chunk(us), {p: ("last", p) for p in prices})
    return d.withColumns({"is_synthetic": F.col("_real").isNull().cast("int"),
                          "volume": F.coalesce("volume", F.lit(0)),
                          "has_trade": (F.coalesce("volume", F.lit(0)) > 0).cast("int")}).drop("_real")
