"""Ordered computations over long series without one task per key.

A key (city, ticker, source) may hold a third of all rows, so a plain
``Window.partitionBy(key).orderBy(ts)`` would put that third into one task.
Everything here works on (key, chunk) partitions, a chunk being a fixed slice
of time or of row numbers, and carries state between chunks through a table of
one row per (key, chunk). That table is bounded by the covered time range, not
by the number of rows.
"""

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.timeutil import HOUR, col

CHUNK_US = 6 * HOUR
CHUNK_ROWS = 500_000
EVEN_CHUNKS = 10_000
#: Rows that a task of a sorted window holds on average.
TASK_ROWS = 200_000
MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def time_chunk(us, width=CHUNK_US):
    return F.floor(col(us) / F.lit(width)).cast("long")


def even_chunk(df, pos, parts=EVEN_CHUNKS):
    """Chunk of an integer position: equal slices of its range, so that the carry table
    has at most ``parts`` rows per key however long the series grows. The range is one
    min/max aggregate over the source."""
    lo, hi = df.agg(F.min(pos), F.max(pos)).first()
    if lo is None:
        return F.lit(0).cast("long")
    return F.floor((col(pos) - F.lit(lo)) / F.lit((hi - lo) // parts + 1)).cast("long")


def value_chunk(df, x, rows, name="_band"):
    """``df`` with a chunk ``name`` by its column ``x``, for ``rows`` values that may lie close together:
    bands of about ``TASK_ROWS`` rows. Approximate quantiles place the borders, and nothing else
    depends on them; equal values share a band."""
    parts = -(-rows // TASK_ROWS)
    if parts <= 1:
        return df.withColumn(name, F.lit(0).cast("long"))
    q = QuantileDiscretizer(numBuckets=parts, relativeError=1 / (4 * parts), inputCol=x, outputCol=name).fit(df)
    return q.transform(df).withColumn(name, F.col(name).cast("long"))


def dealt(df, by, rows):
    """``df`` dealt by ``by`` into as many parts as keep a task at ``TASK_ROWS``, so that its memory
    does not grow with the table; as it is for a table of few rows or of unknown ``rows``."""
    if not rows or rows <= TASK_ROWS:
        return df
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(-(-rows // TASK_ROWS), least), *by)


def chunked(df, keys, chunk, rows=None):
    """Mark rows with their key (``_k``, equal also for NULL keys) and chunk (``_c``) and deal
    them by both, into parts of bounded size where the number of ``rows`` is known (``dealt``).
    Scans that are given ``"_c"`` as chunk reuse marks and shuffle.
    """
    k = F.struct(*keys) if keys else F.lit(0)
    d = df.withColumns({"_k": k, "_c": chunk})
    return dealt(d, ["_k", "_c"], rows) if rows and rows > TASK_ROWS else d.repartition("_k", "_c")


def unchunk(df):
    return df.drop("_k", "_c")


def prefix_scan(df, keys, order, chunk, specs, inclusive=True, rows=None):
    """Running aggregates per key in ``order``.

    ``specs`` maps an output name to (kind, column) with kind one of sum, count,
    max, min, xor, last, first, prev (last before this row) and next (first from this
    row on); the positional kinds skip NULLs. ``chunk`` must be monotonic in
    ``order``. With ``inclusive=False`` the row itself is left out, with a kind that ends
    in ``_before`` (``max_before``) from that output alone.

    The input is shuffled once, and read once: totals and windows share the exchange.
    ``rows``: number of rows, where known (see ``dealt``).
    """
    order = [col(o) for o in order]
    part = ["_k", "_c"]
    # One shuffle by (key, chunk) serves the chunk totals and the windows; a scan that is
    # given "_c" finds its rows dealt that way by the scan before.
    base = df if isinstance(chunk, str) else chunked(df, list(keys), chunk, rows)
    names = {n: f"_v{i}" for i, n in enumerate(specs)}
    base = base.withColumns({names[n]: col(c) for n, (_, c) in specs.items()})

    # A single ordering column keeps the partial aggregate on primitive buffers (hash, no sort).
    pos = order[0] if len(order) == 1 else F.struct(*order)
    lead_in = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    lead_out = Window.partitionBy("_k").orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy(*part).orderBy(*order)
    down = Window.partitionBy(*part).orderBy(*[o.desc() for o in order])
    partial, carried, running, final = [], [], {}, []
    for n, (kind, _) in specs.items():
        own = inclusive and not kind.endswith("_before")
        kind = kind.removesuffix("_before")
        to_here = up.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        v, t, i, p = F.col(names[n]), names[n], F.col("_i" + names[n]), F.col("_p" + names[n])
        at = F.when(v.isNotNull(), pos)
        if kind in ("last", "prev"):
            frame = to_here if kind == "last" else up.rowsBetween(Window.unboundedPreceding, -1)
            parts = F.max_by(v, at), F.last(v, True).over(lead_in), F.last(v, True).over(frame), F.coalesce(i, p)
        elif kind == "first":
            parts = F.min_by(v, at), F.first(v, True).over(lead_in), F.first(v, True).over(to_here), F.coalesce(p, i)
        elif kind == "next":
            # Read backwards, so that the frame grows row by row instead of being rescanned.
            here = down.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
            parts = F.min_by(v, at), F.last(v, True).over(lead_out), F.last(v, True).over(here), F.coalesce(i, p)
        elif kind == "count":
            parts = F.count(v), F.sum(v).over(lead_in), F.count(v).over(to_here), F.coalesce(i, F.lit(0)) + F.coalesce(p, F.lit(0))
        elif kind == "xor":
            zero = F.lit(0).cast("long")
            parts = F.bit_xor(v), F.bit_xor(v).over(lead_in), F.bit_xor(v).over(to_here), F.coalesce(i, zero).bitwiseXOR(F.coalesce(p, zero))
        else:
            f = MERGE[kind]
            joined = F.coalesce(i + p, i, p) if kind == "sum" else (F.greatest if kind == "max" else F.least)(i, p)
            parts = f(v), f(v).over(lead_in), f(v).over(to_here), joined
        partial.append(parts[0].alias(t))
        carried.append(parts[1].alias("_p" + t))
        running["_i" + t] = parts[2]
        final.append(parts[3].alias(n))

    totals = base.groupBy(*part).agg(*partial)
    carry = (dealt(totals, ["_k"], rows) if keys else totals).select(*part, *carried)
    out = base.withColumns(running).join(carry, part)
    kept = [c for c in df.columns if c not in specs]
    return out.select(*kept, *final)


def numbered(df, keys, order, chunk, name="rn"):
    """Dense 1-based row number per key."""
    return prefix_scan(df, keys, order, chunk, {name: ("count", F.lit(1))})


def row_lag(df, order, column, n, name):
    """Value ``n`` rows earlier in the whole series of a key; ``df`` comes from ``chunked``.

    A chunk hands on its last ``n`` values, and the ``n`` chunks before a chunk (none is
    empty) hold the values that its first rows need.
    """
    order = [col(o) for o in order]
    up = Window.partitionBy("_k", "_c").orderBy(*order)
    lead_in = Window.partitionBy("_k").orderBy("_c").rowsBetween(-n, -1)
    item = F.struct(F.struct(*order).alias("p"), col(column).alias("v"))
    d = df.withColumns({"_rn": F.row_number().over(up), "_lag": F.lag(column, n).over(up),
                        "_tail": F.when(F.lead(F.lit(1), n).over(up).isNull(), item)})
    carry = d.groupBy("_k", "_c").agg(F.array_sort(F.collect_list("_tail")).alias("_tails"))
    carry = carry.select("_k", "_c", F.flatten(F.collect_list("_tails").over(lead_in)).alias("_tails"))
    before = F.get("_tails", F.size("_tails") + F.col("_rn") - n - 1)["v"]
    d = d.join(carry, ["_k", "_c"]).withColumn(name, F.when(F.col("_rn") > n, F.col("_lag")).otherwise(before))
    return d.drop("_rn", "_lag", "_tail", "_tails")


def halo(df, pos, width=CHUNK_US, before=0, after=0):
    """Copy rows into neighbouring chunks so that frames never cross a chunk.

    Adds ``_c`` (chunk to compute in) and ``_core`` (row belongs there). With
    ``width`` well above ``before + after`` few rows are copied.
    """
    p = col(pos)
    lo = F.floor((p - after) / F.lit(width)).cast("long")
    hi = F.floor((p + before) / F.lit(width)).cast("long")
    own = F.floor(p / F.lit(width)).cast("long")
    return df.withColumn("_own", own).withColumn("_c", F.explode(F.sequence(lo, hi))).withColumn(
        "_core", F.col("_c") == F.col("_own")
    ).drop("_own")


def framed(df, keys, us, order, exprs, before, after=0, width=CHUNK_US, rows=None):
    """Window expressions whose frames look at most ``before``/``after`` in time.

    ``exprs`` receives a window over (keys, chunk) ordered by ``order`` and
    returns a dict of columns; it sets the frame itself. Rows are returned once.
    ``rows``: number of rows, where known (see ``dealt``).
    """
    w = Window.partitionBy(*keys, "_c").orderBy(*[col(o) for o in order])
    out = dealt(halo(df, us, width, before, after), [*keys, "_c"], rows).withColumns(exprs(w))
    return out.filter("_core").drop("_c", "_core")


def row_framed(df, keys, rn, exprs, before, after=0, size=CHUNK_ROWS):
    """As ``framed`` for frames counted in rows; ``rn`` is a dense row number."""
    w = Window.partitionBy(*keys, "_c").orderBy(rn)
    out = halo(df, rn, size, before, after).withColumns(exprs(w))
    return out.filter("_core").drop("_c", "_core")


def runs(df, keys, order, chunk, value, name="run_id"):
    """Number maximal runs of equal consecutive ``value`` per key (NULL = NULL)."""
    v = F.struct(col(value).alias("v"))
    prev = prefix_scan(chunked(df, keys, chunk), keys, order, "_c", {"_prev": ("last", v)}, inclusive=False)
    start = F.when(F.col("_prev").isNull() | ~F.col("_prev.v").eqNullSafe(col(value)), 1).otherwise(0)
    return unchunk(prefix_scan(prev.withColumn("_start", start), keys, order, "_c",
                               {name: ("sum", F.col("_start"))}).drop("_start", "_prev"))
