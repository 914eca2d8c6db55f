"""Shape of a series so far: time and longest runs above a moving base, second maximum, steepest changes.

The base of a row is its rounded running maximum. It never falls, so a series is a
sequence of segments of equal base, and no row before a segment reaches its base (half-even
rounding leaves earlier maxima at least half a unit below). Counts and runs above the base
are therefore those of the segment, carried as running aggregates from its start; of one
below the base, those of the segment joined to the end of the segment before, if that had
just this base. All scans share one shuffle.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..session import written
from .chunked import CHUNK_US, chunked, prefix_scan, row_lag, time_chunk, unchunk


def running_shape(rows, keys, x, order=("us", "event_id"), step=5, plateau_rows=4, lag=6):
    """Columns of every row of ``rows``, from all rows of its key up to it:

    minutes_ge_base, minutes_ge_base_m1, minutes_ge_base_p1: rows at or above the base, one below and
    one above it, times ``step``; max_run_ge_base*: the longest unbroken run of such rows;
    max_minus_second_max; slope_max_30min_up_sofar and _down_: extreme changes over ``lag`` rows;
    pred_plateau_20min_sofar: highest rounded value held for ``plateau_rows`` rows, else the base;
    edge_max_flag: the first maximum lies in the first or last tenth. All are NULL where too few rows
    have been seen (two; ``lag`` + 1 for slopes; three for the flag).
    """
    keys, order = list(keys), list(order)
    v, n = F.col(x), F.col("_n")
    k = F.bround(v, 0).cast("long")
    scan = lambda d, specs: prefix_scan(d, keys, order, "_c", specs)
    d = row_lag(chunked(rows.where(v.isNotNull()), keys, time_chunk(order[0])), order, x, lag, "_lag_n")
    rise = v - F.col("_lag_n")
    d = scan(d, {"_n": ("count", v), "_m": ("max", v), "_m0": ("max_before", v), "_k0": ("prev", k),
                 "slope_max_30min_up_sofar": ("max", rise), "slope_max_30min_down_sofar": ("min", rise)}).drop("_lag_n", "_k", "_c")
    d = chunked(written(d, "shape-max"), keys, time_chunk(order[0]))
    d = d.withColumns({"_b": F.bround("_m", 0).cast("long"), "_b0": F.bround("_m0", 0).cast("long")})
    b, b0 = F.col("_b"), F.col("_b0")
    first = b0.isNull() | (b != b0)
    hit, hit1 = (v >= b).cast("int"), (v >= b - 1).cast("int")
    d = scan(d, {"_hits": ("sum", hit), "_hits1": ("sum", hit1), "_break": ("last", F.when(hit == 0, n)), "_break0": ("prev", F.when(hit == 0, n)),
                 "_break1": ("last", F.when(hit1 == 0, n)), "_start": ("last", F.when(first, n)), "_start0": ("prev", F.when(first, n)),
                 "_second": ("max", F.when(F.col("_m0").isNotNull(), F.least(v, "_m0"))), "_top": ("last", F.when(F.col("_m0").isNull() | (v > F.col("_m0")), n)),
                 "_held": ("last", F.when(F.col("_k0").isNull() | (k != F.col("_k0")), n))})
    d = written(d.drop("_k", "_c"), "shape-segments")
    # Hits before the segment, and before the segment that ended with the row before.
    before, before1 = F.when(first, F.col("_hits") - hit), F.when(first, F.col("_hits1") - hit1)
    d = chunked(d, keys, time_chunk(order[0]))
    d = scan(d, {"_base_hits": ("last", before), "_base_hits0": ("prev", before), "_base_hits1": ("last", before1),
                 "_plateau": ("max", F.when(n - F.col("_held") + 1 >= plateau_rows, k))})
    run = n - F.greatest("_break", F.col("_start") - 1)
    run1 = n - F.greatest("_break1", F.col("_start") - 1)
    unbroken = F.coalesce(F.col("_break1") < F.col("_start"), F.lit(True))
    # As the base never falls, the greatest (base, length) belongs to the present segment.
    best = lambda c: F.struct(b.alias("b"), c.alias("n"))
    d = scan(d, {"_run": ("max", best(run)), "_run0": ("max_before", best(run)), "_run1": ("max", best(run1)), "_lead": ("max", best(F.when(unbroken, run1).otherwise(0)))})
    d = chunked(written(d.drop("_k", "_c"), "shape-runs"), keys, time_chunk(order[0]))
    ended = F.struct((n - 1 - F.greatest("_break0", F.col("_start0") - 1)).alias("run"), F.col("_run0.n").alias("best"),
                     (F.col("_hits") - hit - F.col("_base_hits0")).alias("hits"))
    none = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("best"), F.lit(0).cast("long").alias("hits"))
    d = unchunk(scan(d, {"_past": ("last", F.when(first, F.when(b0 == b - 1, ended).otherwise(none)))}))
    two = lambda c: F.when(n >= 2, c)
    edge = F.greatest(F.lit(1), F.floor(n / 10))
    d = d.withColumns({
        "minutes_ge_base": two((F.col("_hits") - F.col("_base_hits")) * step), "max_run_ge_base": two(F.col("_run.n") * step),
        "minutes_ge_base_m1": two((F.col("_hits1") - F.col("_base_hits1") + F.col("_past.hits")) * step),
        "max_run_ge_base_m1": two(F.greatest("_run1.n", F.col("_lead.n") + F.col("_past.run"), "_past.best") * step),
        # One above the rounded maximum is above every row.
        "minutes_ge_base_p1": two(F.lit(0).cast("long")), "max_run_ge_base_p1": two(F.lit(0).cast("long")),
        "max_minus_second_max": F.col("_m") - F.col("_second"), "pred_plateau_20min_sofar": F.coalesce("_plateau", "_b"),
        "edge_max_flag": F.when(n >= 3, ((F.col("_top") <= edge) | (F.col("_top") > n - edge)).cast("int"))})
    return d.drop(*[c for c in d.columns if c.startswith("_") and c not in rows.columns])


SHAPE = ["minutes_ge_base", "minutes_ge_base_m1", "minutes_ge_base_p1", "max_run_ge_base", "max_run_ge_base_m1", "max_run_ge_base_p1", "max_minus_second_max",
         "slope_max_30min_up_sofar", "slope_max_30min_down_sofar", "pred_plateau_20min_sofar", "edge_max_flag"]


def shape_at(rows, keys, x, base, cut="_cut", order=("us", "event_id"), slot=CHUNK_US, step=5, plateau_rows=4, lag=6):
    """``running_shape`` at cutoffs alone: one row per key and cutoff ``cut`` that follows a row.

    Rows carry the first cutoff that sees them and ``base``, the rounded maximum of all rows up to it.
    The rows between two cutoffs, at most those of one ``slot`` of time, become one summary against
    that base: counts, first and last and longest runs, edges of six values. As no row before a rise
    of the base reaches it, summaries are joined in order with a state of fixed size.
    """
    keys = list(keys)
    us, tie = order
    kinds = {k: rows.schema[k] for k in keys}
    numbers = ["n", "top", "c0", "p0", "s0", "r0", "c1", "p1", "s1", "r1", "kf", "kfn", "kl", "kln", "held"]
    floats = ["mx", "second", "up", "down"]
    between = StructType([*kinds.values(), StructField(cut, LongType()), StructField("slot", LongType()), StructField("b", LongType()),
                          *[StructField(c, LongType()) for c in numbers], *[StructField(c, DoubleType()) for c in floats],
                          StructField("head", ArrayType(DoubleType())), StructField("tail", ArrayType(DoubleType()))])

    def runs_of(hit):
        """Count, first, last and longest run of a mask."""
        miss = np.flatnonzero(~hit)
        if not len(miss):
            return len(hit), len(hit), len(hit), len(hit)
        return int(hit.sum()), int(miss[0]), int(len(hit) - 1 - miss[-1]), int(np.diff(np.concatenate(([-1], miss, [len(hit)]))).max() - 1)

    def summarise(pdf):
        pdf = pdf.sort_values([us, tie])
        marks, values, bases = pdf[cut].to_numpy(), pdf[x].to_numpy(dtype=float), pdf["_base"].to_numpy()
        at = np.concatenate(([0], np.flatnonzero(np.diff(marks)) + 1, [len(marks)]))
        out = []
        for i, j in zip(at[:-1], at[1:]):
            v, b = values[i:j], int(bases[i])
            k = np.rint(v).astype("int64")
            turn = np.concatenate(([0], np.flatnonzero(np.diff(k)) + 1, [len(k)]))
            size = np.diff(turn)
            held = k[turn[:-1]][size >= plateau_rows]
            top = int(np.argmax(v))
            rest = np.delete(v, top)
            d = v[lag:] - v[:-lag] if len(v) > lag else v[:0]
            end = lambda f, a: float(f(a)) if len(a) else None
            out.append((*[pdf[c].iloc[0] for c in keys], int(marks[i]), int(pdf["_slot"].iloc[0]), b, len(v), top, *runs_of(v >= b), *runs_of(v >= b - 1),
                        int(k[0]), int(size[0]), int(k[-1]), int(size[-1]), int(held.max()) if len(held) else None,
                        float(v[top]), end(np.max, rest), end(np.max, d), end(np.min, d), v[:lag].tolist(), v[-lag:].tolist()))
        return pd.DataFrame({f.name: pd.Series([r[i] for r in out], dtype=object) for i, f in enumerate(between)})

    kind = {"max_minus_second_max": DoubleType(), "slope_max_30min_up_sofar": DoubleType(), "slope_max_30min_down_sofar": DoubleType(), "edge_max_flag": IntegerType()}
    result = StructType([*kinds.values(), StructField(cut, LongType()), *[StructField(c, kind.get(c, LongType())) for c in SHAPE]])

    def fold(pdf):
        pdf = pdf.sort_values([cut, "slot"])
        known = lambda v: None if v is None or v != v else v
        b = n = m = second = top = up = down = k = held = None
        runs, tail, kn, out = {0: (0, 0, 0), 1: (0, 0, 0)}, [], 0, {}
        for r in pdf.itertuples(index=False):
            if b is None:
                b, n = r.b, 0
            if r.b > b:
                runs = {0: (0, 0, 0), 1: runs[0] if r.b == b + 1 else (0, 0, 0)}
                b = r.b
            for i, (c, first, last, best) in enumerate(((r.c0, r.p0, r.s0, r.r0), (r.c1, r.p1, r.s1, r.r1))):
                count, open_, longest = runs[i]
                runs[i] = (count + c, open_ + r.n if first == r.n else last, max(longest, open_ + first, best))
            if m is None or r.mx > m:
                top = n + r.top + 1
            two = sorted((v for v in (m, second, r.mx, known(r.second)) if v is not None), reverse=True)[:2]
            m, second = two[0], two[1] if len(two) > 1 else None
            head = list(r.head)
            rises = [head[i] - tail[len(tail) + i - lag] for i in range(len(head)) if len(tail) + i >= lag]
            up = max((v for v in (up, known(r.up), *rises) if v is not None), default=None)
            down = min((v for v in (down, known(r.down), *rises) if v is not None), default=None)
            tail = (tail + list(r.tail))[-lag:]
            lead = r.kfn + (kn if r.kf == k else 0)
            held = max((v for v in (held, known(r.held), r.kf if lead >= plateau_rows else None) if v is not None), default=None)
            k, kn = r.kl, lead if r.kfn == r.n else r.kln
            n += r.n
            edge = max(1, n // 10)
            seen = lambda v: int(v) if n >= 2 else None
            out[getattr(r, "cutoff")] = (seen(runs[0][0] * step), seen(runs[1][0] * step), seen(0), seen(runs[0][2] * step), seen(runs[1][2] * step), seen(0),
                      m - second if second is not None else None, up, down, int(b if held is None else held), int(top <= edge or top > n - edge) if n >= 3 else None)
        first = [pdf[c].iloc[0] for c in keys]
        table = [(*first, at, *v) for at, v in out.items()]
        return pd.DataFrame({f.name: pd.Series([r[i] for r in table], dtype=object) for i, f in enumerate(result)})

    d = rows.select(*keys, cut, us, tie, x, F.col(base).alias("_base"), F.floor(F.col(us) / slot).alias("_slot")).where(F.col(x).isNotNull())
    # A number of parts, as small parts would be put into one task, whose work is in Python.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartition(parts, *keys, "_slot").groupBy(*keys, "_slot").applyInPandas(summarise, between)
    return d.repartition(parts, *keys).groupBy(*keys).applyInPandas(lambda pdf: fold(pdf.rename(columns={cut: "cutoff"}).assign(**{cut: pdf[cut]})), result)
