"""Statistics at given cutoffs, from one reduction of the rows between two of them.

A dense series has far more rows than cutoffs. Rows are therefore marked with the first cutoff
that sees them (a join of their time slice with the few cutoffs in it) and aggregated per mark,
map side first; whatever is ordered, merged or scanned afterwards has as many rows as there are
cutoffs, however many rows lie between them.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.timeutil import MINUTE, col
from ..session import written
from .chunked import CHUNK_US, halo
from .sliding import Edge, Extreme, Moments

#: Slice of time in which a row looks for its cutoff.
SLICE = 10 * MINUTE


def first_cutoff(rows, cuts, keys, us="us", inclusive=True, width=SLICE):
    """``rows`` with ``_cut``, the first of the cutoffs ``cuts._cut`` of the key at or after the row
    (after it, if not ``inclusive``); rows that no cutoff sees are left out."""
    keys, shift = list(keys), 0 if inclusive else 1
    # The last time that a cutoff sees, by slice; later slices without one look at the next.
    c = cuts.select(*keys, (F.col("_cut") - shift).alias("_e")).withColumn("_b", F.floor(F.col("_e") / width))
    c = c.groupBy(*keys, "_b").agg(F.array_sort(F.collect_set("_e")).alias("_es"))
    w = Window.partitionBy(*keys).orderBy("_b")
    c = c.withColumns({"_next": F.lead(F.col("_es")[0]).over(w), "_to": F.lead("_b").over(w) - 1})
    c = c.select(*keys, "_es", "_next", F.col("_b").alias("_own"), F.explode(F.sequence("_b", F.greatest("_b", "_to"))).alias("_b"))
    c = written(c.select(*keys, "_b", F.when(F.col("_b") == F.col("_own"), F.col("_es")).alias("_es"), "_next"), "cutoff-slices")
    lo = written(c.groupBy(*keys).agg(F.min("_b").alias("_lo")), "cutoff-first")
    r = rows.join(lo, keys).withColumn("_b", F.greatest(F.floor(col(us) / width), "_lo")).join(c, [*keys, "_b"])
    own = F.get(F.filter("_es", lambda e: e >= col(us)), F.lit(0))
    r = r.withColumn("_cut", F.coalesce(own, "_next") + shift)
    return r.where("_cut is not null").drop("_b", "_lo", "_es", "_next")


def frames_at(rows, at, keys, us, specs, width=CHUNK_US):
    """Trailing frames as of ``sliding`` at the times ``at`` (keys, ``us``) alone: one row per time,
    with one struct column for each of ``specs``. ``Edge`` means the earliest row.

    The borders of all frames cut the time of a key into pieces; a row counts in one piece, a frame
    is merged from whole pieces, second moments around the mean of the frame.
    """
    keys = list(keys)
    at = at.select(*keys, us).distinct()
    widths = sorted({m for m, _ in specs.values()})
    borders = F.array(F.col(us) + 1, *[F.col(us) - m * MINUTE for m in widths])
    r = first_cutoff(rows, at.select(*keys, F.explode(borders).alias("_cut")).distinct(), keys, us, inclusive=False)
    fields = {f"_{i}_{k}": v for i, (_, agg) in enumerate(specs.values()) for k, v in agg.parts(lambda a: a).items()}
    pieces = written(r.groupBy(*keys, "_cut").agg(*[v.alias(k) for k, v in fields.items()]), "frame-pieces")
    edges = {f"_{i}_v" for i, (_, agg) in enumerate(specs.values()) if isinstance(agg, Edge)}
    plain = [c for c in fields if c not in edges]
    schema = StructType([*[pieces.schema[k] for k in keys], StructField(us, LongType()), *[pieces.schema[c] for c in plain],
                         *[StructField(f"_begin{m}", LongType()) for m in widths]])
    moments = {m: [i for i, (n, agg) in enumerate(specs.values()) if n == m and isinstance(agg, Moments)] for m in widths}
    extremes = {m: [(i, agg.kind) for i, (n, agg) in enumerate(specs.values()) if n == m and isinstance(agg, Extreme)] for m in widths}

    def solve(marks, own):
        own = own.sort_values("_cut")
        ends, t, n = own["_cut"].to_numpy(), marks[us].to_numpy(), len(marks)
        value = {c: own[c].to_numpy(dtype=float, na_value=np.nan) for c in plain}
        out = {**{k: marks[k] for k in keys}, us: t}
        to = np.searchsorted(ends, t + 1, side="right")
        for m in widths:
            begin = np.searchsorted(ends, t - m * MINUTE, side="right")
            ids = moments[m]
            two = [j for j, i in enumerate(ids) if f"_{i}_y" in value]
            stack = lambda k, js: np.nan_to_num(np.column_stack([value[f"_{ids[j]}_{k}"] for j in js])) if js and len(own) else np.zeros((len(own), len(js)))
            every = range(len(ids))
            c, x, xx, y, xy = stack("n", every), stack("x", every), stack("xx", every), stack("y", two), stack("xy", two)
            got = {k: np.full((n, len(js)), np.nan) for k, js in (("n", ids), ("x", ids), ("xx", ids), ("y", two), ("xy", two))}
            tops = {i: np.full(n, np.nan) for i, _ in extremes[m]}
            for row in range(n):
                s = slice(begin[row], to[row])
                total = c[s].sum(0)
                share = c[s] / np.where(total > 0, total, np.nan)
                mean = (share * x[s]).sum(0)
                apart = x[s] - mean
                got["n"][row], got["x"][row], got["xx"][row] = total, mean, (share * (xx[s] + apart * apart)).sum(0)
                if two:
                    mean = (share[:, two] * y[s]).sum(0)
                    got["y"][row], got["xy"][row] = mean, (share[:, two] * (xy[s] + apart[:, two] * (y[s] - mean))).sum(0)
                for i, kind in extremes[m]:
                    v = value[f"_{i}_v"][s]
                    tops[i][row] = np.nansum(v) if kind == "sum" and not np.isnan(v).all() else (np.fmin if kind == "min" else np.fmax).reduce(v) if len(v) and kind != "sum" else np.nan
            for j, i in enumerate(ids):
                out.update({f"_{i}_n": got["n"][:, j].astype("int64"), f"_{i}_x": got["x"][:, j], f"_{i}_xx": got["xx"][:, j]})
            for j, of in enumerate(two):
                out.update({f"_{ids[of]}_y": got["y"][:, j], f"_{ids[of]}_xy": got["xy"][:, j]})
            out.update({f"_{i}_v": v for i, v in tops.items()})
            out[f"_begin{m}"] = ends[np.minimum(begin, len(ends) - 1)] if len(ends) else np.zeros(n, dtype="int64")
        return pd.DataFrame(out)[schema.names]

    near = halo(pieces.select(*keys, "_cut", *plain), "_cut", width, max(widths) * MINUTE, 1).drop("_core")
    marks = at.withColumn("_c", F.floor(F.col(us) / width).cast("long"))
    # A number of parts, as small parts would be put into one task, whose work is in Python.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks, near = marks.repartition(parts, *keys, "_c"), near.repartition(parts, *keys, "_c")
    d = marks.groupBy(*keys, "_c").cogroup(near.groupBy(*keys, "_c")).applyInPandas(solve, schema)
    for m in widths:
        # The earliest row of a frame lies in its first piece.
        held = [f"_{i}_v" for i, (n, agg) in enumerate(specs.values()) if n == m and isinstance(agg, Edge)]
        if held:
            d = d.join(pieces.select(*keys, F.col("_cut").alias(f"_begin{m}"), *held), [*keys, f"_begin{m}"], "left")
    structs = [F.struct(*[F.col(f"_{i}_{k}").alias(k) for k in agg.parts(lambda a: a)]).alias(name) for i, (name, (_, agg)) in enumerate(specs.items())]
    return d.select(*keys, us, *structs)
