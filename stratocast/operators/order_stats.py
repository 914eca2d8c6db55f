"""Exact order statistics of a growing prefix, at given cutoffs.

Rows are counted per (value, first cutoff that sees them). Keys of a bounded number of such
counts are solved in one task each, by adding the counts of a cutoff and searching the
running totals. Of larger keys the distinct values are numbered, and the number is read
digit by digit from the top: at each level the counts of the 8 children of a node accumulate
over the cutoffs, every probe (cutoff, rank) picks the child that holds its rank and goes
down with the rest. A level is one shuffle of counts and probes by node; no prefix is ever
gathered or sorted again, and a probe costs one row per level. Both ways give equal results.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import written
from .chunked import prefix_scan, time_chunk
from .cutoffs import first_cutoff

DIGIT = 3
#: Counts of a key up to which one task solves it.
SMALL = 200_000


def linear(values, totals, ps):
    """Linear quantiles of sorted values with running totals of their counts."""
    pos = np.array(ps) * (totals[-1] - 1)
    at = lambda k: values[np.searchsorted(totals, k, side="right")]
    lo, hi = at(np.floor(pos)), at(np.ceil(pos))
    return lo + (pos - np.floor(pos)) * (hi - lo)


def running_quantiles(rows, cuts, keys, us, x, ps, inclusive=True, width=1.0, small=SMALL):
    """(keys, us, q) for every distinct cutoff with rows behind it: ``q`` holds the linear
    quantiles ``ps`` of all values ``x`` of the key up to the cutoff (before it, if not
    ``inclusive``). ``width``: values per chunk while distinct values are numbered; ``small``:
    counts up to which a key is solved in one task."""
    keys = list(keys)
    cuts = cuts.select(*keys, F.col(us).alias("_cut")).distinct()
    r = rows.select(*keys, F.col(us).alias("_us"), F.col(x).alias("_x")).where("_x is not null")
    return marked_quantiles(first_cutoff(r, cuts, keys, "_us", inclusive), cuts, keys, us, "_x", ps, width, small)


def marked_quantiles(rows, cuts, keys, us, x, ps, width=1.0, small=SMALL):
    """As ``running_quantiles`` for rows that carry ``_cut``, the first cutoff that sees them."""
    keys = list(keys)
    e = written(rows.groupBy(*keys, F.col(x).cast("double").alias("_x"), "_cut").agg(F.count(F.lit(1)).alias("_n")), "quantile-counts")
    large = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > small).drop("_size")
    if not large.limit(1).count():
        return in_one_task(e, cuts, keys, us, ps)
    large = written(large, "quantile-large")
    few = in_one_task(e.join(large, keys, "left_anti"), cuts, keys, us, ps)
    return few.unionByName(by_digits(e.join(large, keys, "left_semi"), cuts.join(large, keys, "left_semi"), keys, us, ps, width))


def in_one_task(e, cuts, keys, us, ps):
    """Quantiles of keys with a bounded number of counts."""
    schema = StructType([*[e.schema[k] for k in keys], StructField(us, cuts.schema["_cut"].dataType), StructField("q", ArrayType(DoubleType()))])

    def solve(counts, cutoffs):
        values, place = np.unique(counts["_x"].to_numpy(), return_inverse=True)
        at, n = counts["_cut"].to_numpy(), counts["_n"].to_numpy()
        order = np.argsort(at, kind="stable")
        at, place, n = at[order], place[order], n[order]
        so_far, done, out = np.zeros(len(values), dtype=np.int64), 0, []
        for cut in np.sort(cutoffs["_cut"].to_numpy()):
            end = np.searchsorted(at, cut, side="right")
            np.add.at(so_far, place[done:end], n[done:end])
            done = end
            if so_far.any():
                out.append((cut, linear(values, np.cumsum(so_far), ps).tolist()))
        first = {k: counts[k].iloc[0] for k in keys} if len(counts) else {}
        columns = {**{k: [first.get(k)] * len(out) for k in keys}, us: [c for c, _ in out], "q": [q for _, q in out]}
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})

    return e.groupBy(*keys).cogroup(cuts.groupBy(*keys)).applyInPandas(solve, schema)


def by_digits(e, cuts, keys, us, ps, width=1.0):
    """Quantiles of keys of any size, by descent over the digits of value numbers."""
    values = prefix_scan(e.select(*keys, "_x").distinct(), keys, ["_x"], F.floor(F.col("_x") / width), {"_r": ("count_before", F.lit(1))})
    values = written(values, "quantile-values")
    e = written(e.join(values, [*keys, "_x"]).select(*keys, "_cut", "_r", "_n"), "quantile-ranks")
    seen = cuts.join(e.groupBy(*keys, "_cut").agg(F.sum("_n").alias("_n")), [*keys, "_cut"], "left")
    seen = prefix_scan(seen, keys, ["_cut"], time_chunk("_cut"), {"_all": ("sum", "_n")}).where("_all > 0")

    def probe(i, p):
        pos = F.lit(float(p)) * (F.col("_all") - 1)
        at = lambda k, hi: F.struct(F.lit(i).alias("i"), F.lit(hi).alias("hi"), k.cast("long").alias("k"), (pos - F.floor(pos)).alias("share"))
        return [at(F.floor(pos), False), at(F.ceil(pos), True)]

    probes = seen.select(*keys, "_cut", F.explode(F.array(*[s for i, p in enumerate(ps) for s in probe(i, p)])).alias("_p"))
    probes = probes.select(*keys, "_cut", F.lit(0).cast("long").alias("_d"), F.col("_p.k").alias("_k_left"), F.struct("_p.i", "_p.hi", "_p.share").alias("_p"))
    probes = written(probes, "quantile-probes")
    top = e.agg(F.max("_r")).first()[0] or 0
    levels = max(1, -(-int(top).bit_length() // DIGIT))
    children = range(1 << DIGIT)
    for level in reversed(range(levels)):
        digit = F.shiftright("_r", level * DIGIT)
        child = digit.bitwiseAND(F.lit(len(children) - 1))
        counts = e.groupBy(*keys, F.shiftright(digit, DIGIT).alias("_d"), "_cut").agg(*[F.sum(F.when(child == j, F.col("_n"))).alias(f"_s{j}") for j in children])
        u = counts.withColumn("_q", F.lit(0)).unionByName(probes.withColumn("_q", F.lit(1)), allowMissingColumns=True)
        u = prefix_scan(u, [*keys, "_d"], ["_cut", "_q"], time_chunk("_cut"), {f"_s{j}": ("sum", f"_s{j}") for j in children}).where("_q = 1")
        zero = F.lit(0).cast("long")
        step = lambda a, s: F.when(a["go"] & (a["left"] >= s), F.struct((a["left"] - s).alias("left"), (a["child"] + 1).alias("child"), F.lit(True).alias("go"))).otherwise(
            F.struct(a["left"].alias("left"), a["child"].alias("child"), F.lit(False).alias("go")))
        found = F.aggregate(F.array(*[F.coalesce(f"_s{j}", zero) for j in children]), F.struct(F.col("_k_left").alias("left"), zero.alias("child"), F.lit(True).alias("go")), step)
        u = u.withColumn("_f", found)
        probes = written(u.select(*keys, "_cut", (F.col("_d") * len(children) + F.col("_f.child")).alias("_d"), F.col("_f.left").alias("_k_left"), "_p"), "quantile-probes")
    hit = probes.join(values.withColumnRenamed("_r", "_d"), [*keys, "_d"])
    at = lambda i, hi: F.max(F.when((F.col("_p.i") == i) & (F.col("_p.hi") == hi), F.col("_x")))
    share = lambda i: F.max(F.when(F.col("_p.i") == i, F.col("_p.share")))
    out = F.array(*[at(i, False) + share(i) * (at(i, True) - at(i, False)) for i in range(len(ps))])
    return hit.groupBy(*keys, F.col("_cut").alias(us)).agg(out.alias("q"))
