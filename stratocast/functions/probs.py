"""Class-probability arrays: expectations, intervals, bracket mass."""

from pyspark.sql import functions as F

from .timeutil import col


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def total(a):
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def expected(p, classes):
    return dot(col(p), F.transform(col(classes), lambda k: k.cast("double")))


def std(p, classes):
    """Root of E[k^2] - E[k]^2, floored at zero."""
    k = F.transform(col(classes), lambda x: x.cast("double"))
    m = dot(col(p), k)
    return F.sqrt(F.greatest(dot(col(p), F.transform(k, lambda x: x * x)) - m * m, F.lit(0.0)))


def mode(p, classes):
    """First most likely class."""
    return F.element_at(col(classes), F.array_position(col(p), F.array_max(col(p))).cast("int"))


def mass(p, classes, lo=None, hi=None):
    """Probability that a class lies in the closed range [lo, hi]."""
    def keep(x, k):
        ok = F.lit(True)
        if lo is not None:
            ok = ok & (k >= lo)
        if hi is not None:
            ok = ok & (k <= hi)
        return F.when(ok, x).otherwise(0.0)
    return total(F.zip_with(col(p), col(classes), keep))


def temp_map(p, classes, base):
    b = col(base)
    return F.map_from_arrays(F.transform(col(classes), lambda k: k + b), col(p))


def shortest_interval(p, classes, level):
    """Narrowest (lo, hi) class pair with mass >= level; the lowest start wins ties.

    The class list has a fixed length, so the pairs stay inside the row.
    """
    c, pv = col(classes), col(p)
    starts = F.sequence(F.lit(1), F.size(c))

    def reach(i):
        # First end whose running mass from i reaches the level, as (end, sum).
        run = F.aggregate(
            F.slice(pv, i, F.size(pv)), F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s")),
            lambda a, x: F.when(a["s"] >= level, a).otherwise(
                F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"))))
        end = F.when(run["s"] >= level, i + run["n"] - 1)
        lo, hi = F.element_at(c, i), F.element_at(c, F.coalesce(end, F.lit(1)))
        return F.when(end.isNotNull(), F.struct((hi - lo).alias("w"), i.alias("i"), lo.alias("lo"), hi.alias("hi")))

    best = F.array_min(F.filter(F.transform(starts, reach), lambda s: s.isNotNull()))
    full = F.struct((F.element_at(c, -1) - F.element_at(c, 1)).alias("w"), F.lit(1).alias("i"),
                    F.element_at(c, 1).alias("lo"), F.element_at(c, -1).alias("hi"))
    return F.coalesce(F.when(best["w"] < full["w"], best), full)


def monotone(cum):
    """Cumulative P(>=k) forced non-increasing: running maximum from the right."""
    rev = F.reverse(col(cum))
    up = F.aggregate(rev, F.array().cast("array<double>"), lambda acc, x: F.concat(
        acc, F.array(F.greatest(x, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0))))))
    return F.reverse(up)


def classes_from_cumulative(cum):
    """Class probabilities from monotone P(>=k), k=2..K: differences, clipped, normalised."""
    m = monotone(cum)
    hi = F.concat(F.array(F.lit(1.0)), m)
    lo = F.concat(m, F.array(F.lit(0.0)))
    d = F.zip_with(hi, lo, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    s = total(d)
    return F.transform(d, lambda x: x / s)


def normal_cdf(z):
    """Standard normal distribution function for z >= 0 by the rational
    approximation 26.2.17 of Abramowitz and Stegun (absolute error < 7.5e-8);
    negative z by symmetry. Spark has no error function."""
    z = col(z)
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = 0.3989422804014327 * F.exp(-x * x / 2) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def normal_cdf_array(z):
    """The same approximation over a numpy array."""
    import numpy as np
    x = np.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    upper = 0.3989422804014327 * np.exp(-x * x / 2) * np.polyval([1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530, 0.0], t)
    return np.where(z >= 0, 1 - upper, upper)


def edge_confidence(edge, unc_a, unc_b):
    """1 - 2 Phi(-|edge| / sqrt(a^2 + b^2)); one half when both are certain."""
    s = F.sqrt(col(unc_a) * col(unc_a) + col(unc_b) * col(unc_b))
    return F.when(s > 0, 1.0 - 2.0 * normal_cdf(-F.abs(col(edge)) / s)).otherwise(0.5)


def edge_signal(edge, confidence, threshold=1.5, min_confidence=0.6):
    e = col(edge)
    ok = (F.abs(e) >= threshold) & (col(confidence) >= min_confidence)
    return F.when(ok & (e > 0), "buy_high").when(ok, "buy_low").otherwise("no_trade")
