"""Trailing time frames, from mergeable partials where rows are dense.

While no minute of a key holds many rows, a frame is aggregated directly by a window. Beyond
that its cost would grow with rows times rows, so frames are put together from partials (with
equal results): a frame of n minutes ending at a row is cut at two minute borders: the end of the minute in
which it begins, the whole minutes between, and the beginning of the row's own minute. The
last is a running aggregate; the whole minutes are merged once per minute from one partial
each; and the first is a running aggregate, read backwards, over the rows of that earlier
minute, which are dealt to the row's minute and interleaved by their place in it. So a row
costs a constant number of merges at any density, a minute at most n, and no task holds
more than the rows of a minute of one key and of the minutes its frames begin in.
"""

from copy import copy

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.timeutil import MINUTE, col
from .chunked import dealt, framed

#: Rows of a minute and key up to which frames are aggregated directly.
SPARSE = 16


class Moments:
    """Count, means and centred second moments of one or two columns; merged without cancellation."""

    def __init__(self, x, y=None):
        self.x, self.y = x, y

    def parts(self, over):
        """Named aggregates of one piece; ``over`` places them in a group or a window."""
        x, y = self.x, self.y
        if y is None:
            return {"n": over(F.count(x)), "x": over(F.avg(x)), "xx": over(F.var_pop(x))}
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        return {"n": over(F.count(x)), "x": over(F.avg(x)), "xx": over(F.var_pop(x)), "y": over(F.avg(y)), "xy": over(F.covar_pop(x, y))}

    def merge(self, a, b):
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        n = F.coalesce(a["n"], F.lit(0)) + F.coalesce(b["n"], F.lit(0))
        share = F.coalesce(b["n"], F.lit(0)) / F.nullif(n, F.lit(0))
        both = lambda k: zero(a[k]) * (1 - share) + zero(b[k]) * share
        apart = lambda k: zero(b[k]) - zero(a[k])
        out = {"n": n, "x": both("x"), "xx": both("xx") + apart("x") * apart("x") * share * (1 - share)}
        if self.y is not None:
            out.update({"y": both("y"), "xy": both("xy") + apart("x") * apart("y") * share * (1 - share)})
        return out


class Extreme:
    """Largest, smallest or summed value; NULLs do not count."""

    def __init__(self, kind, x):
        self.kind, self.x = kind, x

    def parts(self, over):
        return {"v": over({"max": F.max, "min": F.min, "sum": F.sum}[self.kind](self.x))}

    def merge(self, a, b):
        if self.kind == "sum":
            return {"v": F.coalesce(a["v"] + b["v"], a["v"], b["v"])}
        return {"v": (F.greatest if self.kind == "max" else F.least)(a["v"], b["v"])}


class Edge:
    """Value of the earliest (or latest) row of the frame; of equal times the least (largest).

    With ``known`` rows without a value do not count.
    """

    def __init__(self, x, us, last=False, known=False):
        x = col(x)
        item = F.struct(col(us).alias("at"), x.alias("v"))
        self.x, self.last = (F.when(x.isNotNull(), item) if known else item), last

    def parts(self, over):
        return {"v": over((F.max if self.last else F.min)(self.x))}

    def merge(self, a, b):
        return {"v": (F.greatest if self.last else F.least)(a["v"], b["v"])}


def density(df, keys, us):
    """Most rows of a minute and key, and all rows: one count by key and minute."""
    most, rows = df.groupBy(*keys, F.floor(col(us) / MINUTE).alias("_m")).count().agg(F.max("count"), F.sum("count")).first()
    return most or 0, rows or 0


def dense(df, keys, us, rows=SPARSE):
    """Whether some minute of a key holds over ``rows`` rows."""
    return density(df, keys, us)[0] > rows


def sliding(df, keys, us, specs, own=True, partials=None):
    """Rows of ``df`` with one struct column for each of ``specs``: name -> (minutes, aggregate).

    A frame covers [t - minutes, t] with all rows of equal time; with ``own=False`` it ends
    before t. ``partials``: whether to merge partials, None to decide by ``dense``.
    """
    most, rows = density(df, keys, us) if partials is None else (0, None)
    if most > SPARSE if partials is None else partials:
        return from_partials(df, keys, us, specs, own, rows)

    def frames(w):
        out = {}
        for name, (m, agg) in specs.items():
            f = w.rangeBetween(-m * MINUTE, 0 if own else -1)
            out[name] = F.struct(*[v.alias(k) for k, v in agg.parts(lambda a, f=f: a.over(f)).items()])
        return out

    return framed(df, keys, us, [us], frames, max(m for m, _ in specs.values()) * MINUTE, rows=rows)


def from_partials(df, keys, us, specs, own=True, rows=None):
    keys = list(keys)
    t = col(us)
    widths = sorted({m for m, _ in specs.values()})
    minute, place = F.floor(t / MINUTE).cast("long"), F.pmod(t, F.lit(MINUTE))
    base = df.withColumn("_m", minute)
    # Whole minutes: those between the first and the own one.
    per_minute = base.groupBy(*keys, "_m").agg(*[F.struct(*[v.alias(k) for k, v in agg.parts(lambda a: a).items()]).alias(f"_w{i}") for i, (_, agg) in enumerate(specs.values())])
    # A minute's frames are merged from the minutes before it, at most one partial each.
    order = Window.partitionBy(*keys).orderBy("_m")
    lists = {f"_l{i}": F.collect_list(f"_w{i}").over(order.rangeBetween(-(m - 1), -1)) for i, (m, _) in enumerate(specs.values())}
    whole = per_minute.withColumns(lists).select(*keys, "_m", *[merged(agg, f"_l{i}", per_minute.schema[f"_w{i}"].dataType).alias(f"_w{i}") for i, (_, agg) in enumerate(specs.values())])
    # Each row stands in its own minute and, for every width, in the one whose frames begin in its minute.
    copies = F.explode(F.array(F.lit(0), *[F.lit(m) for m in widths]))
    d = base.withColumn("_back", copies).withColumns({"_m": F.col("_m") + F.col("_back"), "_at": place})
    d = dealt(d, [*keys, "_m"], rows and rows * (1 + len(widths)))
    part = Window.partitionBy(*keys, "_m").orderBy("_at")
    up = part.rangeBetween(Window.unboundedPreceding, 0 if own else -1)
    down = Window.partitionBy(*keys, "_m").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
    pieces = {}
    for i, (m, agg) in enumerate(specs.values()):
        for name, back, w in ((f"_p{i}", 0, up), (f"_s{i}", m, down)):
            here = only(agg, F.col("_back") == back)
            pieces[name] = F.struct(*[v.alias(k) for k, v in here.parts(lambda a, w=w: a.over(w)).items()])
    d = d.withColumns(pieces).where("_back = 0").join(whole, [*keys, "_m"])
    # Two merges in two projections: one inside the other would repeat its inputs many times.
    fields = lambda agg, c: {k: F.col(c)[k] for k in agg.parts(lambda a: a)}
    whole_of = lambda agg, a, b: F.struct(*[v.alias(k) for k, v in agg.merge(fields(agg, a), fields(agg, b)).items()])
    d = d.withColumns({f"_j{i}": whole_of(agg, f"_s{i}", f"_w{i}") for i, (_, agg) in enumerate(specs.values())})
    return d.select(*df.columns, *[whole_of(agg, f"_j{i}", f"_p{i}").alias(name) for i, (name, (_, agg)) in enumerate(specs.items())])


def only(agg, condition):
    """The aggregate over the rows that meet a condition."""
    if isinstance(agg, Moments):
        return Moments(F.when(condition, agg.x), None if agg.y is None else F.when(condition, agg.y))
    out = copy(agg)
    out.x = F.when(condition, agg.x)
    return out


def merged(agg, partials, kind):
    """One partial from a list of them, in the order of time."""
    fields = [f.name for f in kind]
    cast = lambda parts: F.struct(*[parts[k].cast(kind[k].dataType).alias(k) for k in fields])
    none = F.lit(None).cast(kind)
    join = lambda a, b: F.when(a.isNull(), b).otherwise(cast(agg.merge({k: a[k] for k in fields}, {k: b[k] for k in fields})))
    return F.aggregate(partials, none, join)


def std(s):
    """Sample deviation, NULL below two rows."""
    return F.when(s["n"] > 1, F.sqrt(F.greatest(s["xx"], F.lit(0.0)) * s["n"] / (s["n"] - 1)))


def slope(s, still=0.001):
    """Sample covariance over population variance of time (x), per hour; NULL below two rows.

    0 where the deviation of time (minutes) is below ``still``; with None every spread counts,
    and rows of one time have no slope: NaN, as 0 / 0 is in SQL.
    """
    flat = F.when(s["xx"] == 0, float("nan")) if still is None else F.when(F.sqrt(s["xx"]) < still, 0.0)
    return F.when(s["n"] >= 2, flat.otherwise(s["xy"] * s["n"] / (s["n"] - 1) / F.nullif(s["xx"], F.lit(0.0)) * 60))
