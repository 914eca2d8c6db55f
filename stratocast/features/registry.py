"""Registry of feature groups and the columns a model may use."""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from ..operators.asof import asof_many
from ..session import written

GROUPS = {}
KEY = ["city", "event_date"]

# The label classes and the non-numeric inputs.
DELTA_CLASSES = list(range(-12, 13))
CATEGORICAL = ["city", "month"]

# Column families that can be switched off by name prefix.
FAMILIES = {
    "forecast": ("fcst_", "obs_fcst", "above_fcst", "hours_until_fcst", "err_"),
    "lags": ("settle_f_lag", "vc_max_f_lag", "delta_vcmax"),
    "market": ("market_", "bid_", "volume_", "cumulative_volume", "has_recent_trade", "open_interest"),
    "momentum": ("temp_mean_last", "temp_std_last", "temp_max_last", "temp_rate_", "temp_acceleration", "temp_ema_",
                 "intraday_range", "minutes_since_max_observed"),
    "meteo": ("humidity_", "windspeed_", "cloudcover_", "wetbulb_", "windchill_", "cloud_regime", "cloud_stability",
              "clearing_trend", "clouding_trend", "high_wetbulb", "high_humidity", "strong_wind", "high_cloud", "clear_sky"),
}
# Never inputs: keys, labels and columns that contain the label.
EXCLUDED = ("city", "event_date", "us", "settle_f", "delta", "delta_obs", "err_label", "month")


def feature_group(name, kind="columns"):
    """Register a group.

    series   fn(ctx) -> as-of source of (city, event_date) rows
    cutoffs  fn(snapshots, ctx) -> one row per (city, event_date, us) of the snapshots
    event    fn(ctx) -> one row per (city, event_date)
    columns  fn(snapshots, ctx) -> snapshots with more columns
    """
    def add(fn):
        GROUPS[name] = (kind, fn)
        return fn
    return add


#: Groups that read the observations at the snapshots.
AT_CUTOFFS = {"trailing", "observed", "shape", "quantiles"}


def build(snapshots, ctx, names=None, owners=None):
    """Apply groups in order of kind: every series in one as-of join, then the event
    rows, then derived columns. Each series is written once before it is joined, so
    the plan of a build stays small. Sources that ``ctx`` lacks give NULL columns.
    A dict ``owners`` receives (group, kind) of every column that a group adds."""
    from .groups import at_cutoffs, complete
    ctx = complete(ctx, snapshots.sparkSession)
    names, owners = names or list(GROUPS), {} if owners is None else owners
    for n in names:
        if n not in GROUPS:
            raise KeyError(f"unknown feature group {n!r}; known: {sorted(GROUPS)}")
    pick = lambda kind: [(n, GROUPS[n][1]) for n in names if GROUPS[n][0] == kind]
    if AT_CUTOFFS & set(names):
        snapshots = written(snapshots, "snapshots")
        ctx = at_cutoffs(ctx, snapshots)

    def series(group):
        src = group[1](ctx)
        return src and replace(src, df=written(src.df.select(*needed(src)), f"series-{group[0]}"))

    # The series do not depend on each other: their jobs share the cluster.
    with ThreadPoolExecutor(6) as pool:
        waiting = [pool.submit(lambda g: written(g[1](snapshots, ctx), f"cutoffs-{g[0]}"), g) for g in pick("cutoffs")]
        sources = dict(zip([n for n, _ in pick("series")], pool.map(series, pick("series"))))
        cutoffs = [w.result() for w in waiting]
    sources = {n: src for n, src in sources.items() if src is not None}
    if sources:
        snapshots = asof_many(snapshots, list(sources.values()), KEY, "us")
    own = lambda columns, name: owners.update({c: (name, GROUPS[name][0]) for c in columns if c not in (*KEY, "us")})
    for n, src in sources.items():
        own(src.values, n)
    for (n, _), at in zip(pick("cutoffs"), cutoffs):
        own(at.columns, n)
        snapshots = snapshots.join(at, [*KEY, "us"], "left")
    for n, fn in pick("event"):
        rows = fn(ctx)
        own(rows.columns, n)
        snapshots = snapshots.join(rows, KEY, "left")
    for n, fn in pick("columns"):
        before = set(snapshots.columns)
        snapshots = fn(snapshots, ctx)
        own([c for c in snapshots.columns if c not in before], n)
    return snapshots


def needed(src):
    """Columns of a source that the as-of join reads."""
    return list(dict.fromkeys([*KEY, src.us, *([src.tie] if src.tie is not None else []), *src.values.values()]))


def prefixed(df, cols, prefix):
    return df.withColumnsRenamed({c: prefix + c for c in cols})


def feature_columns(df, **include):
    """(numeric, categorical) inputs; ``forecast=False`` etc. drops a family."""
    off = tuple(p for f, on in include.items() if not on for p in FAMILIES[f])
    num = [f.name for f in df.schema.fields
           if f.dataType.typeName() in ("double", "integer", "long", "float", "short")
           and f.name not in EXCLUDED and not (off and f.name.startswith(off))]
    return num, [c for c in CATEGORICAL if c in df.columns]
