"""Trading strategies as single plans over (city, event day) rows."""

from pyspark.sql import functions as F

from ..functions import trades as T
from ..functions.strikes import contains
from .brackets import join_bracket


def forecast_at_basis(fcst, offset=1):
    """Forecast high with lead = ``offset``, else the smallest available lead."""
    rank = F.struct((F.col("lead") != offset).cast("int").alias("a"), F.col("lead").alias("b"))
    return fcst.groupBy("city", "day").agg(
        F.min_by("tempmax_f", rank).alias("fcst_f"), F.min_by("lead", rank).alias("lead_used"))


def fixed_entry(fcst, settle, market, bias=0.0, entry=30.0, budget=100.0, offset=1):
    """Forecast + bias picks a bracket, bought at a fixed price and held to settlement."""
    f = forecast_at_basis(fcst, offset).withColumn("adj_f", F.bround(F.col("fcst_f") + bias, 0))
    pick = join_bracket(f, market, ["city", "day"], "adj_f",
                        ["ticker", "mkt", "strike_type", "floor_s", "cap_s"])
    t = pick.join(settle.select("city", "day", "settle_f"), ["city", "day"])
    n = T.contracts_for_budget(F.lit(entry), budget)
    t = t.withColumns({"entry": F.lit(entry), "n": n,
                       "won": contains("strike_type", "floor_s", "cap_s", "settle_f")})
    return t.withColumns({"fee_usd": T.taker_fee_usd("entry", "n"),
                          "pnl": T.held_pnl("entry", "n", "won") - T.taker_fee_usd("entry", "n")})


def run_metrics(trades, by):
    """Two-level aggregation: day totals, then run metrics per ``by``."""
    daily = trades.groupBy(*by, "day").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("pnl").alias("_p"), F.sum(F.col("pnl") * F.col("pnl")).alias("_pp"),
        F.sum(F.col("won").cast("int")).alias("_w"), F.sum(F.col("n") * F.col("entry") / 100).alias("_c"))
    n, p = F.sum("_n"), F.sum("_p")
    mean = p / n
    sd = F.sqrt(F.greatest((F.sum("_pp") - n * mean * mean) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)))
    dsd = F.stddev_samp("_p")
    return daily.groupBy(*by).agg(
        n.alias("n_trades"), p.alias("total_pnl"), mean.alias("avg_pnl"), (F.sum("_w") / n).alias("win_rate"),
        F.sum("_c").alias("wagered"), (p / F.sum("_c") * 100).alias("roi_pct"),
        F.when(sd > 0, mean / sd).alias("sharpe"), F.count(F.lit(1)).alias("n_days"),
        F.when(dsd > 0, F.avg("_p") / dsd).alias("daily_sharpe"))


def midnight(fcst, settle, market, candles, alpha, beta, budget=100.0):
    """Trend-adjusted path t0..t2 picks a bracket, bought at its first price of the day."""
    from .joins import lead_path
    p = lead_path(fcst).withColumnRenamed("basis", "day")
    t0, t1, t2 = F.col("t0"), F.coalesce("t1", "t0"), F.coalesce("t2", "t0")
    adj = t0 + alpha * ((t0 + t1 + t2) / 3 - t0) + beta * (F.greatest(t0, t1, t2) - F.least(t0, t1, t2))
    p = p.select("city", "day", adj.alias("adj_f"))
    pick = join_bracket(p, market, ["city", "day"], "adj_f", ["ticker", "mkt", "strike_type", "floor_s", "cap_s"], mode="half_open")
    first = candles.groupBy("mkt").agg(F.min_by("bid", "bucket_us").alias("entry"))
    t = pick.join(first, "mkt").join(settle.select("city", "day", "settle_f"), ["city", "day"])
    t = t.withColumns({"n": T.contracts_for_budget("entry", budget), "won": contains("strike_type", "floor_s", "cap_s", "settle_f", "half_open")})
    return t.withColumn("pnl", T.held_pnl("entry", "n", "won") - T.taker_fee_usd("entry", "n"))


def next_over(trades, market, candles, decision_us, tolerance, neighbour_min=50, own_max=30):
    """Exit a held bracket when its upper neighbour is dear and it is cheap at decision time."""
    from .asof import asof
    from .brackets import neighbours
    nb = neighbours(market, ["city", "day"], "mkt").select("mkt", F.col("up").alias("up_mkt"))
    t = trades.join(nb, "mkt", "left").withColumn("dec_us", decision_us)
    price = {"own": F.coalesce("bid_n", "ask")}
    t = asof(t, candles, ["mkt"], "dec_us", "bucket_us", price, tolerance=tolerance, matched="_o")
    r = candles.withColumnRenamed("mkt", "up_mkt")
    t = asof(t, r, ["up_mkt"], "dec_us", "bucket_us", {"neighbour": F.coalesce("bid_n", "ask")}, tolerance=tolerance, matched="_u")
    exit_ = F.coalesce((F.col("neighbour") >= neighbour_min) & (F.col("own") <= own_max), F.lit(False))
    t = t.withColumn("exited", exit_.cast("int"))
    return t.withColumn("pnl", F.when(exit_, T.exit_pnl("entry", "own", "n") - T.taker_fee_usd("own", "n")).otherwise(F.col("pnl"))).drop("_o", "_u")


def curve_gap(trades, market, obs, curve, decision_hour, avg_min=15, slope_min=60, gap=1.5, slope=0.5, max_shift=1, min_points=3):
    """Shift up when observations run above the forecast curve and are rising."""
    from ..functions.timeutil import HOUR, MINUTE
    from .asof import interpolate_at
    from .brackets import neighbours
    k = ["city", "day"]
    d = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * 24 * HOUR + decision_hour * HOUR
    o = obs.withColumn("_d", d).filter((F.col("us") <= F.col("_d")) & (F.col("us") >= F.col("_d") - max(avg_min, slope_min) * MINUTE))
    near = F.when(F.col("us") >= F.col("_d") - avg_min * MINUTE, F.col("temp_f"))
    x = F.when(F.col("us") >= F.col("_d") - slope_min * MINUTE, (F.col("us") - F.col("_d")) / F.lit(float(HOUR)))
    s = o.groupBy(*k).agg(F.avg(near).alias("obs_f"), F.count(near).alias("n_points"), F.coalesce(F.regr_slope("temp_f", x), F.lit(0.0)).alias("slope"))
    t = trades.join(s, k, "left").withColumn("dec_us", d)
    t = interpolate_at(t, curve, k, "dec_us", "us", "temp_f", "fcst_at")
    hit = F.coalesce((F.col("n_points") >= min_points) & (F.col("obs_f") - F.col("fcst_at") >= gap) & (F.col("slope") >= slope), F.lit(False))
    m = neighbours(market, k).select(*k, "idx", "total", F.col("mkt").alias("mkt"))
    t = t.join(m, [*k, "mkt"], "left")
    shift = F.when(hit, F.least(F.lit(max_shift), F.col("total") - F.col("idx") - 1)).otherwise(0)
    t = t.withColumn("new_idx", F.col("idx") + shift)
    to = neighbours(market, k).select(*k, F.col("idx").alias("new_idx"), F.col("ticker").alias("new_ticker"),
                                      F.struct("strike_type", "floor_s", "cap_s").alias("_m"))
    t = t.join(to, [*k, "new_idx"], "left")
    t = t.withColumn("won", contains("_m.strike_type", "_m.floor_s", "_m.cap_s", "settle_f")).withColumn("shifted", shift)
    return t.withColumn("pnl", T.held_pnl("entry", "n", "won") - T.taker_fee_usd("entry", "n")).drop("_m")


def param_sweep(fcst, settle, market, grid, cutoff):
    """Every parameter set on every event in one plan; best on train days, scored on test days.

    ``grid`` is a literal list of (id, bias, entry, offset); it lives in an array
    inside the event row, so no join multiplies anything.
    """
    g = F.explode(F.array(*[F.struct(F.lit(i).alias("pid"), F.lit(float(b)).alias("bias"), F.lit(float(e)).alias("entry"),
                                     F.lit(o).alias("offset")) for i, b, e, o in grid]))
    offs = sorted({o for *_, o in grid})
    f = None
    for o in offs:
        d = forecast_at_basis(fcst, o).withColumn("offset", F.lit(o))
        f = d if f is None else f.unionByName(d)
    ev = f.groupBy("city", "day").agg(F.map_from_entries(F.collect_list(F.struct("offset", "fcst_f"))).alias("_f"))
    ev = ev.select("city", "day", "_f", g.alias("g")).select("city", "day", "g.*", F.col("_f")[F.col("g.offset")].alias("fcst_f"))
    ev = ev.withColumn("adj_f", F.bround(F.col("fcst_f") + F.col("bias"), 0))
    pick = join_bracket(ev, market, ["city", "day"], "adj_f", ["strike_type", "floor_s", "cap_s"])
    t = pick.join(settle.select("city", "day", "settle_f"), ["city", "day"])
    t = t.withColumn("n", F.greatest(F.floor(100.0 / (F.col("entry") / 100)), F.lit(1)))
    t = t.withColumn("won", contains("strike_type", "floor_s", "cap_s", "settle_f"))
    t = t.withColumn("pnl", T.held_pnl("entry", "n", "won") - T.taker_fee_usd("entry", "n"))
    train = F.col("day") < F.lit(cutoff).cast("date")
    s = t.groupBy("pid", "bias", "entry", "offset").agg(
        F.count_if(train).alias("n_train"), F.sum(F.when(train, F.col("pnl")).otherwise(0.0)).alias("train_pnl"),
        F.count_if(~train).alias("n_test"), F.sum(F.when(~train, F.col("pnl")).otherwise(0.0)).alias("test_pnl"))
    best = s.agg(F.max_by("pid", F.struct(F.round("train_pnl", 6), -F.col("pid"))).alias("_b"))
    return s.withColumn("best", (F.col("pid") == best.scalar()).cast("int"))
