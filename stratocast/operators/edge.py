"""Implied values, edges and trade selection per snapshot."""

from pyspark.sql import functions as F

from ..functions import probs as P
from ..functions import trades as T
from ..functions.timeutil import col


def forecast_implied(df, p="p", classes="classes", base="t_base"):
    """Implied value, spread and most likely class of a probability vector."""
    q = F.transform(col(p), lambda x: x / P.total(col(p)))
    d = df.withColumn("_q", q)
    return d.withColumns({"fcst_implied": col(base) + P.expected("_q", classes), "fcst_unc": P.std("_q", classes),
                          "pred_delta": P.mode("_q", classes)}).drop("_q")


def survival(quotes, keys, threshold, bid, ask):
    """Bracket prices of one event read as survival probabilities.

    Adds sorted thresholds, mid prices, spreads and the normalised differences
    (below the first, between neighbours, above the last). The arrays hold the
    few brackets of one event.
    """
    item = F.struct(col(threshold).alias("t"), ((col(bid) / 100.0 + col(ask) / 100.0) / 2.0).alias("m"),
                    (col(ask) / 100.0 - col(bid) / 100.0).alias("s"))
    d = quotes.filter(col(threshold).isNotNull() & col(bid).isNotNull() & col(ask).isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_list(item)).alias("_b"))
    m = F.transform("_b", lambda b: b["m"])
    hi = F.concat(F.array(F.lit(1.0)), m)
    lo = F.concat(m, F.array(F.lit(0.0)))
    d = d.withColumn("_d", F.zip_with(hi, lo, lambda a, b: F.greatest(a - b, F.lit(0.0))))
    return d.withColumn("probs", F.transform("_d", lambda x: x / P.total(F.col("_d")))).drop("_d")


def market_implied(quotes, keys, threshold="floor_s", bid="bid", ask="ask"):
    """Expected value over bracket midpoints (tails one unit out) and twice the mean spread."""
    d = survival(quotes, keys, threshold, bid, ask)
    t = F.transform("_b", lambda b: b["t"])
    first, last = F.element_at(t, 1) - 1.0, F.element_at(t, -1) + 1.0
    inner = F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t)), lambda a, b: (a + b) / 2.0)
    mids = F.concat(F.array(first), inner, F.array(last))
    spread = P.total(F.transform("_b", lambda b: b["s"])) / F.size("_b")
    return d.withColumns({"mkt_implied": P.dot(mids, F.col("probs")), "mkt_unc": spread * 2.0,
                          "n_brackets": F.size("_b")}).drop("_b", "probs")


def with_edge(df, forecast, market, f_unc, m_unc, threshold=1.5, min_confidence=0.6):
    d = df.withColumn("edge", col(forecast) - col(market))
    d = d.withColumn("confidence", P.edge_confidence("edge", f_unc, m_unc))
    return d.withColumn("signal", P.edge_signal("edge", "confidence", threshold, min_confidence))


def select_bracket(signals, brackets, keys, forecast, signal="signal", threshold="floor_s", label="ticker"):
    """buy_high: highest threshold at or below the forecast, else the lowest bracket;
    buy_low: lowest at or above, else the highest."""
    b = brackets.filter(col(threshold).isNotNull()).select(*keys, col(threshold).alias("_t"), col(label).alias("_n"))
    j = signals.filter(col(signal) != "no_trade").join(b, list(keys))
    t, n, f = F.col("_t"), F.col("_n"), col(forecast)
    high = F.coalesce(F.max_by(n, F.when(t <= f, t)), F.min_by(n, t))
    low = F.coalesce(F.min_by(n, F.when(t >= f, t)), F.max_by(n, t))
    return j.groupBy(*signals.columns).agg(high.alias("_h"), low.alias("_l")).select(
        *signals.columns, F.when(col(signal) == "buy_high", F.col("_h")).otherwise(F.col("_l")).alias("picked"))


def best_bracket(quotes, keys, prob, label, fill_prob=0.4, min_ev=3.0, bid="bid", ask="ask"):
    """Best trade of all brackets of a snapshot by EV; the lowest label wins ties."""
    d = quotes.withColumn("_t", T.best_trade(prob, bid, ask, min_ev, fill_prob)).filter("_t IS NOT NULL")
    pick = F.struct(F.col("_t.ev").alias("ev"), col(label).alias(label), F.col("_t.action").alias("action"),
                    F.col("_t.price").alias("price"), F.col("_t.role").alias("role"))
    return d.groupBy(*keys).agg(F.min_by(pick, F.struct((-F.col("_t.ev")).alias("e"), col(label).alias("l"))).alias("_p")).select(*keys, "_p.*")


def strike_mass(p, classes, base, kind, floor, cap):
    """Mass of a bracket under integer strike semantics."""
    b = col(base)
    lo = F.when(col(kind) == "between", col(floor)).when(col(kind) == "greater", col(floor) + 1).otherwise(F.lit(-1e9)) - b
    hi = F.when(col(kind) == "between", col(cap)).when(col(kind) == "less", col(cap)).otherwise(F.lit(1e9)) - b
    return P.mass(p, classes, lo, hi)


# Horizon edges in hours with size and edge multipliers.
HORIZON = [(2.0, 1.0, 1.0), (6.0, 0.5, 1.2), (12.0, 0.25, 1.5), (18.0, 0.15, 2.0), (None, 0.08, 2.5)]


def _horizon(hours, i):
    e = None
    for row in HORIZON:
        if row[0] is None:
            return (e.otherwise(row[i]))
        e = F.when(col(hours) < row[0], row[i]) if e is None else e.when(col(hours) < row[0], row[i])


def recommend(df, p_yes, bid, ask, hours, min_edge_pct=5.0, min_prob=0.1):
    """Buy YES, buy NO or hold with horizon-scaled edge threshold and size."""
    d = df.withColumns({"size_mult": _horizon(hours, 1), "edge_threshold": min_edge_pct * _horizon(hours, 2)})
    y, n = col(p_yes), 1.0 - col(p_yes)
    py, pn = col(ask), 100 - col(bid)
    edge = lambda q, price: F.when(price > 0, (q - price / 100.0) / (price / 100.0) * 100).otherwise(0.0)
    d = d.withColumns({"yes_edge": edge(y, py), "no_edge": edge(n, pn), "yes_ev": F.when(py > 0, y * (100 - py) - n * py).otherwise(0.0),
                       "no_ev": F.when(pn > 0, n * (100 - pn) - y * pn).otherwise(0.0)})
    thr = F.col("edge_threshold")
    ok_y = (y >= min_prob) & (F.col("yes_edge") >= thr) & (F.col("yes_ev") > 0)
    ok_n = (n >= min_prob) & (F.col("no_edge") >= thr) & (F.col("no_ev") > 0)
    act = (F.when(ok_y & (~ok_n | (F.col("yes_ev") >= F.col("no_ev"))), "buy_yes").when(ok_n, "buy_no").otherwise("hold"))
    d = d.withColumn("action", act)
    by = lambda a, b, z: F.when(F.col("action") == "buy_yes", a).when(F.col("action") == "buy_no", b).otherwise(z)
    return d.withColumns({"entry_price": by(py.cast("double"), pn.cast("double"), 0.0),
                          "edge_pct": by(F.col("yes_edge"), F.col("no_edge"), 0.0), "ev": by(F.col("yes_ev"), F.col("no_ev"), 0.0)})
