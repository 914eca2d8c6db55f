"""Threshold sweeps in one pass.

Each row falls into exactly one band between neighbouring thresholds. Band
totals (one row per threshold, combined map-side) are then accumulated from the
top, which gives the totals of ``value >= threshold`` without copying rows.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.timeutil import col


def threshold_totals(df, value, thresholds, sums, by=(), name="thr"):
    """Totals of each column in ``sums`` over rows with value >= threshold."""
    thr, by = sorted(float(t) for t in thresholds), list(by)
    arr = F.array(*[F.lit(t) for t in thr])
    band = F.size(F.filter(arr, lambda t: t <= col(value))) - 1
    b = df.select(*by, band.alias("_b"), *[col(c).alias(n) for n, c in sums.items()]).filter("_b >= 0")
    b = b.groupBy(*by, "_b").agg(*[F.sum(n).alias(n) for n in sums])
    # Spread each band total to the thresholds below it: at most |thresholds| copies of a total.
    b = b.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_b"))))
    out = b.groupBy(*by, "_t").agg(*[F.sum(n).alias(n) for n in sums])
    return out.withColumn(name, F.element_at(arr, F.col("_t") + 1)).drop("_t", "_b")


def trade_stats(totals, n="n", s="s", ss="ss", wins="w"):
    """Mean, population std, Sharpe and hit rate from n, sum, sum of squares, wins."""
    mean = F.col(s) / F.col(n)
    sd = F.sqrt(F.greatest(F.col(ss) / F.col(n) - mean * mean, F.lit(0.0)))
    return totals.withColumns({"mean_pnl": mean, "std_pnl": sd,
                               "sharpe": F.when(sd > 1e-9, mean / sd), "hit_rate": F.col(wins) / F.col(n)})


def best_threshold(stats, min_trades=100, by="sharpe", name="thr"):
    """One row ``best``: the smallest threshold with the largest ``by``, among those that
    leave at least ``min_trades`` trades; NULL if none does."""
    return stats.filter(F.col("n") >= min_trades).agg(F.max_by(name, F.struct(F.col(by), -F.col(name))).alias("best"))


def with_enough(stats, columns, min_trades=200):
    """``columns`` are NULL where fewer than ``min_trades`` trades stand behind them."""
    return stats.withColumns({c: F.when(F.col("n") >= min_trades, F.col(c)) for c in columns})


def grouped_results(trades, by, min_trades=10):
    """Count, P&L and win rate of groups that have at least ``min_trades`` trades."""
    g = trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"), F.avg("won").alias("win_rate"))
    return g.filter(F.col("n") >= min_trades)
