"""Running P&L, position counts and equity curves."""

import pandas as pd

from pyspark.sql import functions as F

from ..functions.timeutil import col
from .chunked import EVEN_CHUNKS, TASK_ROWS, chunked, even_chunk, prefix_scan, unchunk


def day_chunk(df, day, pos, parts=64):
    """Chunk for rows ordered by (day, pos): each day in ``parts`` slices of ``pos``."""
    d = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long")
    return d * (parts + 1) + even_chunk(df, pos, parts)


def cumulative_pnl(trades, keys, order, pnl, limit):
    """Running P&L per key and whether the loss limit has been reached.

    As many chunks as a single key with all rows would need, so that there are far fewer
    totals than rows where keys are many.
    """
    rows = trades.count()
    chunk = even_chunk(trades, order[0], min(max(-(-rows // TASK_ROWS), 1), EVEN_CHUNKS))
    d = prefix_scan(trades, keys, order, chunk, {"cum_pnl": ("sum", pnl)}, rows=rows)
    return d.withColumn("halted", (F.col("cum_pnl") <= -abs(limit)).cast("int"))


def open_positions(opens, closes, keys, pos, ids, limits):
    """Open count after each event, in total per ``keys`` prefix and per key."""
    ev = opens.select(*keys, *ids, col(pos).alias("pos_at"), F.lit(1).alias("sign")).unionByName(
        closes.select(*keys, *ids, col(pos).alias("pos_at"), F.lit(-1).alias("sign")))
    order = ["pos_at", "sign", *ids]
    chunk, rows = even_chunk(ev, "pos_at"), ev.count()
    ev = prefix_scan(ev, keys, order, chunk, {"n_open": ("sum", "sign")}, rows=rows)
    ev = prefix_scan(ev, [], order + list(keys), chunk, {"n_total": ("sum", "sign")}, rows=rows)
    return ev.withColumn("allowed", ((F.col("n_open") < limits[0]) & (F.col("n_total") < limits[1])).cast("int"))


def drawdown(trades, keys, order, pnl, day, start=10000.0):
    """Equity curve summary: final equity, drawdown, profit factor, daily Sharpe.
    ``order`` is the day followed by an integer position."""
    chunk = day_chunk(trades, day, order[1])
    d = prefix_scan(chunked(trades, keys, chunk, trades.count()), keys, order, "_c", {"_cum": ("sum", pnl)})
    d = d.withColumn("equity", F.col("_cum") + start)
    d = unchunk(prefix_scan(d, keys, order, "_c", {"_pk": ("max", "equity")}))
    d = d.withColumn("peak", F.greatest(F.col("_pk"), F.lit(start))).withColumn("dd", F.col("equity") - F.col("peak"))
    p = col(pnl)
    s = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(p) + start).alias("final_equity"), F.min("dd").alias("max_dd"),
        F.min_by("peak", F.struct(F.col("dd"), *[col(o) for o in order])).alias("_peak_at"),
        F.sum(F.when(p > 0, p).otherwise(0)).alias("gross_profit"), (-F.sum(F.when(p < 0, p).otherwise(0))).alias("gross_loss"),
        F.avg(F.when(p > 0, p)).alias("avg_win"), F.avg(F.when(p < 0, p)).alias("avg_loss"))
    daily = trades.groupBy(*keys, day).agg(F.sum(p).alias("_p")).groupBy(*keys).agg(
        (F.avg("_p") / F.stddev_samp("_p") * F.sqrt(F.lit(250.0))).alias("sharpe"))
    return s.join(daily, list(keys)).withColumns({
        "max_dd_pct": F.when(F.col("max_dd") < 0, F.col("max_dd") / F.col("_peak_at") * 100).otherwise(0.0),
        "profit_factor": F.col("gross_profit") / F.nullif(F.col("gross_loss"), F.lit(0))})


def kelly_equity(trades, keys, order, start=10000.0, fraction=0.1, cap=50.0):
    """Equity when each bet depends on the equity before it.

    The recursion cannot be reassociated, so a run is walked in order; rows are
    shuffled and sorted by Spark and streamed through the task in Arrow batches
    with one number of state per run, so nothing of a run is held in memory.
    """
    d = trades.select(*keys, *order, "prob", "price", "pnl")
    schema = d.select(*keys, *order).schema.add("bet", "double").add("equity", "double")
    d = d.repartition(*keys).sortWithinPartitions(*keys, *order)

    def walk(batches):
        run, equity = None, start
        for b in batches:
            bets, curve = [], []
            for k, p, price, pnl in zip(zip(*[b[c] for c in keys]), b["prob"], b["price"], b["pnl"]):
                if k != run:
                    run, equity = k, start
                bet = min(max(fraction * (2 * p - 1) * equity, 0.0), cap)
                equity += pnl / 100 * (bet / (price / 100.0))
                bets.append(bet)
                curve.append(equity)
            yield b[[*keys, *order]].assign(bet=pd.Series(bets, index=b.index), equity=pd.Series(curve, index=b.index))

    return d.mapInPandas(walk, schema)
