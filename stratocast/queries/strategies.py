"""Strategies P10-P13."""

from ..operators import strategies as S
from .registry import query

PICK = """
SELECT f.city, f.day, f.fcst_f, m.ticker, m.mkt, m.strike_type, m.floor_s, m.cap_s, s.settle_f
FROM (SELECT city, day, tempmax_f AS fcst_f FROM v_fcst
      QUALIFY row_number() OVER (PARTITION BY city, day ORDER BY (lead <> 1)::INT, lead) = 1) f
JOIN v_market m USING (city, day) JOIN v_settle s USING (city, day)
WHERE (m.strike_type = 'between' AND round_even(f.fcst_f + {bias}, 0) BETWEEN m.floor_s AND m.cap_s)
   OR (m.strike_type = 'less' AND round_even(f.fcst_f + {bias}, 0) < m.cap_s)
   OR (m.strike_type = 'greater' AND round_even(f.fcst_f + {bias}, 0) > m.floor_s)
QUALIFY row_number() OVER (PARTITION BY f.city, f.day ORDER BY CASE m.strike_type WHEN 'between' THEN 0 WHEN 'less' THEN 1 ELSE 2 END) = 1
"""
WON = """CASE WHEN strike_type = 'less' THEN settle_f <= cap_s WHEN strike_type = 'greater' THEN settle_f >= floor_s + 1
  ELSE settle_f BETWEEN floor_s AND cap_s END"""


@query("strategy_open_maker_base",
       "city s, n_trades i, total_pnl f, avg_pnl f, win_rate f, wagered f, roi_pct f, sharpe f, n_days i, daily_sharpe f",
       f"""
WITH picked AS ({PICK.format(bias='1.0e0')}),
t AS (SELECT *, CAST(floor(100.0e0 / 0.3e0) AS BIGINT) AS n, {WON} AS won FROM picked),
p AS (SELECT city, day, won, n, CASE WHEN won THEN n * (1.0e0 - 0.3e0) ELSE -n * 0.3e0 END - 0.07e0 * 30 * 70 / 100 / 100 * n AS pnl FROM t)
SELECT city, count(*) AS n_trades, sum(pnl) AS total_pnl, avg(pnl) AS avg_pnl, avg(won::INT) AS win_rate,
  sum(n * 0.3e0) AS wagered, sum(pnl) / sum(n * 0.3e0) * 100 AS roi_pct,
  CASE WHEN stddev_samp(pnl) > 1e-9 THEN avg(pnl) / stddev_samp(pnl) END AS sharpe, count(*) AS n_days,
  CASE WHEN stddev_samp(pnl) > 1e-9 THEN avg(pnl) / stddev_samp(pnl) END AS daily_sharpe
FROM p GROUP BY city""")
def strategy_open_maker_base(t):
    trades = S.fixed_entry(t.fcst, t.settle, t.market, bias=1.0, entry=30.0, budget=100.0)
    return S.run_metrics(trades, ["city"])


_T3 = f"""SELECT *, n AS n_, 30.0e0 AS entry, CASE WHEN won THEN n * (1.0e0 - 0.3e0) ELSE -n * 0.3e0 END - 0.07e0 * 30 * 70 / 100 / 100 * n AS pnl FROM (SELECT *, CAST(floor(100.0e0 / 0.3e0) AS BIGINT) AS n, {WON} AS won FROM ({PICK.format(bias='1.0e0')}))"""


def base(t):
    return S.fixed_entry(t.fcst, t.settle, t.market, bias=1.0, entry=30.0, budget=100.0)


@query("strategy_midnight", "city s, day d, adj_f f, ticker s, entry i, n i, won i, pnl f", """
WITH p AS (SELECT a.city, a.basis AS day, a.tempmax_f AS t0, coalesce(b.tempmax_f, a.tempmax_f) AS t1, coalesce(c.tempmax_f, a.tempmax_f) AS t2 FROM (SELECT * FROM v_fcst WHERE lead = 0) a LEFT JOIN (SELECT * FROM v_fcst WHERE lead = 1) b ON a.city = b.city AND a.basis = b.basis LEFT JOIN (SELECT * FROM v_fcst WHERE lead = 2) c ON a.city = c.city AND a.basis = c.basis),
x AS (SELECT city, day, t0 + 0.3e0 * ((t0 + t1 + t2) / 3 - t0) + 0.1e0 * (greatest(t0, t1, t2) - least(t0, t1, t2)) AS adj_f FROM p),
b AS (SELECT x.*, m.ticker, m.mkt, m.strike_type, m.floor_s, m.cap_s FROM x JOIN v_market m USING (city, day) WHERE (strike_type = 'between' AND adj_f >= floor_s AND adj_f < cap_s) OR (strike_type = 'less' AND adj_f < cap_s) OR (strike_type = 'greater' AND adj_f >= floor_s)
 QUALIFY row_number() OVER (PARTITION BY x.city, x.day ORDER BY CASE strike_type WHEN 'between' THEN 0 WHEN 'less' THEN 1 ELSE 2 END, floor_s) = 1),
f AS (SELECT mkt, arg_min(bid, bucket_us) AS entry FROM v_candle GROUP BY mkt),
t AS (SELECT b.*, f.entry, CAST(greatest(floor(100.0e0 / (f.entry / 100)), 1) AS BIGINT) AS n, CASE WHEN strike_type = 'between' THEN settle_f >= floor_s AND settle_f < cap_s WHEN strike_type = 'less' THEN settle_f < cap_s ELSE settle_f >= floor_s END AS won FROM b JOIN f USING (mkt) JOIN v_settle USING (city, day))
SELECT city, day, adj_f, ticker, entry, n, won::INT AS won, CASE WHEN won THEN n * (1.0e0 - entry / 100) ELSE -n * (entry / 100) END - 0.07e0 * entry * (100 - entry) / 100 / 100 * n AS pnl FROM t""")
def strategy_midnight(t):
    from pyspark.sql import functions as F
    return S.midnight(t.fcst, t.settle, t.market, t.candle, 0.3, 0.1).withColumn("won", F.col("won").cast("int"))


@query("strategy_next_over", "city s, day d, ticker s, own i, neighbour i, exited i, pnl f", f"""
WITH t AS (SELECT b.*, epoch_us(b.day::TIMESTAMP) + 50400000000 AS dec FROM ({_T3}) b), nb AS (SELECT mkt, lead(mkt) OVER (PARTITION BY city, day ORDER BY floor_s NULLS FIRST) AS up FROM v_market),
x AS (SELECT t.*, nb.up FROM t LEFT JOIN nb USING (mkt)),
o AS (SELECT x.*, CASE WHEN x.dec - c.bucket_us <= 28800000000 THEN coalesce(c.bid_n, c.ask) END AS own FROM x ASOF LEFT JOIN v_candle c ON c.mkt = x.mkt AND x.dec >= c.bucket_us),
u AS (SELECT o.*, CASE WHEN o.dec - c.bucket_us <= 28800000000 THEN coalesce(c.bid_n, c.ask) END AS neighbour FROM o ASOF LEFT JOIN v_candle c ON c.mkt = o.up AND o.dec >= c.bucket_us)
SELECT city, day, ticker, own, neighbour, coalesce(neighbour >= 50 AND own <= 30, false)::INT AS exited, CASE WHEN coalesce(neighbour >= 50 AND own <= 30, false) THEN n * (own / 100 - 0.3e0) - 0.07e0 * own * (100 - own) / 100 / 100 * n ELSE pnl END AS pnl FROM u""")
def strategy_next_over(t):
    from ..functions.timeutil import HOUR, epoch_us
    from pyspark.sql import functions as F
    return S.next_over(base(t), t.market, t.candle, epoch_us(F.col("day").cast("timestamp_ntz")) + 14 * HOUR, 8 * HOUR)


@query("strategy_curve_gap", "city s, day d, ticker s, new_ticker s, shifted i, obs_f f, fcst_at f, slope f, pnl f", f"""
WITH t AS (SELECT b.*, epoch_us(b.day::TIMESTAMP) + 43200000000 AS dec FROM ({_T3}) b),
s AS (SELECT t.city, t.day, avg(o.temp_f) FILTER (o.us >= t.dec - 7200000000) AS obs_f, count(*) FILTER (o.us >= t.dec - 7200000000) AS np, coalesce(regr_slope(o.temp_f, (o.us - t.dec) / 3.6e9), 0) AS slope FROM t JOIN v_obs o ON o.city = t.city AND o.day = t.day AND o.us BETWEEN t.dec - 14400000000 AND t.dec GROUP BY ALL),
f AS (SELECT t.*, s.obs_f, s.np, s.slope, a.us AS t0, a.temp_f AS v0, b.us AS t1, b.temp_f AS v1 FROM t LEFT JOIN s USING (city, day) ASOF LEFT JOIN v_fcst_hourly a ON t.city = a.city AND t.day = a.day AND t.dec >= a.us ASOF LEFT JOIN v_fcst_hourly b ON t.city = b.city AND t.day = b.day AND t.dec < b.us),
g AS (SELECT *, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (dec - t0) / (t1 - t0) * (v1 - v0) END AS fcst_at FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY city, day ORDER BY floor_s NULLS FIRST) - 1 AS idx FROM v_market),
h AS (SELECT g.*, k.idx, CASE WHEN coalesce(np >= 3 AND obs_f - fcst_at >= 1.5 AND slope >= 0.5, false) THEN least(1, 6 - k.idx - 1) ELSE 0 END AS shifted FROM g JOIN k USING (mkt)),
w AS (SELECT h.city, h.day, h.ticker, h.shifted, h.obs_f, h.fcst_at, h.slope, h.n, h.settle_f, n2.ticker AS new_ticker, n2.strike_type, n2.floor_s, n2.cap_s FROM h JOIN k n2 ON n2.city = h.city AND n2.day = h.day AND n2.idx = h.idx + h.shifted)
SELECT *, CASE WHEN {WON} THEN n * (1.0e0 - 0.3e0) ELSE -n * 0.3e0 END - 0.07e0 * 30 * 70 / 100 / 100 * n AS pnl FROM w""")
def strategy_curve_gap(t):
    return S.curve_gap(base(t), t.market, t.obs, t.fcst_hourly, 12, avg_min=120, slope_min=240)


GRID = [(i, b, e, o) for i, (b, e, o) in enumerate((b, e, o) for b in (-1.0, 0.0, 1.0) for e in (20.0, 30.0, 45.0) for o in (0, 1, 2))]
_GRID = "(SELECT b * 9 + e * 3 + o AS pid, [-1.0e0, 0.0e0, 1.0e0][b + 1] AS bias, [20.0e0, 30.0e0, 45.0e0][e + 1] AS entry, o AS off FROM range(3) x(b), range(3) y(e), range(3) z(o))"


@query("param_sweep", "pid i, bias f, entry f, n_train i, train_pnl f, n_test i, test_pnl f, best i", f"""
WITH f AS (SELECT g.*, a.city, a.day, a.tempmax_f AS fcst_f FROM {_GRID} g, v_fcst a QUALIFY row_number() OVER (PARTITION BY pid, city, day ORDER BY (lead <> off)::INT, lead) = 1),
p AS (SELECT f.*, m.strike_type, m.floor_s, m.cap_s, s.settle_f FROM f JOIN v_market m USING (city, day) JOIN v_settle s USING (city, day) WHERE (strike_type = 'between' AND round_even(fcst_f + bias, 0) BETWEEN floor_s AND cap_s) OR (strike_type = 'less' AND round_even(fcst_f + bias, 0) < cap_s) OR (strike_type = 'greater' AND round_even(fcst_f + bias, 0) > floor_s)
 QUALIFY row_number() OVER (PARTITION BY pid, city, day ORDER BY CASE strike_type WHEN 'between' THEN 0 WHEN 'less' THEN 1 ELSE 2 END) = 1),
t AS (SELECT *, floor(100.0e0 / (entry / 100)) AS n, {WON} AS won FROM p), q AS (SELECT *, CASE WHEN won THEN n * (1.0e0 - entry / 100) ELSE -n * (entry / 100) END - 0.07e0 * entry * (100 - entry) / 100 / 100 * n AS pnl FROM t),
r AS (SELECT pid, bias, entry, count(*) FILTER (day < DATE '2024-01-21') AS n_train, coalesce(sum(pnl) FILTER (day < DATE '2024-01-21'), 0) AS train_pnl, count(*) FILTER (day >= DATE '2024-01-21') AS n_test, coalesce(sum(pnl) FILTER (day >= DATE '2024-01-21'), 0) AS test_pnl FROM q GROUP BY ALL)
SELECT *, (pid = (SELECT pid FROM r ORDER BY round(train_pnl, 6) DESC, pid LIMIT 1))::INT AS best FROM r""")
def param_sweep(t):
    return S.param_sweep(t.fcst, t.settle, t.market, GRID, "2024-01-21")
