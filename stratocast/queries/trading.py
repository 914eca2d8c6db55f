"""Top-k, trade arithmetic and edges."""

from pyspark.sql import functions as F

from ..functions import probs as PR
from ..functions import strikes
from ..functions import trades as T
from ..operators import edge as E
from ..operators.asof import asof
from ..plans.tables import CITIES
from .aggregates import rule_stats
from .joins import _SNAPJ, snap_markets
from .registry import query
from .scalars import _RULE_SQL, PHI_SQL

N = F.lit


def CNT():
    return F.count(F.lit(1))


# --- sorts, limits, top-k ---

@query("topk_distinct_on", "city s, day d, peak_hour i, peak_f f", """
SELECT DISTINCT ON (city, day) city, day, hour AS peak_hour, temp_f AS peak_f FROM v_fcst_hourly ORDER BY city, day, temp_f DESC, hour""")
def topk_distinct_on(t):
    r = F.struct(F.col("temp_f"), -F.col("hour"))
    return t.fcst_hourly.groupBy("city", "day").agg(F.max_by("hour", r).alias("peak_hour"), F.max("temp_f").alias("peak_f"))


@query("topk_priority_pick", "city s, day d, src s, v f", """
SELECT city, day, src, v FROM (SELECT city, day, 'live' AS src, 1 AS pr, tempmax_f + 1 AS v FROM v_fcst WHERE lead = 1 UNION ALL SELECT city, day, 'hist', 0, tempmax_f FROM v_fcst WHERE lead = 2) QUALIFY row_number() OVER (PARTITION BY city, day ORDER BY pr) = 1""")
def topk_priority_pick(t):
    f = t.fcst.filter("lead IN (1, 2)").select("city", "day", F.when(F.col("lead") == 2, "hist").otherwise("live").alias("src"),
                                               F.when(F.col("lead") == 2, 0).otherwise(1).alias("pr"), (F.col("tempmax_f") + F.when(F.col("lead") == 1, 1).otherwise(0)).alias("v"))
    return f.groupBy("city", "day").agg(F.min_by(F.struct("src", "v"), "pr").alias("x")).select("city", "day", "x.*")


@query("topk_source_precedence", "city s, day d, final i, src s", """
SELECT city, day, coalesce(iem, cli, cf6, ncei) AS final, CASE WHEN iem IS NOT NULL THEN 'iem' WHEN cli IS NOT NULL THEN 'cli' WHEN cf6 IS NOT NULL THEN 'cf6' WHEN ncei IS NOT NULL THEN 'ncei' END AS src
FROM (SELECT city, day, CASE WHEN di % 2 = 0 THEN settle_f END AS iem, CASE WHEN di % 3 = 0 THEN settle_f + 1 END AS cli, CASE WHEN di % 5 = 0 THEN settle_f + 2 END AS cf6, CASE WHEN di % 7 <> 1 THEN settle_f + 3 END AS ncei FROM v_settle)""")
def topk_source_precedence(t):
    d, s = F.col("di"), F.col("settle_f")
    x = t.settle.select("city", "day", F.when(d % 2 == 0, s).alias("iem"), F.when(d % 3 == 0, s + 1).alias("cli"), F.when(d % 5 == 0, s + 2).alias("cf6"), F.when(d % 7 != 1, s + 3).alias("ncei"))
    order = ["iem", "cli", "cf6", "ncei"]
    return x.withColumns({"final": F.coalesce(*order), "src": F.coalesce(*[F.when(F.col(c).isNotNull(), c) for c in order])})


_FEE = "ceil(0.07e0 * ({p} / 100.0e0) * {n} * (1 - {p} / 100.0e0) * 100)"
_BEST = f"""
SELECT *, greatest(CASE WHEN e0 >= 3 THEN e0 END, CASE WHEN ask - bid > 1 AND e1 >= 3 THEN e1 END, CASE WHEN e2 >= 3 THEN e2 END, CASE WHEN ask - bid > 1 AND e3 >= 3 THEN e3 END) AS ev FROM (
SELECT *, q * 100 - ask - {_FEE.format(p='ask', n=1)} AS e0, (q * 100 - (bid + 1)) * {{fill}} AS e1, bid - q * 100 - {_FEE.format(p='bid', n=1)} AS e2, ((ask - 1) - q * 100) * {{fill}} AS e3 FROM ({{src}}) WHERE bid > 0 AND ask < 100 AND ask > bid)"""
_PICK = """CASE WHEN e0 >= 3 AND e0 = ev THEN 'buy' WHEN ask - bid > 1 AND e1 >= 3 AND e1 = ev THEN 'buy' WHEN e2 >= 3 AND e2 = ev THEN 'sell' ELSE 'sell' END AS action,
CASE WHEN e0 >= 3 AND e0 = ev THEN ask WHEN ask - bid > 1 AND e1 >= 3 AND e1 = ev THEN bid + 1 WHEN e2 >= 3 AND e2 = ev THEN bid ELSE ask - 1 END AS price,
CASE WHEN e0 >= 3 AND e0 = ev THEN 'taker' WHEN ask - bid > 1 AND e1 >= 3 AND e1 = ev THEN 'maker' WHEN e2 >= 3 AND e2 = ev THEN 'taker' ELSE 'maker' END AS role"""


@query("topk_best_trade", "event_id i, ev f, action s, price i, role s",
       f"SELECT event_id, ev, {_PICK} FROM ({_BEST.format(fill='0.4e0', src='SELECT event_id, bid, ask, (event_id * 37 % 1000) / 1000.0e0 AS q FROM v_quote')}) WHERE ev IS NOT NULL")
def topk_best_trade(t):
    q = t.quote.withColumn("q", (F.col("event_id") * 37 % 1000) / 1000.0)
    return q.select("event_id", T.best_trade("q", "bid", "ask").alias("b")).filter("b IS NOT NULL").select("event_id", "b.*")


_SQ = f"SELECT s.city, s.day, s.us, s.mkt, s.j, c.bid, c.ask FROM ({_SNAPJ}) s ASOF JOIN v_candle c ON s.mkt = c.mkt AND s.us >= c.bucket_us"


def snap_quotes(t):
    return asof(snap_markets(t), t.candle, ["mkt"], "us", "bucket_us", {"bid": "bid", "ask": "ask"}).filter("bid IS NOT NULL")


@query("topk_best_bracket", "city s, day d, us u, mkt s, ev f, action s, price i", f"""
WITH b AS ({_BEST.format(fill='0.4e0', src=f"SELECT *, (j * 13 + us // 3600000000 * 7) % 100 / 100.0e0 AS q FROM ({_SQ})")})
SELECT city, day, us, mkt, ev, {_PICK} FROM b WHERE ev IS NOT NULL QUALIFY row_number() OVER (PARTITION BY city, day, us ORDER BY ev DESC, mkt) = 1""")
def topk_best_bracket(t):
    q = snap_quotes(t).withColumn("q", (F.col("j") * 13 + F.floor(F.col("us") / 3_600_000_000) * 7) % 100 / 100.0)
    return E.best_bracket(q, ["city", "day", "us"], "q", "mkt")


@query("topk_worst_coverage", "mkt s, missing_minutes i", """
WITH g AS (SELECT mkt, bucket_us, lag(bucket_us) OVER (PARTITION BY mkt ORDER BY bucket_us) AS p FROM v_candle)
SELECT mkt, sum(greatest((bucket_us - coalesce(p, bucket_us)) // 60000000 - 1, 0)) AS missing_minutes FROM g GROUP BY mkt ORDER BY missing_minutes DESC, mkt LIMIT 5""")
def topk_worst_coverage(t):
    from ..operators.audit import minute_gaps
    return minute_gaps(t.candle, ["mkt"], "bucket_us").withColumnRenamed("gap_minutes", "missing_minutes").orderBy(F.desc("missing_minutes"), "mkt").limit(5)


@query("sort_opportunities", "event_id i, ev f", "SELECT event_id, (event_id * 37 % 1000) / 10.0e0 - ask AS ev FROM v_quote WHERE (event_id * 37 % 1000) / 10.0e0 - ask > 20 ORDER BY ev DESC, event_id")
def sort_opportunities(t):
    return t.quote.select("event_id", ((F.col("event_id") * 37 % 1000) / 10.0 - F.col("ask")).alias("ev")).filter("ev > 20").orderBy(F.desc("ev"), "event_id")


@query("sort_nulls_first", "city s, day d, ticker s, floor_s f", "SELECT city, day, ticker, floor_s FROM v_market ORDER BY city, day, floor_s NULLS FIRST")
def sort_nulls_first(t):
    return t.market.orderBy("city", "day", F.col("floor_s").asc_nulls_first())


@query("topk_rule_ranking", "rule s, n i, accuracy f, mae f, rnk i", f"""
WITH p AS ({_RULE_SQL}), l AS (SELECT ['max_round','max_of_rounded','ceil_max','floor_max','plateau_20min','ignore_singletons','c_first'][i] AS rule, abs([max_round, max_of_rounded, ceil_max, floor_max, plateau_20min, ignore_singletons, c_first][i] - s.settle_f) AS e FROM p JOIN v_settle s ON s.city = p.city AND s.day = p.day, range(1, 8) r(i))
SELECT rule, count(*) AS n, avg((e = 0)::INT) AS accuracy, avg(e) AS mae, rank() OVER (ORDER BY avg((e = 0)::INT) DESC) AS rnk FROM l GROUP BY rule""")
def topk_rule_ranking(t):
    from pyspark.sql import Window
    from ..operators.rules import daily_rules
    s = rule_stats(daily_rules(t.obs).join(t.settle.select("city", "day", "settle_f"), ["city", "day"]))
    # One row per rule: a global rank over seven rows.
    return s.filter("n > 0").withColumn("rnk", F.rank().over(Window.orderBy(F.desc("accuracy"))))


@query("sample_trades", "ok i, ln i, pk i, sk i, pnl i", "SELECT ok, ln, pk, sk, pnl FROM v_bt ORDER BY md5(concat_ws(':', ok, ln, pk, sk, 42)), ok, ln, pk, sk, pnl LIMIT 25")
def sample_trades(t):
    """Reproducible sample: smallest hashes of the trade key, then sorted."""
    k = ["ok", "ln", "pk", "sk"]
    return t.bt.select(*k, "pnl").orderBy(F.md5(F.concat_ws(":", *k, N(42)).cast("binary")), *k, "pnl").limit(25).orderBy(*k)


@query("topk_mode_class", "vec_id i, cls i, prob f", "SELECT vec_id, list_position(p, list_max(p)) - 4 AS cls, list_max(p) AS prob FROM v_probs")
def topk_mode_class(t):
    return t.probs.select("vec_id", PR.mode("p", "classes").alias("cls"), F.array_max("p").alias("prob"))


# --- fees, roles, sizing, settlement ---

@query("trade_fees", "ok i, ln i, pk i, sk i, fee_c i, fee_one_c i, fee_usd f, maker_c i", f"""
SELECT ok, ln, pk, sk, {_FEE.format(p='price', n='n')} AS fee_c, {_FEE.format(p='price', n=1)} AS fee_one_c, 0.07e0 * price * (100 - price) / 100 / 100 * n AS fee_usd, 0 AS maker_c FROM v_bt""")
def trade_fees(t):
    return t.bt.select("ok", "ln", "pk", "sk", T.taker_fee_cents("price", "n").alias("fee_c"), T.taker_fee_cents("price").alias("fee_one_c"), T.taker_fee_usd("price", "n").alias("fee_usd"), N(0).alias("maker_c"))


@query("trade_role_ev", "event_id i, side s, action s, price i, role s, ev f", f"""
WITH x AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS side, CASE WHEN event_id // 2 % 2 = 0 THEN 'buy' ELSE 'sell' END AS action, greatest(bid - 2 + event_id % 9, 1) AS price, bid, ask, (event_id * 37 % 1000) / 1000.0e0 AS q FROM v_quote),
r AS (SELECT *, CASE WHEN (side = 'yes' AND action = 'buy' AND price >= ask) OR (side = 'yes' AND action = 'sell' AND price <= bid) OR (side = 'no' AND action = 'buy' AND price >= 100 - bid) OR (side = 'no' AND action = 'sell' AND price <= 100 - ask) THEN 'taker' ELSE 'maker' END AS role FROM x)
SELECT event_id, side, action, price, role, CASE WHEN action = 'buy' THEN 1 ELSE -1 END * ((CASE WHEN side = 'yes' THEN q ELSE 1 - q END) * 100 - price) - CASE WHEN role = 'taker' THEN {_FEE.format(p='price', n=1)} ELSE 0 END AS ev FROM r""")
def trade_role_ev(t):
    e = F.col("event_id")
    x = t.quote.select("event_id", F.when(e % 2 == 0, "yes").otherwise("no").alias("side"), F.when(F.floor(e / 2) % 2 == 0, "buy").otherwise("sell").alias("action"),
                                         F.greatest(F.col("bid") - 2 + e % 9, N(1)).alias("price"), "bid", "ask", (e * 37 % 1000 / 1000.0).alias("q"))
    x = x.withColumn("role", T.liquidity_role("side", "action", "price", "bid", "ask"))
    return x.withColumn("ev", T.expected_value("side", "action", "price", "q", "role"))


@query("trade_position_size", "ok i, ln i, pk i, sk i, by_budget i, kelly i, capped s", """
WITH x AS (SELECT *, edge AS ev, 1 + sk % 6 AS sd, ok % 100 AS pos FROM v_bt), f AS (SELECT *, least((CASE WHEN prob * (1 - prob) > 0 THEN (ev / 100.0e0 / (price / 100.0e0)) / (prob * (1 - prob)) ELSE 0 END) * 0.25e0, 0.1e0) * CASE WHEN sd > 3 THEN greatest(0.25e0, 1.0e0 - (sd - 3.0e0) * 0.25e0) ELSE 1 END AS f FROM x),
c AS (SELECT *, floor(f * 10000.0e0 / (price / 100.0e0)) AS want, floor(50.0e0 / (price / 100.0e0)) AS bc, 100 - pos AS room FROM f)
SELECT ok, ln, pk, sk, greatest(floor(100.0e0 / (price / 100.0e0)), 1) AS by_budget, CASE WHEN ev <= 0 THEN 0 WHEN least(want, bc, room) = 0 THEN 1 ELSE least(want, bc, room) END AS kelly,
 CASE WHEN ev > 0 THEN CASE WHEN least(want, bc, room) = 0 THEN 'minimum' WHEN least(want, bc) > room THEN 'max_position' WHEN want > bc THEN 'max_bet_size' END END AS capped FROM c""")
def trade_position_size(t):
    x = t.bt.withColumns({"sd": 1 + F.col("sk") % 6, "pos": F.col("ok") % 100})
    n, cap = T.kelly_size("edge", "price", "prob", "sd", "pos")
    return x.select("ok", "ln", "pk", "sk", T.contracts_for_budget("price", 100.0).alias("by_budget"), n.alias("kelly"), cap.alias("capped"))


@query("trade_pnl", "ok i, ln i, pk i, sk i, held f, exited f, realised f, yes_buy i, no_sell i", """
SELECT ok, ln, pk, sk, CASE WHEN won = 1 THEN n * (1 - price / 100) ELSE -n * (price / 100) END - 0.5e0 AS held, n * (50 / 100 - price / 100) - 0.25e0 AS exited, ((CASE WHEN won = 1 THEN 100 * n ELSE 0 END) - price * n - 50) / n AS realised,
 (CASE WHEN won = 1 THEN 100 ELSE 0 END) - price AS yes_buy, price - (CASE WHEN won = 1 THEN 0 ELSE 100 END) AS no_sell FROM v_bt""")
def trade_pnl(t):
    b = t.bt.withColumn("w", F.col("won") == 1)
    return b.select("ok", "ln", "pk", "sk", T.held_pnl("price", "n", "w", 0.5).alias("held"), T.exit_pnl("price", N(50), "n", 0.25).alias("exited"),
                    ((F.when(F.col("w"), 100 * F.col("n")).otherwise(0) - F.col("price") * F.col("n") - 50) / F.col("n")).alias("realised"),
                    T.outcome_pnl(N("yes"), N("buy"), "price", "w").alias("yes_buy"), T.outcome_pnl(N("no"), N("sell"), "price", "w").alias("no_sell"))


@query("trade_settle", "ticker s, settle_f i, won i, won_half_open i, pnl f", """
SELECT ticker, settle_f, w AS won, h AS won_half_open, CASE WHEN w = 1 THEN 0.7e0 ELSE -0.3e0 END AS pnl FROM (SELECT ticker, settle_f, (CASE strike_type WHEN 'less' THEN settle_f <= cap_s WHEN 'greater' THEN settle_f >= floor_s + 1 ELSE settle_f BETWEEN floor_s AND cap_s END)::INT AS w,
 (CASE strike_type WHEN 'less' THEN settle_f < cap_s WHEN 'greater' THEN settle_f >= floor_s ELSE settle_f >= floor_s AND settle_f < cap_s END)::INT AS h FROM v_market JOIN v_settle USING (city, day))""")
def trade_settle(t):
    j = t.market.join(t.settle.select("city", "day", "settle_f"), ["city", "day"])
    j = j.withColumns({"won": strikes.contains("strike_type", "floor_s", "cap_s", "settle_f"), "won_half_open": strikes.contains("strike_type", "floor_s", "cap_s", "settle_f", "half_open")})
    return j.withColumn("pnl", T.held_pnl(N(30), N(1), "won")).withColumns({c: F.col(c).cast("int") for c in ("won", "won_half_open")})


# --- edges ---

@query("edge_forecast_implied", "vec_id i, fcst_implied f, fcst_unc f, pred_delta i", """
SELECT l.vec_id, any_value(t_base) + sum(k * p) AS fcst_implied, sqrt(greatest(sum(k * k * p) - sum(k * p) * sum(k * p), 0)) AS fcst_unc, arg_max(k, struct_pack(a := p, b := -k)) AS pred_delta FROM v_probs_long l GROUP BY l.vec_id""")
def edge_forecast_implied(t):
    return E.forecast_implied(t.probs)


_MI = f"""SELECT city, day, us, sum(mid * q) / sum(q) AS mkt_implied, max(unc) AS mkt_unc, max(n) AS n_brackets FROM (
 SELECT city, day, us, n, unc, CASE WHEN i = 0 THEN t[1] - 1 WHEN i = n THEN t[n] + 1 ELSE (t[i] + t[i + 1]) / 2 END AS mid, greatest((CASE WHEN i = 0 THEN 1.0e0 ELSE m[i] END) - (CASE WHEN i = n THEN 0 ELSE m[i + 1] END), 0) AS q
 FROM (SELECT q.city, q.day, q.us, count(*) AS n, 2 * avg((ask - bid) / 100.0e0) AS unc, list(floor_s ORDER BY floor_s) AS t, list((bid / 100.0e0 + ask / 100.0e0) / 2 ORDER BY floor_s) AS m FROM ({_SQ}) q JOIN v_market k USING (mkt) WHERE k.strike_type = 'between' GROUP BY ALL), range(0, 7) r(i) WHERE i <= n) GROUP BY city, day, us"""


def snap_range_quotes(t):
    """Quotes of the range brackets at each snapshot; tail labels carry no threshold."""
    m = t.market.filter("strike_type = 'between'").select("mkt", "floor_s", "ticker")
    return snap_quotes(t).join(m, "mkt")


@query("edge_market_implied", "city s, day d, us u, mkt_implied f, mkt_unc f, n_brackets i", _MI)
def edge_market_implied(t):
    return E.market_implied(snap_range_quotes(t), ["city", "day", "us"])


@query("win_survival_diff", "city s, day d, us u, i i, q f", f"""
SELECT city, day, us, i, q / sum(q) OVER (PARTITION BY city, day, us) AS q FROM (SELECT city, day, us, i, greatest((CASE WHEN i = 0 THEN 1.0e0 ELSE m[i] END) - (CASE WHEN i = n THEN 0 ELSE m[i + 1] END), 0) AS q
 FROM (SELECT q.city, q.day, q.us, count(*) AS n, list((bid / 100.0e0 + ask / 100.0e0) / 2 ORDER BY floor_s) AS m FROM ({_SQ}) q JOIN v_market k USING (mkt) WHERE k.strike_type = 'between' GROUP BY ALL), range(0, 7) r(i) WHERE i <= n)""")
def win_survival_diff(t):
    s = E.survival(snap_range_quotes(t), ["city", "day", "us"], "floor_s", "bid", "ask")
    return s.select("city", "day", "us", F.posexplode("probs").alias("i", "q"))


_EDGE = f"""SELECT *, CASE WHEN abs(edge) >= 1.5 AND confidence >= 0.6 THEN CASE WHEN edge > 0 THEN 'buy_high' ELSE 'buy_low' END ELSE 'no_trade' END AS signal FROM (
SELECT *, 1 - 2 * {PHI_SQL.format(z='z')} AS confidence FROM (SELECT m.city, m.day, m.us, f.tempmax_f AS fcst, mkt_implied, f.tempmax_f - mkt_implied AS edge, abs(f.tempmax_f - mkt_implied) / sqrt(0.25e0 + mkt_unc * mkt_unc) AS z FROM ({_MI}) m JOIN v_fcst f ON f.city = m.city AND f.day = m.day AND f.lead = 1))"""


def edges(t):
    m = E.market_implied(snap_range_quotes(t), ["city", "day", "us"])
    f = t.fcst.filter("lead = 1").select("city", "day", F.col("tempmax_f").alias("fcst"))
    return E.with_edge(m.join(f, ["city", "day"]), "fcst", "mkt_implied", N(0.5), "mkt_unc")


@query("edge_signal", "city s, day d, us u, edge f, confidence f, signal s", _EDGE)
def edge_signal(t):
    return edges(t)


@query("edge_select_bracket", "city s, day d, us u, signal s, picked s", f"""
WITH e AS ({_EDGE}), j AS (SELECT e.*, k.ticker, k.floor_s FROM e JOIN v_market k ON k.city = e.city AND k.day = e.day WHERE k.strike_type = 'between' AND signal <> 'no_trade')
SELECT city, day, us, signal, CASE WHEN signal = 'buy_high' THEN coalesce(arg_max(ticker, floor_s) FILTER (floor_s <= fcst), arg_min(ticker, floor_s)) ELSE coalesce(arg_min(ticker, floor_s) FILTER (floor_s >= fcst), arg_max(ticker, floor_s)) END AS picked FROM j GROUP BY city, day, us, signal""")
def edge_select_bracket(t):
    s = edges(t).select("city", "day", "us", "signal", "fcst")
    return E.select_bracket(s, t.market.filter("strike_type = 'between'"), ["city", "day"], "fcst")


@query("orders_from_probs", "vec_id i, action s, entry_price f, edge_pct f, ev f, size_mult f, edge_threshold f", """
WITH x AS (SELECT vec_id, CAST(1 + vec_id % 90 AS BIGINT) AS bid, 1 + vec_id % 90 + 1 + vec_id % 7 AS ask, vec_id * 5 % 24 AS h, sum(CASE WHEN k BETWEEN -1 AND 1 THEN p ELSE 0 END) AS y FROM v_probs_long GROUP BY vec_id),
m AS (SELECT *, CASE WHEN h < 2 THEN 1.0 WHEN h < 6 THEN 0.5 WHEN h < 12 THEN 0.25 WHEN h < 18 THEN 0.15 ELSE 0.08 END AS size_mult, 5.0e0 * CASE WHEN h < 2 THEN 1.0e0 WHEN h < 6 THEN 1.2e0 WHEN h < 12 THEN 1.5e0 WHEN h < 18 THEN 2.0e0 ELSE 2.5e0 END AS thr,
 (y - ask / 100.0e0) / (ask / 100.0e0) * 100 AS ye, ((1 - y) - (100 - bid) / 100.0e0) / ((100 - bid) / 100.0e0) * 100 AS ne, y * (100 - ask) - (1 - y) * ask AS yv, (1 - y) * bid - y * (100 - bid) AS nv FROM x),
a AS (SELECT *, CASE WHEN y >= 0.1 AND ye >= thr AND yv > 0 THEN CASE WHEN 1 - y >= 0.1 AND ne >= thr AND nv > yv THEN 'buy_no' ELSE 'buy_yes' END WHEN 1 - y >= 0.1 AND ne >= thr AND nv > 0 THEN 'buy_no' ELSE 'hold' END AS action FROM m)
SELECT vec_id, action, CASE action WHEN 'buy_yes' THEN ask WHEN 'buy_no' THEN 100 - bid ELSE 0 END AS entry_price, CASE action WHEN 'buy_yes' THEN ye WHEN 'buy_no' THEN ne ELSE 0 END AS edge_pct, CASE action WHEN 'buy_yes' THEN yv WHEN 'buy_no' THEN nv ELSE 0 END AS ev, size_mult, thr AS edge_threshold FROM a""")
def orders_from_probs(t):
    v = F.col("vec_id")
    d = t.probs.withColumns({"y_p": PR.mass("p", "classes", -1, 1), "bid": 1 + v % 90, "ask": 1 + v % 90 + 1 + v % 7, "h": v * 5 % 24})
    return E.recommend(d, "y_p", "bid", "ask", "h")


# Maker fill probabilities evaluated side by side.
FILLS = [0.1, 0.2, 0.3, 0.4, 0.6, 1.0]
_TR = f"""
WITH e AS ({_EDGE}), s AS (SELECT e.*, p.vec_id, p.t_base, p.p FROM e LEFT JOIN v_probs p ON p.vec_id = (((e.day - DATE '2024-01-01') * 14 + hour(make_timestamp(e.us)) - 10) * 5 + list_position(['click', 'error', 'purchase', 'signup', 'view'], e.city) - 1) % (SELECT count(*) FROM v_probs)),
b AS (SELECT s.city, s.day, s.us, s.edge, s.signal, q.mkt, q.bid, q.ask, k.strike_type, k.floor_s, k.cap_s, list_sum(list_transform([1,2,3,4,5,6,7], lambda i: CASE WHEN (k.strike_type = 'less' AND round_even(s.fcst, 0) + i - 4 <= k.cap_s) OR (k.strike_type = 'greater' AND round_even(s.fcst, 0) + i - 4 >= k.floor_s + 1) OR (k.strike_type = 'between' AND round_even(s.fcst, 0) + i - 4 BETWEEN k.floor_s AND k.cap_s) THEN s.p[i] ELSE 0 END)) AS q
 FROM s JOIN ({_SQ}) q ON q.city = s.city AND q.day = s.day AND q.us = s.us JOIN v_market k ON k.mkt = q.mkt)"""


@query("edge_training_rows", "city s, day d, us u, signal s, edge f, " + ", ".join(f"ev_{int(f*100)} f" for f in FILLS) + ", mkt_best s", _TR + "".join(
    f", b{i} AS (SELECT city, day, us, max(ev) AS ev, arg_min(mkt, struct_pack(a := -ev, b := mkt)) AS mkt FROM ({_BEST.format(fill=str(f) + 'e0', src='SELECT * FROM b')}) WHERE ev IS NOT NULL GROUP BY city, day, us)" for i, f in enumerate(FILLS)) + """
SELECT x.city, x.day, x.us, x.signal, x.edge, """ + ", ".join(f"b{i}.ev AS ev_{int(f*100)}" for i, f in enumerate(FILLS)) + """, b5.mkt AS mkt_best FROM (SELECT DISTINCT city, day, us, signal, edge FROM b) x """ + " ".join(f"LEFT JOIN b{i} ON b{i}.city = x.city AND b{i}.day = x.day AND b{i}.us = x.us" for i in range(6)))
def edge_training_rows(t):
    """Snapshot edges with the best trade under six maker fill probabilities at once:
    the fill grid is a set of columns, each bracket row is scored once per grid value.
    Class probabilities stand around the forecast base, half-even rounded; snapshots are
    numbered by hour and city and take the vectors in turn, so that none is without."""
    s = edges(t).select("city", "day", "us", "edge", "signal", F.bround("fcst", 0).alias("base_f"))
    p = t.probs.select("vec_id", "p", "classes")
    hour = F.floor(F.pmod(F.col("us"), N(86_400_000_000)) / 3_600_000_000)
    key = ((F.datediff("day", N("2024-01-01").cast("date")) * 14 + hour - 10) * 5 + F.array_position(F.array(*[N(c) for c in CITIES]), F.col("city")) - 1).cast("long")
    s = s.withColumn("vec_id", F.pmod(key, N(max(1, t.embeddings.count())))).join(p, "vec_id", "left")
    m = t.market.select("mkt", "strike_type", "floor_s", "cap_s")
    b = snap_quotes(t).join(m, "mkt").join(s, ["city", "day", "us"])
    b = b.withColumn("q", E.strike_mass("p", "classes", "base_f", "strike_type", "floor_s", "cap_s"))
    ev = {f"ev_{int(f * 100)}": T.best_trade("q", "bid", "ask", 3.0, f)["ev"] for f in FILLS}
    last = f"ev_{int(FILLS[-1] * 100)}"
    b = b.withColumns(ev)
    return b.groupBy("city", "day", "us", "signal", "edge").agg(*[F.max(c).alias(c) for c in ev],
        F.min_by("mkt", F.when(F.col(last).isNotNull(), F.struct((-F.col(last)).alias("e"), F.col("mkt")))).alias("mkt_best"))


@query("edge_backtest", "n i, n_signals i, signal_rate f, n_high i, high_win_rate f, n_low i, low_win_rate f, total_pnl i, mean_edge f", f"""
WITH e AS ({_EDGE}), x AS (SELECT e.*, CASE WHEN signal = 'buy_high' THEN CASE WHEN s.settle_f > round(mkt_implied, 6) THEN 1 ELSE -1 END WHEN signal = 'buy_low' THEN CASE WHEN s.settle_f < round(mkt_implied, 6) THEN 1 ELSE -1 END END AS o FROM e JOIN v_settle s ON s.city = e.city AND s.day = e.day)
SELECT count(*) AS n, count(o) AS n_signals, count(o) * 1.0e0 / count(*) AS signal_rate, count(*) FILTER (signal = 'buy_high') AS n_high, avg((o = 1)::INT) FILTER (signal = 'buy_high') AS high_win_rate, count(*) FILTER (signal = 'buy_low') AS n_low, avg((o = 1)::INT) FILTER (signal = 'buy_low') AS low_win_rate, sum(o) AS total_pnl, avg(abs(edge)) AS mean_edge FROM x""")
def edge_backtest(t):
    e = edges(t).join(t.settle.select("city", "day", "settle_f"), ["city", "day"])
    hi, lo = F.col("signal") == "buy_high", F.col("signal") == "buy_low"
    above, below = F.col("settle_f") > F.round("mkt_implied", 6), F.col("settle_f") < F.round("mkt_implied", 6)
    o = F.when(hi, F.when(above, 1).otherwise(-1)).when(lo, F.when(below, 1).otherwise(-1))
    e = e.withColumn("o", o)
    rate = lambda c: F.avg(F.when(c, (F.col("o") == 1).cast("double")))
    return e.agg(CNT().alias("n"), F.count("o").alias("n_signals"), (F.count("o") / CNT()).alias("signal_rate"), F.count_if(hi).alias("n_high"), rate(hi).alias("high_win_rate"),
                 F.count_if(lo).alias("n_low"), rate(lo).alias("low_win_rate"), F.sum("o").alias("total_pnl"), F.avg(F.abs("edge")).alias("mean_edge"))
