"""DuckDB definitions of the derived tables, in dependency order.

They restate ``plans/tables.py`` independently; an oracle is prefixed with the
ones it mentions.
"""

VIEWS = {
    "v_obs": """
SELECT event_type AS city, ts, CAST(ts AS DATE) AS day, hour(ts) AS hour, epoch_us(ts) AS us, event_id, value AS temp_f,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 29 = 0 THEN -77.9 WHEN event_id % 31 = 0 THEN 151.0 ELSE value END::DOUBLE AS raw_f,
  CAST(user_id % 101 AS DOUBLE) AS humidity, CAST((event_id * 7) % 40 AS DOUBLE) AS wind, CAST((event_id * 7) % 40 + (event_id * 11) % 15 AS DOUBLE) AS gust, CAST((event_id * 13) % 101 AS DOUBLE) AS cloud
FROM events""",
    "v_obs2": "SELECT * REPLACE (temp_f - event_id % 5 AS temp_f) FROM v_obs",
    "v_settle": """
SELECT city, day, CAST(round_even(max(temp_f), 0) AS BIGINT) AS settle_f, max(temp_f) AS vc_max_f, day - DATE '2024-01-01' AS di
FROM v_obs GROUP BY city, day""",
    "v_fcst": """
SELECT city, day, di, lead, day - CAST(lead AS INTEGER) AS basis, CAST(settle_f + (di * lead) % 7 - 3 AS DOUBLE) AS tempmax_f
FROM v_settle, range(7) r(lead) WHERE (di + lead) % 11 <> 0""",
    "v_fcst_station": "SELECT city, day, tempmax_f + di % 3 - 1 AS tempmax_f FROM v_fcst WHERE lead = 1",
    "v_fcst_hourly": """
SELECT city, day, di, hour, epoch_us(CAST(day AS TIMESTAMP)) + hour * 3600000000 AS us,
  settle_f - 0.2::DOUBLE * (hour - 15) * (hour - 15) + ((di + hour) % 3) * 0.5::DOUBLE AS temp_f,
  CAST((di * 7 + hour * 13) % 101 AS DOUBLE) AS cloud, CAST((di * 5 + hour * 11) % 101 AS DOUBLE) AS humidity,
  settle_f - 0.2::DOUBLE * (hour - 15) * (hour - 15) + ((di + hour) % 3) * 0.5::DOUBLE - 5 - hour % 4 AS dew
FROM v_settle, range(24) r(hour) WHERE (di + hour) % 13 <> 0""",
    "v_market0": """
SELECT city, day, di, j, settle_f,
  CASE WHEN j BETWEEN 1 AND 4 THEN c - 5 + 2 * (j - 1) WHEN j = 5 THEN c + 2 END AS fl,
  CASE WHEN j = 0 THEN c - 6 WHEN j BETWEEN 1 AND 4 THEN c - 4 + 2 * (j - 1) END AS cp
FROM (SELECT *, settle_f + (di * 3) % 9 - 4 AS c FROM v_settle), range(6) r(j)""",
    "v_market": """
SELECT city, day, di, j, city || '|' || strftime(day, '%Y%m%d') || '|' || j AS mkt,
  'HIGH' || upper(substr(city, 1, 3)) || '-' || upper(strftime(day, '%y%b%d')) || '-' ||
    CASE WHEN j = 0 THEN 'T' || cp || 'LO' WHEN j = 5 THEN 'T' || fl ELSE 'B' || fl || '.5' END AS ticker,
  CASE WHEN j = 0 THEN 'less' WHEN j = 5 THEN 'greater' ELSE 'between' END AS strike_type,
  CAST(fl AS DOUBLE) AS floor_s, CAST(cp AS DOUBLE) AS cap_s,
  epoch_us(CAST(day AS TIMESTAMP)) - 36000000000 AS listed_us, epoch_us(CAST(day AS TIMESTAMP)) + 79200000000 AS close_us,
  CASE WHEN (j = 0 AND settle_f <= cp) OR (j = 5 AND settle_f >= fl + 1) OR (j BETWEEN 1 AND 4 AND settle_f BETWEEN fl AND cp)
    THEN 'yes' ELSE 'no' END AS result
FROM v_market0""",
    "v_quote": """
SELECT event_type AS city, CAST(ts AS DATE) AS day, CAST(user_id % 6 AS INTEGER) AS j,
  event_type || '|' || strftime(ts, '%Y%m%d') || '|' || (user_id % 6) AS mkt,
  epoch_us(ts) AS us, epoch_us(ts) - epoch_us(ts) % 60000000 AS bucket_us, event_id,
  1 + event_id % 90 AS bid, 1 + event_id % 90 + 1 + event_id % 7 AS ask,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 1 + event_id % 90 END AS bid_n, user_id % 5 AS volume, event_id % 1000 AS oi
FROM events""",
    "v_candle": """
SELECT city, day, j, mkt, bucket_us, arg_max(bid, event_id) AS bid, arg_max(ask, event_id) AS ask,
  arg_max(bid_n, event_id) FILTER (bid_n IS NOT NULL) AS bid_n, CAST(sum(volume) AS BIGINT) AS volume, arg_max(oi, event_id) AS oi
FROM v_quote GROUP BY city, day, j, mkt, bucket_us""",
    "v_trade": """
SELECT event_type AS city, CAST(ts AS DATE) AS day, CAST(user_id % 6 AS INTEGER) AS j,
  event_type || '|' || strftime(ts, '%Y%m%d') || '|' || (user_id % 6) AS mkt, ts, epoch_us(ts) AS us, event_id AS seq,
  1 + event_id % 98 AS price, 1 + user_id % 5 AS cnt
FROM events""",
    "v_snap": """
SELECT city, day, di, settle_f, hour, epoch_us(CAST(day AS TIMESTAMP)) + hour * 3600000000 AS us
FROM v_settle, range(10, 24) r(hour)""",
    "v_probs0": """
SELECT vec_id, label, [list_sum([abs(embedding[i]::DOUBLE) for i in range(1, len(embedding) + 1) if (i - 1) % 7 = k]) for k in range(7)] AS r FROM embeddings""",
    "v_probs": """
SELECT vec_id, list_transform(r, lambda x: x / list_sum(r)) AS p, [-3,-2,-1,0,1,2,3] AS classes,
  ((label % 7) + 7) % 7 - 3 AS y, 60 + vec_id % 40 AS t_base FROM v_probs0""",
    "v_probs_long": """
SELECT vec_id, y, t_base, i - 1 AS i, p[i] AS p, i - 4 AS k FROM v_probs, range(1, 8) r(i)""",
    "v_bt": """
SELECT l_returnflag || '-' || l_linestatus AS city, CAST(l_shipdate AS DATE) AS day, l_orderkey AS ok, l_linenumber AS ln,
  l_partkey AS pk, l_suppkey AS sk, (l_quantity - 25) / 2 AS edge,
  CAST(floor((CAST(round(l_discount * 100) AS BIGINT) - 5) * l_extendedprice / 1000) AS BIGINT) AS pnl,
  ((l_partkey * 37 + l_orderkey * 11) % 1000) / 1000::DOUBLE AS prob, 1 + l_partkey % 98 AS price, 1 + l_suppkey % 20 AS n,
  CASE WHEN (l_suppkey + l_orderkey) % 5 < 2 THEN 1 ELSE 0 END AS won
FROM lineitem""",
    "v_run": """
SELECT o_orderpriority AS city, CAST(o_orderdate AS DATE) AS day, ['nbm','hrrr','ndfd'][o_orderkey % 3 + 1] AS model,
  o_orderkey AS run_id, o_totalprice / 5000 AS peak_f, o_custkey AS cust
FROM orders""",
}
