"""Common table expressions of the comparison SQL: the driver's tables reshaped as the adapters do it."""

from __future__ import annotations

from ..contract import FIXTURE as C

TICKER = "'S' || lpad(CAST({} AS VARCHAR), 6, '0')"

BARS = """
li AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice / l_quantity AS px, CAST(date_trunc('month', l_shipdate) AS DATE) AS dt FROM lineitem),
own0 AS (SELECT l_suppkey, dt, max(px) AS high, min(px) AS low, CAST(sum(l_quantity) AS BIGINT) AS volume FROM li GROUP BY 1, 2),
ends AS (SELECT l_suppkey, dt, px, row_number() OVER (PARTITION BY l_suppkey, dt ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS a,
  row_number() OVER (PARTITION BY l_suppkey, dt ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS b FROM li),
own AS (SELECT 'S' || lpad(CAST(o.l_suppkey AS VARCHAR), 6, '0') AS ticker, o.dt, f.px AS open, high, low,
  CASE WHEN o.l_suppkey % 7 = 0 AND o.dt < DATE '1998-01-01' THEN l.px * CAST(0.5 AS DOUBLE) ELSE l.px END AS close, l.px AS raw_close, volume
  FROM own0 o JOIN ends f ON f.l_suppkey = o.l_suppkey AND f.dt = o.dt AND f.a = 1 JOIN ends l ON l.l_suppkey = o.l_suppkey AND l.dt = o.dt AND l.b = 1),
bars AS (SELECT * FROM own UNION ALL SELECT 'SPY', dt, round(avg(open), 6), round(avg(high), 6), round(avg(low), 6), round(avg(raw_close), 6), round(avg(raw_close), 6), CAST(sum(volume) AS BIGINT) FROM own GROUP BY dt),
cal AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS idx FROM (SELECT DISTINCT dt FROM bars))"""

FEATURES = (
    BARS
    + """,
feat0 AS (SELECT b.*, idx, CASE WHEN raw_close > 0 AND volume > 0 THEN 1 ELSE 0 END AS ok, raw_close * volume AS dv FROM bars b JOIN cal ON cal.dt = b.dt),
feat1 AS (SELECT *, coalesce(idx - lag(idx, 59) OVER w = 59, false) AS history_complete_60d,
  close / lag(close, 5) OVER w - 1 AS return_5d, close / lag(close, 20) OVER w - 1 AS return_20d,
  CASE WHEN count(close) OVER w60 = 60 THEN close / max(close) OVER w60 - 1 END AS distance_to_60d_high,
  CASE WHEN count(dv) OVER w20 = 20 THEN avg(dv) OVER w20 END AS average_dollar_volume_20d,
  CASE WHEN count(volume) OVER w20 = 20 THEN avg(volume) OVER w20 END AS average_volume_20d,
  quantile_cont(CASE WHEN ok = 1 THEN dv END, 0.5) OVER p20 AS median_dollar_volume_prior_20d,
  CASE WHEN count(ok) OVER p20 = 20 THEN CAST(sum(ok) OVER p20 AS BIGINT) END AS valid_price_volume_sessions_prior_20d,
  coalesce(CASE WHEN count(volume) OVER w20 = 20 AND stddev_samp(volume) OVER w20 > 0 THEN (volume - avg(volume) OVER w20) / stddev_samp(volume) OVER w20 END, 0) AS volume_zscore_20
  FROM feat0 WINDOW w AS (PARTITION BY ticker ORDER BY idx), w20 AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
  w60 AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), p20 AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
feat AS (SELECT f.*, m.return_20d AS market_return_20d, f.return_20d - m.return_20d AS relative_strength_20d FROM feat1 f LEFT JOIN feat1 m ON m.ticker = 'SPY' AND m.dt = f.dt)"""
)

CANDIDATES = (
    FEATURES
    + f""",
elig AS (SELECT * FROM feat WHERE history_complete_60d AND raw_close >= {C.min_close} AND average_dollar_volume_20d >= {C.min_average_dollar_volume}
  AND median_dollar_volume_prior_20d >= {C.min_median_dollar_volume_prior} AND valid_price_volume_sessions_prior_20d >= {C.min_valid_sessions}),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY average_dollar_volume_20d DESC, ticker) AS liquidity_rank FROM elig
  WHERE ticker <> 'SPY' AND dt IN (SELECT dt FROM elig WHERE ticker = 'SPY')) WHERE liquidity_rank <= {C.max_candidates})"""
)


def average_rank(x: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / CAST(2 AS DOUBLE))"


_SIGNALS = ("return_5d", "return_20d", "distance_to_60d_high", "volume_zscore_20", "relative_strength_20d")
RANKING = (
    CANDIDATES
    + f""",
sig AS (SELECT ticker, dt, {", ".join(f"coalesce({s}, 0) AS {s}" for s in _SIGNALS)} FROM cand),
sc AS (SELECT ticker, dt AS decision_date, ({" + ".join(average_rank(s, "dt") for s in _SIGNALS)}) / 5 AS score FROM sig),
rnk AS (SELECT *, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker) AS rank FROM sc)"""
)

LABELS = f""",
lab0 AS (SELECT b.ticker, b.dt, b.close, idx, lead(idx, {C.horizon}) OVER w AS later, min(close) OVER (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {C.horizon} FOLLOWING) AS low
  FROM bars b JOIN cal ON cal.dt = b.dt WINDOW w AS (PARTITION BY ticker ORDER BY idx)),
lab AS (SELECT a.ticker, a.dt, c.dt AS result_date, a.close, f.close AS future_close, CASE WHEN a.later - a.idx = {C.horizon} THEN a.low END AS future_min_close,
  f.close / a.close - 1 AS forward_return, CASE WHEN a.later - a.idx = {C.horizon} THEN a.low END / a.close - 1 AS max_adverse_return
  FROM lab0 a JOIN cal c ON c.idx = a.idx + {C.horizon} JOIN bars f ON f.ticker = a.ticker AND f.dt = c.dt)"""

MATURED = (
    RANKING
    + LABELS
    + f""",
outc AS (SELECT r.*, count(*) OVER (PARTITION BY decision_date) AS universe_size, l.result_date, l.forward_return, l.max_adverse_return FROM rnk r LEFT JOIN lab l ON l.ticker = r.ticker AND l.dt = r.decision_date),
thr AS (SELECT decision_date, greatest(forward_return, {C.hit_return}) AS hit_threshold FROM (SELECT *, row_number() OVER (PARTITION BY decision_date ORDER BY forward_return, ticker) AS k,
  count(*) OVER (PARTITION BY decision_date) AS n, count(forward_return) OVER (PARTITION BY decision_date) AS m FROM outc) WHERE n = m AND k = ceil(n * CAST({C.hit_quantile} AS DOUBLE))),
mat AS (SELECT o.*, hit_threshold, CASE WHEN hit_threshold IS NOT NULL THEN forward_return >= hit_threshold END AS is_explosion,
  CASE WHEN hit_threshold IS NOT NULL THEN forward_return <= {C.severe_return} END AS is_severe_downside, CASE WHEN hit_threshold IS NOT NULL THEN forward_return <= {C.catastrophic_return} END AS is_catastrophic_loss,
  max_adverse_return <= {C.adverse_return} AS is_adverse_path FROM outc o LEFT JOIN thr t ON t.decision_date = o.decision_date)"""
)

DAYS = """
days AS (SELECT CAST(d AS DATE) AS session FROM range(TIMESTAMP '1995-01-02', TIMESTAMP '2002-01-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6),
dcal AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS idx, CAST(session AS TIMESTAMP) + CASE WHEN session = max(session) OVER (PARTITION BY date_trunc('month', session)) THEN INTERVAL 18 HOUR ELSE INTERVAL 21 HOUR END AS close_ts FROM days)"""

DECISIONS = (
    DAYS
    + f""",
dq AS (SELECT max(session) AS decision_date FROM days WHERE session >= DATE '1996-01-01' AND session < DATE '2001-10-01' GROUP BY date_trunc('quarter', session)),
dec AS (SELECT {TICKER.format("s_suppkey")} AS ticker, decision_date, d.idx AS d_idx, close_ts AS cutoff FROM supplier, dq JOIN dcal d ON d.session = decision_date)"""
)

FILINGS = f""",
fil AS (SELECT {TICKER.format("o_custkey % (SELECT count(*) FROM supplier)")} AS ticker, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS at,
  ['8-K', '6-K', 'S-3', '424B5', 'NT 10-Q', 'SC 13D', 'SC 13D/A', '10-K'][CAST(o_orderkey % 8 + 1 AS BIGINT)] AS form, ['2.02,9.01', '1.01', '9.01', '8.01', ''][CAST(o_orderkey % 5 + 1 AS BIGINT)] AS items, o_orderkey FROM orders),
file AS (SELECT f.*, (SELECT min(idx) FROM dcal WHERE close_ts >= f.at) AS idx FROM fil f)"""

INSIDER = f""",
buy AS (SELECT {TICKER.format("l_suppkey")} AS ticker, CAST(l_shipdate AS TIMESTAMP) AS at, l_quantity * (l_extendedprice / l_quantity) AS amount, l_partkey % 50 AS own, l_linenumber % 3 = 0 AS two,
  CASE WHEN l_linenumber <> 7 THEN l_linestatus = 'O' END AS plan, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS tx FROM lineitem WHERE l_returnflag <> 'N'),
buye AS (SELECT b.*, (SELECT min(idx) FROM dcal WHERE close_ts >= b.at) AS idx FROM buy b)"""
