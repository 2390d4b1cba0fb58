"""Market queries in portable SQL: indicators, windows, joins, aggregates, strategies, metrics, portfolios.

Every entry runs on whole tables. Rolling windows are null until full, as is
usual for indicators; ratios guard their divisors.
"""

from __future__ import annotations

from tidemark.plans.views import lagged, over, rolled, rounded, with_views

SQL: dict[str, str] = {}


def add(name: str, body: str, *views: str) -> None:
    SQL[name] = with_views(body, *views)


PC, TR = lagged("close"), f"greatest(high - low, abs(high - {lagged('close')}), abs(low - {lagged('close')}))"

# --- bars and indicators -----------------------------------------------------------------------------------
add("bars_daily", "SELECT symbol, ts, open, high, low, close, volume FROM bars", "bars")
add("ind_bollinger", f"""+ b AS (SELECT symbol, ts, close, {rolled("avg", "close", 20)} AS mid, {rolled("stddev_samp", "close", 20)} AS sd FROM bars)
SELECT symbol, ts, round(mid, 4) AS bb_middle, round(mid + 2 * sd, 4) AS bb_upper, round(mid - 2 * sd, 4) AS bb_lower,
  round(4 * sd / nullif(mid, 0), 4) AS bb_width, round((close - mid + 2 * sd) / nullif(4 * sd, 0), 4) AS bb_position FROM b""", "bars")
RSI = f"""d AS (SELECT symbol, ts, close, coalesce(greatest(close - {PC}, 0), 0) AS gain, coalesce(greatest({PC} - close, 0), 0) AS loss FROM bars),
g AS (SELECT symbol, ts, close, {rolled("avg", "gain", 14)} AS gain, {rolled("avg", "loss", 14)} AS loss FROM d),
r AS (SELECT symbol, ts, close, 100 - 100 / (1 + gain / nullif(round(loss, 9), 0)) AS rsi FROM g)"""
add("ind_rsi", f"+ {RSI} SELECT symbol, ts, round(rsi, 4) AS rsi, round({rolled('avg', 'rsi', 5)}, 4) AS rsi_sma FROM r", "bars")
add("ind_atr", f"""+ t AS (SELECT symbol, ts, close, coalesce({TR}, high - low) AS tr FROM bars), a AS (SELECT symbol, ts, close, {rolled("avg", "tr", 14)} AS atr FROM t)
SELECT symbol, ts, round(atr, 4) AS atr, round(100 * atr / close, 4) AS atr_pct, round(-200 * atr / close, 4) AS stop_pct FROM a""", "bars")
add("ind_volume", f"""+ v AS (SELECT *, {PC} AS pc, {rolled("avg", "volume", 20)} AS v20 FROM bars)
SELECT symbol, ts, round(v20, 4) AS volume_sma, round(volume / nullif(v20, 0), 4) AS relative_volume,
  CASE WHEN pc IS NOT NULL THEN round(sum(volume * (close - pc) / pc) {over()}, 3) END AS vpt, CASE WHEN pc IS NOT NULL THEN sum(sign(close - pc) * volume) {over()} END AS obv,
  round(sum(volume * (high + low + close) / 3) {over()} / sum(volume) {over()}, 3) AS vwap_proxy FROM v""", "bars")
add("ind_momentum", "SELECT symbol, ts, " + ", ".join(f"round(100 * (close / {lagged('close', k)} - 1), 4) AS momentum_{k}d" for k in (5, 10, 20, 60, 252)) + f", round(100 * ({lagged('close', 21)} / {lagged('close', 252)} - 1), 4) AS momentum_12_1 FROM bars", "bars")
add("ind_extremes", f"""+ x AS (SELECT symbol, ts, high, low, close, {rolled("max", "high", 20)} AS high_20, {rolled("min", "low", 20)} AS low_20, {rolled("max", "high", 252)} AS high_52w, {rolled("min", "low", 252)} AS low_52w FROM bars)
SELECT symbol, ts, high_20, low_20, high_52w, low_52w, round(100 * (close - high_52w) / high_52w, 4) AS dist_from_high, round(100 * (high_20 - close) / close, 4) AS dist_to_resistance,
  round(100 * (close - low_20) / close, 4) AS dist_to_support, round((high + low + close) / 3, 4) AS pivot_point, round(2 * (high + low + close) / 3 - low, 4) AS r1, round(2 * (high + low + close) / 3 - high, 4) AS s1 FROM x""", "bars")
add("ind_volatility", f"""+ x AS (SELECT *, close / {PC} - 1 AS lr, pow(ln(high / low), 2) AS hl FROM bars),
y AS (SELECT symbol, ts, {", ".join(f"100 * sqrt(252) * {rolled('stddev_samp', 'lr', n)} AS rv{n}" for n in (5, 10, 21, 63))}, {rolled("avg", "hl", 21)} AS hl FROM x)
SELECT symbol, ts, {", ".join(f"round(rv{n}, 3) AS realized_vol_{n}d" for n in (5, 10, 21, 63))}, round(100 * sqrt(252 * hl / (4 * ln(2))), 3) AS parkinson_vol, round(rv5 / nullif(rv63, 0), 4) AS vol_ratio FROM y""", "bars")
add("ind_trend", f"""+ x AS (SELECT symbol, ts, close, {", ".join(f"{rolled('avg', 'close', n)} AS s{n}" for n in (10, 20, 50, 200))} FROM bars)
SELECT symbol, ts, {", ".join(f"round(s{n}, 4) AS sma_{n}" for n in (10, 20, 50, 200))}, {", ".join(f"coalesce(CAST(round(close - s{n}, 6) > 0 AS INT), 0) AS above_sma{n}" for n in (20, 50, 200))} FROM x""", "bars")
GAP = f"""g AS (SELECT *, {PC} AS pc, 100 * (open - {PC}) / {PC} AS gap FROM bars)"""
add("ind_gap", f"""+ {GAP} SELECT symbol, ts, round(gap, 4) AS gap_pct, CASE WHEN gap > 0 THEN 'up' WHEN gap < 0 THEN 'down' ELSE 'none' END AS gap_direction,
  CASE WHEN abs(gap) > 2 THEN 'large' WHEN abs(gap) > 1 THEN 'medium' WHEN abs(gap) > 0.5 THEN 'small' WHEN abs(gap) > 0.15 THEN 'tiny' ELSE 'minimal' END AS gap_size,
  coalesce(CASE WHEN gap > 0 THEN low <= pc ELSE high >= pc END, false) AS gap_filled, coalesce(abs(gap) BETWEEN 0.15 AND 0.60, false) AS tradeable,
  round(CASE WHEN abs(gap) < 1e-4 THEN 1.0 WHEN gap > 0 THEN (open - close) / (open - pc) ELSE (close - open) / (pc - open) END, 4) AS fill_share FROM g""", "bars")
add("ind_divergence", f"""+ {RSI}, e AS (SELECT *, {rolled("min", "close", 5)} AS pl, {rolled("max", "close", 5)} AS ph, min(rsi) {over(5)} AS il, max(rsi) {over(5)} AS ih FROM r),
f AS (SELECT *, {lagged("pl", 5)} AS pl5, {lagged("ph", 5)} AS ph5, {lagged("il", 5)} AS il5, {lagged("ih", 5)} AS ih5 FROM e)
SELECT symbol, ts, coalesce(pl < pl5 AND round(il - il5, 6) > 0, false) AS bullish, coalesce(ph > ph5 AND round(ih - ih5, 6) < 0, false) AS bearish FROM f""", "bars")
add("ind_candles", """SELECT symbol, ts, round(100 * (high - low) / low, 4) AS bar_range, round(100 * (close - open) / open, 4) AS bar_body,
  round(CASE WHEN high > low THEN 100 * (high - greatest(open, close)) / (high - low) ELSE 0 END, 4) AS upper_wick, round(CASE WHEN high > low THEN 100 * (least(open, close) - low) / (high - low) ELSE 0 END, 4) AS lower_wick FROM bars""", "bars")
DAY = over(None, "symbol, day", "ts, event_id")
CENTS = f"sum(floor(price * 100 + 5e-1) * size) {DAY}"
add("ind_session", f"""SELECT symbol, event_id, round({CENTS} / sum(size) {DAY} / 1e2, 4) AS vwap, round(100 * (price * sum(size) {DAY} * 1e2 / {CENTS} - 1), 4) AS vwap_distance,
  max(price) {DAY} AS day_high, min(price) {DAY} AS day_low, count(*) {DAY} AS bars_since_open, greatest(0, 390 - count(*) {DAY}) AS bars_until_close,
  CAST(size / avg(size) {over(20, "symbol", "ts, event_id")} AS DOUBLE) > 1 AS busy FROM ticks""", "ticks")
add("ind_opening_range", """+ r AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts, event_id) AS rn FROM ticks)
SELECT symbol, day, max(CASE WHEN rn <= 5 THEN price END) AS or_high, min(CASE WHEN rn <= 5 THEN price END) AS or_low,
  round(100 * (max(CASE WHEN rn <= 5 THEN price END) / min(CASE WHEN rn <= 5 THEN price END) - 1), 4) AS or_size, max(price) AS high, min(price) AS low, count(*) AS n FROM r GROUP BY symbol, day""", "ticks")

# --- windows ----------------------------------------------------------------------------------------------
add("win_rank_pct", """SELECT symbol, ts, round((rank() OVER (PARTITION BY ts ORDER BY volume) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2) / count(volume) OVER (PARTITION BY ts), 6) AS rank_pct,
  CAST(row_number() OVER (PARTITION BY ts ORDER BY volume DESC, symbol) - 1 AS BIGINT) AS place, round(1 - (row_number() OVER (PARTITION BY ts ORDER BY volume DESC, symbol) - 1) / count(*) OVER (PARTITION BY ts) * 0.5, 6) AS strength FROM bars""", "bars")
add("win_spearman", """+ k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2 AS rv, rank() OVER (PARTITION BY symbol ORDER BY close) + (count(*) OVER (PARTITION BY symbol, close) - 1) / 2 AS rc FROM bars)
SELECT symbol, round(corr(rv, rc), 6) AS spearman, count(*) AS n FROM k GROUP BY symbol""", "bars")
add("win_rolling_stats", f"""SELECT symbol, ts, round({rolled("avg", "ret", 60)} / nullif({rolled("stddev_samp", "ret", 60)}, 0) * sqrt(252), 4) AS sharpe_60, round((close - {rolled("avg", "close", 60)}) / nullif({rolled("stddev_samp", "close", 60)}, 0), 4) AS z_60,
  round({rolled("sum", "ret", 20)}, 6) AS ret_20, round(sum(ret) {over()}, 6) AS cumulative, round({rolled("corr", "close", 20).replace("corr(close)", "corr(close, volume)")}, 4) AS corr_20 FROM rets""", "rets")
add("win_streaks", f"""+ f AS (SELECT strategy, trade_id, exit_ts, pnl, row_number() OVER (PARTITION BY strategy ORDER BY exit_ts, trade_id, symbol, qty, price, pnl) AS rn FROM trades),
i AS (SELECT *, sum(CASE WHEN pnl >= 0 THEN 1 ELSE 0 END) {over(None, "strategy", "rn")} AS island FROM f)
SELECT strategy, max(n) AS longest_losses, count(*) AS runs FROM (SELECT strategy, island, count(*) AS n FROM i WHERE pnl < 0 GROUP BY strategy, island) t GROUP BY strategy""", "trades")
add("win_crossover", f"""+ s AS (SELECT symbol, ts, {rolled("avg", "close", 10)} AS fast, {rolled("avg", "close", 30)} AS slow FROM bars), d AS (SELECT symbol, ts, round(fast - slow, 6) AS gap FROM s), p AS (SELECT *, {lagged("gap")} AS before FROM d)
SELECT symbol, ts, CASE WHEN before <= 0 AND gap > 0 THEN 'golden' ELSE 'death' END AS signal FROM p WHERE before <= 0 AND gap > 0 OR before >= 0 AND gap < 0""", "bars")
add("win_month_first", "SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(date_trunc('month', ts) AS DATE) ORDER BY ts) AS rn FROM bars) t WHERE rn = 1", "bars")
add("win_drawdown", f"""+ e AS (SELECT symbol, ts, close, max(close) {over()} AS peak FROM bars), d AS (SELECT *, (close - peak) / peak AS dd, peak - close AS lost FROM e)
SELECT symbol, round(min(dd), 6) AS max_drawdown, round(max(lost), 2) AS max_drawdown_value, min_by(ts, (round(dd, 9), ts)) AS trough, count(CASE WHEN dd < 0 THEN 1 END) AS days_under FROM d GROUP BY symbol""", "bars")
add("win_autocorr", f"+ x AS (SELECT symbol, ret, {lagged('ret')} AS before FROM rets) SELECT symbol, round(corr(ret, before), 6) AS autocorr FROM x GROUP BY symbol", "rets")
add("win_regime_changes", """+ r AS (SELECT ts, CASE WHEN vix < 15 THEN 'low' WHEN vix < 25 THEN 'normal' WHEN vix < 35 THEN 'high' ELSE 'extreme' END AS regime FROM market), c AS (SELECT *, lag(regime) OVER (ORDER BY ts) AS before, lag(regime, 2) OVER (ORDER BY ts) AS before2 FROM r)
SELECT ts, before, regime, coalesce(before = before2, true) AS was_confirmed FROM c WHERE regime <> before""", "market")
add("win_snapshots", """+ e AS (SELECT CAST(exit_ts AS DATE) AS day, round(sum(pnl), 2) AS pnl FROM trades GROUP BY CAST(exit_ts AS DATE)), c AS (SELECT day, pnl, round(1e6 + sum(pnl) OVER (ORDER BY day), 2) AS equity FROM e), h AS (SELECT *, max(equity) OVER (ORDER BY day) AS high_water FROM c)
SELECT day, pnl, equity, high_water, round((equity - high_water) / high_water, 6) AS drawdown FROM h""", "trades")

# --- joins ------------------------------------------------------------------------------------------------
add("join_pairs", """+ p AS (SELECT a.symbol AS a, b.symbol AS b, a.industry FROM sectors a JOIN sectors b ON a.industry = b.industry AND a.symbol < b.symbol),
j AS (SELECT p.a, p.b, p.industry, x.ts, x.close AS ca, y.close AS cb FROM p JOIN bars x ON x.symbol = p.a JOIN bars y ON y.symbol = p.b AND y.ts = x.ts)
SELECT a, b, industry, count(*) AS n, round(corr(ca, cb), 6) AS correlation, round(regr_slope(ca, cb), 6) AS hedge, round(avg(ln(ca) - ln(cb)), 6) AS spread FROM j GROUP BY a, b, industry HAVING count(*) >= 20""", "bars", "sectors")
# Positions (customers) whose signal (an open order of this year) is missing or cancelled.
SQL["join_orphans"] = """SELECT c_custkey, c_name, c_nationkey, o_orderkey, o_orderstatus FROM {customer} LEFT JOIN (SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders} WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00') o ON c_custkey = o_custkey
WHERE o_orderkey IS NULL OR o_orderstatus IN ('P', 'F')"""
add("join_beta", "SELECT r.symbol, count(*) AS n, round(covar_samp(r.ret, m.ret) / nullif(var_samp(m.ret), 0), 6) AS beta, round(corr(r.ret, m.ret), 6) AS correlation, round(stddev_samp(r.ret - m.ret), 6) AS tracking_error FROM rets r JOIN market m ON r.ts = m.ts WHERE r.ret IS NOT NULL GROUP BY r.symbol", "rets", "market")
add("join_first_best", "+ best AS (SELECT strategy, max(pnl) AS best FROM trades GROUP BY strategy) SELECT t.strategy, best, min(exit_ts) AS first_reached FROM trades t JOIN best b ON t.strategy = b.strategy AND t.pnl = b.best GROUP BY t.strategy, best", "trades")
add("join_high_vol_days", "+ h AS (SELECT ts FROM market WHERE vix >= 25) SELECT symbol, count(*) AS n, round(avg(ret), 6) AS mean_ret FROM rets r WHERE EXISTS (SELECT 1 FROM h WHERE h.ts = r.ts) GROUP BY symbol", "rets", "market")
POP = "pop AS (SELECT symbol, round(avg(ret), 8) AS gain, round(-stddev_samp(ret), 8) AS calm, round(avg(volume), 4) AS liquid, count(*) + 0.0 AS n FROM rets GROUP BY symbol)"
add("join_pareto", f"+ {POP} SELECT symbol, gain, calm, liquid FROM pop p WHERE NOT EXISTS (SELECT 1 FROM pop q WHERE q.gain >= p.gain AND q.calm >= p.calm AND q.liquid >= p.liquid AND (q.gain > p.gain OR q.calm > p.calm OR q.liquid > p.liquid))", "rets")
add("join_novelty", f"""+ {POP}, d AS (SELECT a.symbol, sqrt(pow(1e3 * (a.gain - b.gain), 2) + pow(10 * (a.calm - b.calm), 2) + pow(a.liquid - b.liquid, 2)) AS dist FROM pop a JOIN pop b ON a.symbol <> b.symbol), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dist) AS rn FROM d)
SELECT symbol, round(avg(dist), 4) AS novelty FROM k WHERE rn <= 5 GROUP BY symbol""", "rets")

# --- aggregates -------------------------------------------------------------------------------------------
STATS = "count(*) AS trades, count(CASE WHEN pnl > 0 THEN 1 END) AS wins, count(CASE WHEN pnl <= 0 THEN 1 END) AS losses, round(sum(pnl), 2) AS total_pnl, round(avg(pnl), 4) AS avg_pnl, round(avg(pnl_pct), 4) AS avg_pnl_pct, round(avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate, max(pnl) AS best, min(pnl) AS worst, round(least(10, sum(CASE WHEN pnl > 0 THEN pnl END) / nullif(-sum(CASE WHEN pnl < 0 THEN pnl END), 0)), 4) AS profit_factor"
for name, key in (("strategy", "strategy"), ("exit_reason", "exit_reason"), ("symbol", "symbol"), ("side", "side"), ("month", "CAST(date_trunc('month', exit_ts) AS DATE)")):
    add(f"agg_trades_by_{name}", f"SELECT {key} AS {name}, {STATS} FROM trades GROUP BY {key}", "trades")
add("agg_daily_pnl", "SELECT strategy, CAST(exit_ts AS DATE) AS day, count(*) AS trades, count(CASE WHEN pnl > 0 THEN 1 END) AS wins, count(CASE WHEN pnl < 0 THEN 1 END) AS losses, round(sum(pnl), 2) AS pnl FROM trades GROUP BY strategy, CAST(exit_ts AS DATE)", "trades")
SLIP = "count(*) AS n, round(avg(slippage_bps), 4) AS mean_bps, median(slippage_bps) AS median_bps, round(coalesce(stddev_samp(slippage_bps), 0), 4) AS std_bps, min(slippage_bps) AS min_bps, max(slippage_bps) AS max_bps, round(sum(slippage_bps * price * qty / 1e4), 2) AS dollars"
BUCKET = "CASE WHEN qty < 10 THEN '<10' WHEN qty < 25 THEN '10-25' WHEN qty < 40 THEN '25-40' ELSE '>40' END"
for name, key in (("strategy", "strategy"), ("symbol", "symbol"), ("size", BUCKET)):
    add(f"agg_slippage_by_{name}", f"SELECT {key} AS {name}, {SLIP} FROM trades GROUP BY {key}", "trades")
add("agg_execution", "SELECT round(avg(slippage_bps), 2) AS mean_bps, median(slippage_bps) AS median_bps, max(slippage_bps) AS worst_bps, round(avg(CASE WHEN side = 'buy' THEN slippage_bps END), 2) AS buy_bps, round(avg(CASE WHEN side = 'sell' THEN slippage_bps END), 2) AS sell_bps, count(CASE WHEN slippage_bps > 45 THEN 1 END) AS alerts, round(avg(extract(HOUR FROM exit_ts)), 4) AS mean_hour FROM trades", "trades")
add("agg_fallback", """+ n AS (SELECT strategy, side, symbol, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END) AS win FROM trades GROUP BY strategy, side, symbol), b AS (SELECT strategy, side, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END) AS win FROM trades GROUP BY strategy, side)
SELECT n.strategy, n.side, n.symbol, CAST(round(CASE WHEN n.n >= 20 THEN n.win WHEN b.n >= 5 THEN b.win ELSE 5e-1 END, 6) AS DOUBLE) AS win_rate, n.n >= 20 AS own FROM n JOIN b ON n.strategy = b.strategy AND n.side = b.side""", "trades")
add("agg_best_condition", "+ m AS (SELECT strategy, exit_reason, side, round(avg(pnl), 6) AS mean FROM trades GROUP BY strategy, exit_reason, side) SELECT strategy, max_by(exit_reason, (mean, exit_reason, side)) AS best_reason, max_by(side, (mean, exit_reason, side)) AS best_side, max(mean) AS best_mean FROM m GROUP BY strategy", "trades")
add("agg_concentration", "+ s AS (SELECT strategy, symbol, round(sum(abs(pnl)), 2) AS held FROM trades GROUP BY strategy, symbol), w AS (SELECT *, held / sum(held) OVER (PARTITION BY strategy) AS share FROM s) SELECT strategy, round(1e4 * sum(share * share), 3) AS hhi, round(100 * max(share), 4) AS largest_pct, round(-sum(share * log2(share)) / log2(count(*)), 6) AS entropy FROM w GROUP BY strategy", "trades")
# Symbols of one count are summed before the running place: the window holds the distinct counts only.
add("agg_gini", """+ c AS (SELECT symbol, count(*) AS n FROM trades GROUP BY symbol), f AS (SELECT n, count(*) AS f FROM c GROUP BY n),
r AS (SELECT n, f, sum(f) OVER (ORDER BY n) - f AS before FROM f)
SELECT round(2 * sum(n * (f * before + f * (f + 1) / 2)) / (sum(f) * sum(n * f)) - (sum(f) + 1) / sum(f), 6) AS gini, sum(f) AS kinds FROM r""", "trades")
add("agg_regime_days", """+ k AS (SELECT 'low' AS regime, 0 AS lo, 15 AS hi UNION ALL SELECT 'normal', 15, 25 UNION ALL SELECT 'high', 25, 35 UNION ALL SELECT 'extreme', 35, 1000)
SELECT regime, count(ts) AS days, round(100 * count(ts) / sum(count(ts)) OVER (), 4) AS pct, round(avg(vix), 4) AS mean_vix FROM k LEFT JOIN market ON vix >= lo AND vix < hi GROUP BY regime""", "market")
add("agg_regime_performance", "+ x AS (SELECT CASE WHEN vix < 15 THEN 'low' WHEN vix < 25 THEN 'normal' WHEN vix < 35 THEN 'high' ELSE 'extreme' END AS regime, r.symbol, r.ret FROM rets r JOIN market m ON r.ts = m.ts WHERE r.ret IS NOT NULL) SELECT regime, symbol, count(*) AS n, round(252 * avg(ret), 5) AS annual, round(sqrt(252) * avg(ret) / nullif(stddev_samp(ret), 0), 4) AS sharpe, round(avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate FROM x GROUP BY regime, symbol HAVING count(*) >= 10", "rets", "market")
add("agg_industry_z", f"""+ x AS (SELECT b.symbol, b.ts, s.industry, b.close / {lagged("close", 20)} - 1 AS ret20, b.close * b.volume AS dollars FROM bars b JOIN sectors s ON b.symbol = s.symbol), l AS (SELECT symbol, industry, max_by(ret20, ts) AS ret20, avg(dollars) AS dollars FROM x WHERE ret20 IS NOT NULL GROUP BY symbol, industry)
SELECT symbol, industry, round(ret20, 6) AS ret20, count(*) OVER (PARTITION BY industry) AS peers, round((ret20 - avg(ret20) OVER (PARTITION BY industry)) / greatest(stddev_pop(ret20) OVER (PARTITION BY industry), 0.001), 4) AS z FROM l""".replace("PARTITION BY symbol ORDER BY ts", "PARTITION BY b.symbol ORDER BY b.ts").replace("lag(close", "lag(b.close"), "bars", "sectors")
add("agg_breadth", f"+ x AS (SELECT symbol, ts, close, {rolled('avg', 'close', 50)} AS s50, {lagged('close', 19)} AS c20 FROM bars) SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n, round(100 * avg(CASE WHEN round(close - s50, 6) > 0 THEN 1e0 ELSE 0e0 END), 4) AS above_50, round(100 * avg(CASE WHEN close > c20 THEN 1e0 ELSE 0e0 END), 4) AS rising FROM x WHERE s50 IS NOT NULL GROUP BY CAST(date_trunc('month', ts) AS DATE) HAVING count(*) >= 20", "bars")
add("agg_sensitivity", "+ m AS (SELECT strategy, CAST(floor(qty / 10) AS INT) AS value, avg(pnl_pct) AS mean FROM trades GROUP BY strategy, CAST(floor(qty / 10) AS INT)) SELECT strategy, count(*) AS values_tried, round(stddev_pop(mean) / (abs(avg(mean)) + 1e-6), 4) AS sensitivity FROM m GROUP BY strategy", "trades")
add("agg_universe", """+ l AS (SELECT symbol, round(avg(close * volume), 4) AS dollars, stddev_samp(ret) * sqrt(252) AS vol FROM rets GROUP BY symbol), t AS (SELECT CASE WHEN dollars >= 40000 THEN 'high' WHEN dollars >= 35000 THEN 'medium' ELSE 'low' END AS liquidity, CASE WHEN vol < 0.15 THEN 'calm' WHEN vol < 0.5 THEN 'usual' ELSE 'wild' END AS volatility FROM l)
SELECT liquidity, volatility, count(*) AS n FROM t GROUP BY GROUPING SETS ((liquidity), (volatility), (liquidity, volatility))""", "rets")

# --- sorting and sets -------------------------------------------------------------------------------------
add("top_latest_bars", "SELECT symbol, ts, close FROM bars ORDER BY ts DESC, symbol LIMIT 200", "bars")
add("top_latest_per_symbol", "SELECT symbol, max(ts) AS ts, max_by(close, ts) AS close FROM bars GROUP BY symbol", "bars")
add("top_per_sector", "SELECT sector, symbol, total FROM (SELECT sector, b.symbol, sum(volume) AS total, row_number() OVER (PARTITION BY sector ORDER BY sum(volume) DESC, b.symbol) AS rn FROM bars b JOIN sectors s ON b.symbol = s.symbol GROUP BY sector, b.symbol) t WHERE rn <= 3", "bars", "sectors")
add("top_fraction", "+ m AS (SELECT symbol, ts, close / lag(close, 60) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS mom FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY mom DESC, symbol) AS rn, count(*) OVER (PARTITION BY ts) AS n FROM m WHERE mom IS NOT NULL) SELECT ts, symbol, round(mom, 6) AS mom FROM k WHERE rn <= greatest(floor(n * 0.15), 1)", "bars")
add("top_two_stage", "+ v AS (SELECT symbol, avg(close) AS price, avg(volume) AS vol FROM bars GROUP BY symbol), q AS (SELECT *, row_number() OVER (ORDER BY price, symbol) AS rn, count(*) OVER () AS n FROM v) SELECT symbol, round(price, 4) AS price, round(vol, 4) AS vol FROM q WHERE rn <= floor(n * 0.25) ORDER BY vol DESC, symbol LIMIT 10", "bars")
add("top_crowding", f"+ {POP} SELECT symbol, CASE WHEN lag(gain) OVER (ORDER BY gain, symbol) IS NULL OR lead(gain) OVER (ORDER BY gain, symbol) IS NULL THEN CAST('Infinity' AS DOUBLE) ELSE round((lead(gain) OVER (ORDER BY gain, symbol) - lag(gain) OVER (ORDER BY gain, symbol)) / (max(gain) OVER () - min(gain) OVER ()), 6) END AS crowding FROM pop", "rets")
add("set_calendar", "+ n AS (SELECT ts, count(DISTINCT symbol) AS symbols FROM bars GROUP BY ts) SELECT ts, symbols, symbols >= 50 AS broad FROM n", "bars")
add("set_rebalance", "+ q AS (SELECT DISTINCT symbol FROM bars WHERE close > open AND volume >= 100), h AS (SELECT DISTINCT symbol FROM bars WHERE close < open AND volume >= 100) SELECT symbol, 'open' AS action FROM (SELECT symbol FROM q EXCEPT SELECT symbol FROM h) a UNION ALL SELECT symbol, 'close' FROM (SELECT symbol FROM h EXCEPT SELECT symbol FROM q) b UNION ALL SELECT symbol, 'hold' FROM (SELECT symbol FROM q INTERSECT SELECT symbol FROM h) c", "bars")
add("set_latest_wins", "+ u AS (SELECT symbol, ts, close, 1 AS gen FROM bars UNION ALL SELECT symbol, ts, close + 1, 2 FROM bars WHERE volume > 40) SELECT symbol, ts, max_by(close, gen) AS close FROM u GROUP BY symbol, ts", "bars")

# --- scalar functions -------------------------------------------------------------------------------------
SQL["fn_buckets"] = """SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN 'low' WHEN p_retailprice < 1100 THEN 'normal' WHEN p_retailprice < 1500 THEN 'high' ELSE 'extreme' END AS regime,
  CAST(CASE WHEN p_size >= 40 THEN 0.003 WHEN p_size >= 30 THEN 0.005 WHEN p_size >= 20 THEN 0.015 WHEN p_size >= 10 THEN 0.03 ELSE 0.05 END AS DOUBLE) AS cost,
  CAST(CASE WHEN p_size < 5 THEN 0.7 WHEN p_size < 12 THEN 1.0 WHEN p_size < 25 THEN 1.3 ELSE 2.0 END AS DOUBLE) AS stop_multiplier,
  CAST(floor(least(1.0, greatest(0.0, (p_retailprice - 900) / 200)) * 9) AS BIGINT) AS cell, round(greatest(1 - 0.4 * least(p_size / 50.0, 1), 0) + 0e0, 6) AS strength FROM {part}"""
SQL["fn_dates"] = """SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS year, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS month, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS day, CAST(extract(HOUR FROM o_orderdate) AS BIGINT) AS hour, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS DATE) AS month_start, extract(DAY FROM o_orderdate) >= 21 AS late FROM {orders}"""
SQL["fn_strings"] = """SELECT a.n_nationkey AS a, b.n_nationkey AS b, concat(least(a.n_name, b.n_name), '_', greatest(a.n_name, b.n_name)) AS pair, upper(replace(a.n_name, ' ', '-')) AS canonical, replace(replace(b.n_name, 'A', ''), 'I', '') AS bare, left(a.n_name, 3) = left(b.n_name, 3) AS alike
  FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"""
SQL["fn_protected"] = """SELECT event_id, CASE WHEN abs(value - 250) < 1e-6 THEN 1.0 ELSE round(100 / (value - 250), 6) END + 0e0 AS pdiv, CASE WHEN value - 250 <= 0 THEN 0e0 ELSE round(ln(value - 250), 6) END AS plog, CASE WHEN value < 250 THEN 0e0 ELSE round(sqrt(value - 250), 6) END AS psqrt, round(least(1, greatest(-1, (value - 250) / 100)) + 0e0, 6) AS clipped FROM {events} WHERE value IS NOT NULL"""

# --- strategies -------------------------------------------------------------------------------------------
# The strategy's RSI divides by the bare loss: without losses it is 100, and null without gains too.
BARE_RSI = RSI.replace("100 - 100 / (1 + gain / nullif(round(loss, 9), 0))", "CASE WHEN round(loss, 9) > 0 THEN 100 - 100 / (1 + gain / loss) WHEN gain > 0 THEN 100e0 END")
add("strat_rsi_reversal", f"""+ {BARE_RSI}, p AS (SELECT symbol, ts, close, round(rsi, 6) AS rsi, {lagged("round(rsi, 6)")} AS before FROM r)
SELECT symbol, ts, CASE WHEN rsi < 30 THEN 'BUY' ELSE 'CLOSE' END AS side, CAST(CASE WHEN rsi < 30 THEN round(least(0.9, 0.5 + (30 - rsi) / 100), 4) END AS DOUBLE) AS strength
FROM p WHERE before >= 30 AND rsi < 30 OR before <= 70 AND rsi > 70""", "bars")
MONTHLY = f"""x AS (SELECT symbol, ts, close, {lagged("close", 10)} AS c10, {lagged("close", 125)} AS c125, {lagged("close", 21)} AS c21, {lagged("close", 252)} AS c252, {rolled("stddev_samp", "ret", 10)} AS sd10, row_number() OVER (PARTITION BY symbol, CAST(date_trunc('month', ts) AS DATE) ORDER BY ts) AS first FROM rets)"""
add("strat_momentum_v1", f"""+ {MONTHLY}, k AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, symbol, round(c10 / c125 - 1, 8) AS mom, greatest(0.05, sd10 * sqrt(252)) AS vol FROM x WHERE first = 1 AND c125 IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY mom DESC, symbol) AS rn, count(*) OVER (PARTITION BY month) AS n FROM k)
SELECT month, symbol, round(mom, 6) AS momentum, round(0.1 * least(2, greatest(0.25, 0.2 / vol)), 6) AS weight, round(1 - (rn - 1) / n * 0.3, 6) AS strength FROM r WHERE rn <= greatest(floor(n * 0.15), 1)""", "rets")
# Formation of 252 bars that ends 21 bars ago, so 273 bars; the weight is scaled by the market's volatility and halved in high regimes.
add("strat_momentum_v2", f"""+ x AS (SELECT r.symbol, r.ts, r.close, {lagged("close", 21, "r.symbol").replace("lag(close", "lag(r.close").replace("BY ts", "BY r.ts")} AS c21, {lagged("close", 272, "r.symbol").replace("lag(close", "lag(r.close").replace("BY ts", "BY r.ts")} AS c272,
    avg(b.high - b.low) OVER (PARTITION BY r.symbol ORDER BY r.ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr, row_number() OVER (PARTITION BY r.symbol, CAST(date_trunc('month', r.ts) AS DATE) ORDER BY r.ts) AS first
  FROM rets r JOIN bars b ON r.symbol = b.symbol AND r.ts = b.ts),
k AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, ts, symbol, close, atr, round(c21 / c272 - 1, 8) AS mom FROM x WHERE first = 1 AND c272 IS NOT NULL),
v AS (SELECT ts, vix, greatest(2e-1, least(15e-1, 12e-2 / nullif(stddev_pop(ret) OVER (ORDER BY ts ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) * sqrt(252e0), 0))) * CASE WHEN vix >= 25 THEN 5e-1 ELSE 1 END AS scale FROM market),
r AS (SELECT k.*, v.scale, row_number() OVER (PARTITION BY month ORDER BY mom DESC, symbol) AS rn, count(*) OVER (PARTITION BY month) AS n FROM k LEFT JOIN v ON k.ts = v.ts)
SELECT month, symbol, close, round(mom, 6) AS momentum, CAST(rn AS BIGINT) AS place, round(least(0.10, coalesce(scale, 1) / greatest(floor(n * 0.10), 5)), 6) AS weight,
  round(close - 3 * atr, 4) AS stop, round(close + 5 * atr, 4) AS target
FROM r WHERE n >= 10 AND rn <= greatest(floor(n * 0.10), 5)""", "rets", "market")
add("strat_mean_reversion", f"""+ x AS (SELECT b.symbol, b.ts, s.sector, b.close, b.close / lag(b.close, 14) OVER (PARTITION BY b.symbol ORDER BY b.ts) - 1 AS ret14 FROM bars b JOIN sectors s ON b.symbol = s.symbol), r AS (SELECT *, row_number() OVER (PARTITION BY sector, ts ORDER BY round(ret14, 8), symbol) AS rn, count(*) OVER (PARTITION BY sector, ts) AS n FROM x WHERE ret14 >= -0.5)
SELECT ts, sector, symbol, round(ret14, 6) AS ret14, round(0.8 * close, 4) AS stop, round(1.1 * close, 4) AS target FROM r WHERE rn <= greatest(2, least(7, floor(n * 0.25)))""", "bars", "sectors")
add("strat_volume_breakout", f"""+ x AS (SELECT symbol, ts, open, high, low, close, volume, {lagged("high")} AS ph, {lagged("low")} AS pl, {PC} AS pc, volume / nullif({rolled("avg", "volume", 20)}, 0) AS rv FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY round(rv, 8) DESC, symbol) AS rn FROM x WHERE rv >= 1.5 AND close >= 10 AND abs(open / pc - 1) >= 0.02 AND close > ph AND open > pc)
SELECT ts, symbol, round(rv, 4) AS rv, pl AS stop, round(least(0.9, 0.5 + rv / 10), 4) AS strength FROM k WHERE rn <= 5""", "bars")
add("strat_gap_momentum", """+ g AS (SELECT symbol, ts, open, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc, max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS h3, min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l3 FROM bars), k AS (SELECT *, round(100 * (open - pc) / pc, 6) AS gap FROM g)
SELECT symbol, ts, gap, CASE WHEN gap > 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(CASE WHEN open > h3 OR open < l3 THEN 0.75 ELSE 0.60 END + CASE WHEN extract(DAY FROM ts) >= 21 THEN 0.05 ELSE 0 END AS DOUBLE) AS strength FROM k WHERE abs(gap) BETWEEN 0.15 AND 0.60""", "bars")
add("strat_sector_rotation", f"""+ d AS (SELECT s.sector AS symbol, b.ts, round(avg(b.close), 4) AS px FROM bars b JOIN sectors s ON b.symbol = s.symbol GROUP BY s.sector, b.ts), x AS (SELECT symbol, ts, 0.7 * (px / {lagged("px", 104)} - 1) + 0.2 * (px / {lagged("px", 62)} - 1) + 0.1 * (px / {lagged("px", 20)} - 1) AS score FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY round(score, 8) DESC, symbol) AS rn FROM x WHERE score IS NOT NULL)
SELECT ts, symbol AS sector, round(score, 6) AS score, 0.5e0 AS weight FROM r WHERE rn <= 2""", "bars", "sectors")
add("strat_small_value", """+ f AS (SELECT ps.p_partkey AS symbol, p_retailprice AS price, p_size AS size, p_brand AS brand FROM {part} ps), r AS (SELECT *, (rank() OVER (PARTITION BY brand ORDER BY price) + (count(*) OVER (PARTITION BY brand, price) - 1) / 2) / count(*) OVER (PARTITION BY brand) AS cheap, (rank() OVER (PARTITION BY brand ORDER BY size) + (count(*) OVER (PARTITION BY brand, size) - 1) / 2) / count(*) OVER (PARTITION BY brand) AS quality FROM f),
c AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY cheap, symbol) AS rn, count(*) OVER (PARTITION BY brand) AS n FROM r) SELECT brand, symbol, round(0.45 * (1 - cheap) + 0.35 * quality, 6) AS composite FROM c WHERE rn <= floor(n * 0.25)""", "ticks")
add("strat_rotation_targets", """+ r AS (SELECT ts, CASE WHEN least(vix, avg(vix) OVER (ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) < 15 THEN 'low' WHEN least(vix, avg(vix) OVER (ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) < 25 THEN 'normal' ELSE 'high' END AS regime FROM market), p AS (SELECT 'low' AS regime, 'ASIA' AS asset, 0.6e0 AS weight UNION ALL SELECT 'low', 'EUROPE', 0.4e0 UNION ALL SELECT 'normal', 'EUROPE', 1e0 UNION ALL SELECT 'high', 'AMERICA', 1e0)
SELECT ts, r.regime, asset, weight FROM r JOIN p ON r.regime = p.regime""", "market")

# --- simulators -------------------------------------------------------------------------------------------
add("sim_gap_fill", """+ g AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars), t AS (SELECT symbol, ts, open, round(CASE WHEN low <= open * 0.98 THEN -0.02 WHEN high >= pc THEN pc / open - 1 ELSE close / open - 1 END, 8) AS ret, CASE WHEN low <= open * 0.98 THEN 'stop' WHEN high >= pc THEN 'target' ELSE 'close' END AS reason FROM g WHERE open < pc * 0.995)
SELECT symbol, reason, count(*) AS trades, round(avg(ret), 6) AS mean_ret, count(CASE WHEN ret > 0 THEN 1 END) AS wins FROM t GROUP BY symbol, reason""", "bars")
add("sim_first_touch", """+ r AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts, event_id) AS rn, first_value(price) OVER (PARTITION BY symbol, day ORDER BY ts, event_id) AS entry FROM ticks), h AS (SELECT symbol, day, max(entry) AS entry, min(CASE WHEN rn > 1 AND price <= entry * 0.5 THEN rn END) AS stopped, min(CASE WHEN rn > 1 AND price >= entry * 1.5 THEN rn END) AS reached, max(rn) AS last FROM r GROUP BY symbol, day)
SELECT h.symbol, h.day, entry, CASE WHEN stopped <= coalesce(reached, last + 1) THEN 'stop' WHEN reached IS NOT NULL THEN 'target' ELSE 'time' END AS reason, CAST(least(coalesce(stopped, last), coalesce(reached, last)) AS BIGINT) AS bar FROM h""", "ticks")
add("sim_slippage", """SELECT trade_id, symbol, qty, price, round(least(price * 10 / 1e4 + price * 0.02 * 0.25, price * 0.02), 6) AS conservative, round(least(price * 7 / 1e4 + price * 0.02 * 0.20, price * 0.015), 6) AS moderate, round(least(price * 5 / 1e4 + price * 0.02 * 0.10, price * 0.005), 6) AS aggressive, round(pnl - 0.01 * qty, 4) AS net_pnl FROM trades""", "trades")
add("sim_rotation", """+ a AS (SELECT ts, round(sum(ln(1 + CASE WHEN vix < 25 THEN ret ELSE 0.5 * ret END)) OVER (ORDER BY ts), 5) AS equity FROM market) SELECT CAST(date_trunc('month', ts) AS DATE) AS month, max_by(equity, ts) AS log_equity FROM a GROUP BY CAST(date_trunc('month', ts) AS DATE)""", "market")

# --- metrics ----------------------------------------------------------------------------------------------
add("met_returns", """+ v AS (SELECT symbol, percentile_cont(0.05) WITHIN GROUP (ORDER BY ret) AS var FROM rets WHERE ret IS NOT NULL GROUP BY symbol), x AS (SELECT r.symbol, ret, var FROM rets r JOIN v ON r.symbol = v.symbol WHERE ret IS NOT NULL)
SELECT symbol, count(*) AS n, round(sqrt(252) * avg(ret) / nullif(stddev_samp(ret), 0), 4) AS sharpe, round(sqrt(252) * avg(ret) / nullif(stddev_samp(CASE WHEN ret < 0 THEN ret END), 0), 4) AS sortino, round(sqrt(252) * avg(ret) / nullif(sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)), 0), 4) AS sortino_rms,
  round(max(var), 6) AS var_05, round(avg(CASE WHEN ret <= var THEN ret END), 6) AS cvar_05, round(least(10, greatest(0.1, sum(CASE WHEN ret > 0 THEN ret END) / nullif(-sum(CASE WHEN ret < 0 THEN ret END), 0))), 4) AS omega FROM x GROUP BY symbol""", "rets")
add("met_moments", "+ m AS (SELECT symbol, avg(ret) AS mu, count(ret) AS n FROM rets GROUP BY symbol), c AS (SELECT r.symbol, n, avg(pow(ret - mu, 2)) AS m2, avg(pow(ret - mu, 3)) AS m3, avg(pow(ret - mu, 4)) AS m4 FROM rets r JOIN m ON r.symbol = m.symbol WHERE ret IS NOT NULL GROUP BY r.symbol, n) SELECT symbol, round(m3 / pow(m2, 1.5) * sqrt(n * (n - 1.0)) / (n - 2), 5) AS skew, round((n - 1e0) / ((n - 2e0) * (n - 3e0)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6), 4) AS excess_kurtosis FROM c WHERE n > 3", "rets")
add("met_alpha_decay", f"+ x AS (SELECT symbol, ts, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM rets WHERE ret IS NOT NULL) SELECT symbol, {', '.join(f'round(sqrt(252) * avg(CASE WHEN back <= {n} THEN ret END) / nullif(stddev_samp(CASE WHEN back <= {n} THEN ret END), 0), 4) AS sharpe_{n}' for n in (63, 252, 756))}, round(1e4 * regr_slope(ret, -back), 6) AS slope FROM x GROUP BY symbol", "rets")
add("met_ttest", "+ g AS (SELECT strategy, count(*) AS n, avg(pnl) AS m, var_samp(pnl) AS v FROM trades GROUP BY strategy) SELECT a.strategy AS a, b.strategy AS b, round((a.m - b.m) / sqrt((a.v / a.n) + (b.v / b.n)), 5) AS t, round((a.m - b.m) / sqrt((a.v + b.v) / 2), 6) AS cohen_d FROM g a JOIN g b ON a.strategy < b.strategy", "trades")
add("met_live_vs_backtest", "+ h AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) <= count(*) OVER (PARTITION BY symbol) * 0.7 AS early FROM rets WHERE ret IS NOT NULL), s AS (SELECT symbol, round(sqrt(252) * avg(CASE WHEN early THEN ret END) / nullif(stddev_samp(CASE WHEN early THEN ret END), 0), 4) AS inside, round(sqrt(252) * avg(CASE WHEN NOT early THEN ret END) / nullif(stddev_samp(CASE WHEN NOT early THEN ret END), 0), 4) AS outside FROM h GROUP BY symbol) SELECT symbol, inside, outside, CASE WHEN outside - inside < -0.25 * abs(inside) THEN 'critical' WHEN outside - inside < -0.15 * abs(inside) THEN 'degraded' ELSE 'healthy' END AS status FROM s", "rets")

# --- regimes and portfolios -------------------------------------------------------------------------------
add("reg_transitions", "+ r AS (SELECT ts, CASE WHEN vix < 15 THEN 'low' WHEN vix < 25 THEN 'normal' WHEN vix < 35 THEN 'high' ELSE 'extreme' END AS regime FROM market), n AS (SELECT regime, lead(regime) OVER (ORDER BY ts) AS following FROM r) SELECT regime, following, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY regime), 6) AS probability FROM n WHERE following IS NOT NULL GROUP BY regime, following", "market")
add("reg_features", f"""+ f AS (SELECT ts, vix, vix / nullif({lagged("vix", 4, "")}, 0) - 1 AS dv5, vix / nullif({lagged("vix", 19, "")}, 0) - 1 AS dv20, px / {lagged("px", 20, "")} - 1 AS r20, px / nullif({rolled("avg", "px", 50, "")}, 0) - 1 AS gap50, {rolled("stddev_pop", "ret", 20, "")} * sqrt(252) AS vol20 FROM market)
SELECT ts, round(vix, 4) AS vix, round(dv5, 4) AS dv5, round(dv20, 4) AS dv20, round(r20, 5) AS r20, round(gap50, 5) AS gap50, round(vol20, 4) AS vol20, CASE WHEN vix > 35 OR round(r20, 8) < -0.15 THEN 'crisis' WHEN vix > 25 THEN 'high_vol' WHEN round(r20, 8) > 0.03 AND vix < 20 THEN 'bull' WHEN round(r20, 8) < -0.05 THEN 'bear' WHEN vix < 15 THEN 'low_vol' ELSE 'transition' END AS label FROM f""", "market")
add("reg_composite", f"""+ f AS (SELECT ts, least(1, greatest(0, 1 - (vix - 10) / 30)) AS s1, least(1, greatest(0, 0.5 + 5 * (px / {lagged("px", 20, "")} - 1))) AS s2 FROM market), c AS (SELECT ts, round((0.6 * s1 + 0.4 * coalesce(s2, 0.5)), 5) AS score FROM f) SELECT ts, score, CASE WHEN score < 0.2 THEN 'crisis' WHEN score < 0.4 THEN 'risk_off' WHEN score < 0.6 THEN 'transition' ELSE 'risk_on' END AS regime FROM c""", "market")
add("port_correlation", "+ s AS (SELECT strategy, CAST(date_trunc('month', exit_ts) AS DATE) AS month, round(sum(pnl), 2) AS pnl FROM trades GROUP BY strategy, CAST(date_trunc('month', exit_ts) AS DATE)), p AS (SELECT a.strategy AS a, b.strategy AS b, corr(a.pnl, b.pnl) AS rho FROM s a JOIN s b ON a.month = b.month AND a.strategy < b.strategy GROUP BY a.strategy, b.strategy) SELECT a, b, round(rho, 6) AS rho, abs(rho) >= 0.7 AS high, round(1 - avg(abs(rho)) OVER (), 6) AS diversification FROM p", "trades")
add("port_weights", "+ s AS (SELECT strategy, greatest(0.1, avg(pnl) / stddev_samp(pnl) * sqrt(252)) AS sharpe FROM trades GROUP BY strategy), w AS (SELECT strategy, least(0.40, sharpe / sum(sharpe) OVER ()) AS w FROM s) SELECT strategy, round(0.9 * w / sum(w) OVER (), 6) AS weight FROM w", "trades")
add("port_votes", """+ v AS (SELECT symbol, CAST(exit_ts AS DATE) AS day, side, abs(pnl_pct) / 20 AS strength FROM trades), a AS (SELECT symbol, day, sum(CASE WHEN side = 'buy' THEN strength ELSE 0 END) AS buy, sum(CASE WHEN side = 'sell' THEN strength ELSE 0 END) AS sell, count(*) AS n, avg(strength) AS mean FROM v GROUP BY symbol, day)
SELECT symbol, day, CASE WHEN round(buy - sell, 9) > 0 AND buy > 0.1 THEN 'BUY' WHEN round(sell - buy, 9) > 0 AND sell > 0.1 THEN 'SELL' ELSE 'NONE' END AS side, round(least(mean + least(0.1 * n, 0.3), 1), 6) AS strength, n FROM a""", "trades")
add("port_sizing", f"""+ x AS (SELECT symbol, ts, close, {rolled("avg", "high - low", 14)} AS atr, {rolled("stddev_samp", "close", 20)} / close * sqrt(252) AS vol FROM bars) SELECT symbol, ts, CAST(floor(least(15000, 2000 / nullif(round(atr, 6), 0) * close) / close) AS BIGINT) AS shares_atr, round(least(2, greatest(0.25, 0.15 / nullif(round(vol, 9), 0))), 4) AS vol_scalar FROM x WHERE atr IS NOT NULL""", "bars")
add("port_impact", "+ v AS (SELECT symbol, avg(volume) AS adv, stddev_samp(ret) AS sd FROM rets GROUP BY symbol) SELECT t.strategy, count(*) AS n, round(avg(10 * sd * 1e4 * sqrt(qty / adv)), 4) AS impact_bps, round(avg(qty / adv), 6) AS participation FROM trades t JOIN v ON t.symbol = v.symbol GROUP BY t.strategy", "rets", "trades")
# In cents, so that no sum or comparison depends on its order.
add("port_reconcile", """+ p AS (SELECT strategy, symbol, sum(CAST(floor(price * qty * 100 + 5e-1) AS BIGINT)) AS cents FROM trades GROUP BY strategy, symbol),
t AS (SELECT strategy, symbol, cents, sum(cents) OVER (PARTITION BY strategy) AS total, count(*) OVER (PARTITION BY strategy) AS n FROM p)
SELECT strategy, symbol, cents / 1e2 AS held, CAST(floor((cents * n - total) / (1e0 * n)) AS BIGINT) AS trim_cents FROM t
WHERE 10 * n * cents > 11 * total AND cents * n - total >= 10000 * n""", "trades")

# --- robustness and reports -------------------------------------------------------------------------------
# The ranges come from one-row aggregates, so that no window holds all symbols in one task.
add("rob_elites", f"""+ {POP}, span AS (SELECT min(gain) AS gain0, max(gain) AS gain1, min(calm) AS calm0, max(calm) AS calm1 FROM pop),
n AS (SELECT symbol, gain, CAST(floor(least(1, greatest(0, (gain - gain0) / (gain1 - gain0))) * 9) AS INT) AS x, CAST(floor(least(1, greatest(0, (calm - calm0) / (calm1 - calm0))) * 9) AS INT) AS y FROM pop CROSS JOIN span)
SELECT x, y, count(*) AS n, max_by(symbol, (gain, symbol)) AS elite, max(gain) AS best FROM n GROUP BY x, y""", "rets")
# Test windows of 63 rows every 21, after 252: the rolling window that ends on each 21st row.
add("rob_walk_forward", f"""+ x AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM rets WHERE ret IS NOT NULL),
w AS (SELECT symbol, i, avg(ret) {over(63, at="i")} / nullif(stddev_samp(ret) {over(63, at="i")}, 0) AS sharpe FROM x)
SELECT symbol, count(*) AS folds, round(avg(CASE WHEN sharpe > 0 THEN 1e0 ELSE 0e0 END), 6) AS efficiency, round(avg(sharpe), 5) AS mean_sharpe
FROM w WHERE i >= 314 AND (i - 314) % 21 = 0 GROUP BY symbol""", "rets")
add("rob_lifecycle", "+ s AS (SELECT strategy, symbol, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END) AS win, sum(pnl) AS total FROM trades GROUP BY strategy, symbol), g AS (SELECT *, concat_ws('; ', CASE WHEN n < 5 THEN 'trades' END, CASE WHEN win < 0.3 THEN 'win rate' END, CASE WHEN total < -5000 THEN 'loss' END) AS failing FROM s) SELECT failing, CASE WHEN failing = '' THEN 'live' WHEN failing LIKE '%loss%' THEN 'retired' ELSE 'paper' END AS status, count(*) AS n FROM g GROUP BY failing", "trades")
SQL["rep_open_orders"] = "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS value, max(o_orderdate) AS last FROM {orders} GROUP BY o_orderpriority, o_orderstatus"
SQL["rep_recent_orders"] = "SELECT o_orderkey, o_orderstatus, o_orderdate, o_totalprice FROM {orders} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100"
SQL["rep_event_levels"] = "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(floor(value * 100 + 5e-1)) / count(value) / 1e2, 3) AS mean FROM {events} GROUP BY event_type, CAST(ts AS DATE)"
SQL["rep_least_tested"] = "SELECT p_type, count(l_partkey) AS tested FROM {part} LEFT JOIN {lineitem} ON p_partkey = l_partkey GROUP BY p_type ORDER BY tested, p_type LIMIT 5"

SQL = {name: rounded(text) for name, text in SQL.items()}
