"""More market queries in SQL: filters, alignment, states, pairs, factors, regimes, fitness, allocation and reports.

One text serves both engines, but for what they spell differently: ``known(x)``
is the last value of x that isn't null, ``dow(t)`` the day of the week from
Sunday 0, and ``days(a, b)`` the days from b to a.

A bar's volume counts lots: LOT shares each, at a quarter of the tables' price.
Thresholds for dollars, volatility and spread are set so that they divide these
symbols; those for shares, prices and returns are the usual ones.
"""

from __future__ import annotations

import re

from tidemark.plans.views import lagged, over, rolled, rounded, with_views

SPARK: dict[str, str] = {}
OTHER: dict[str, str] = {}
LOT = 20000


def add(name: str, body: str, *views: str) -> None:
    text = rounded(with_views(body, *views) if views else body)
    SPARK[name] = re.sub(r"days\(([^,()]+), ([^,()]+)\)", r"datediff(CAST(\1 AS DATE), CAST(\2 AS DATE))", re.sub(r"dow\(([^()]+)\)", r"(dayofweek(\1) - 1)", re.sub(r"known\((\w+)\)", r"last_value(\1) IGNORE NULLS", text)))
    OTHER[name] = re.sub(r"days\(([^,()]+), ([^,()]+)\)", r"(CAST(\1 AS DATE) - CAST(\2 AS DATE))", re.sub(r"dow\(([^()]+)\)", r"dayofweek(\1)", re.sub(r"known\((\w+)\)", r"last_value(\1 IGNORE NULLS)", text)))


def regime(vix: str, low: int = 15, normal: int = 25, high: int = 35) -> str:
    return f"CASE WHEN {vix} < {low} THEN 'low' WHEN {vix} < {normal} THEN 'normal' WHEN {vix} < {high} THEN 'high' ELSE 'extreme' END"


SHARES = f"shares AS (SELECT symbol, ts, open / 4 AS open, high / 4 AS high, low / 4 AS low, close / 4 AS close, volume * {LOT} AS volume FROM bars)"
#: The last bar of each symbol with means over its last 20 and 60.
LATEST = f"""{SHARES},
placed AS (SELECT *, {lagged("close")} AS pc, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY symbol) AS n FROM shares),
latest AS (SELECT symbol, max(n) AS n, max(CASE WHEN back = 1 THEN close END) AS close, avg(CASE WHEN back <= 20 THEN volume END) AS volume20,
    max(CASE WHEN back = 1 THEN close END) / max(CASE WHEN back = 15 THEN close END) - 1 AS ret14, max(CASE WHEN back = 1 THEN close END) / max(CASE WHEN back = 6 THEN close END) - 1 AS ret5,
    stddev_samp(CASE WHEN back <= 60 THEN close / pc - 1 END) * sqrt(252e0) AS vol60, stddev_samp(CASE WHEN back <= 20 THEN close END) AS sd20,
    avg(CASE WHEN back <= 60 THEN volume END) * avg(CASE WHEN back <= 60 THEN close END) AS dollars,
    15e-2 * median(CASE WHEN back <= 20 THEN (high - low) / close END) AS spread FROM placed GROUP BY symbol)"""

# --- filters and universes --------------------------------------------------------------------------------
add("flt_liquidity_quality", f"""+ {LATEST}
SELECT symbol, n, round(close, 4) AS close, round(volume20, 2) AS volume20,
  n >= 20 AND volume20 >= 500000 AND close BETWEEN 10 AND 500 AS liquid,
  coalesce(close >= 10 AND volume20 >= 500000 AND ret14 >= -5e-1 AND NOT ret5 > 15e-2, false) AS good
FROM latest""", "bars")
TIERS = f"""{LATEST},
tiers AS (SELECT l.symbol, s.industry, dollars, spread, vol60,
    CASE WHEN dollars >= 800e6 THEN 'highly_liquid' WHEN dollars >= 600e6 THEN 'liquid' WHEN dollars >= 450e6 THEN 'moderate' ELSE 'illiquid' END AS liquidity,
    CASE WHEN vol60 < 100 THEN 'low' WHEN vol60 < 300 THEN 'normal' WHEN vol60 < 1000 THEN 'high' ELSE 'extreme' END AS volatility,
    CASE WHEN 250 * dollars >= 200e9 THEN 'mega' WHEN 250 * dollars >= 10e9 THEN 'large' WHEN 250 * dollars >= 2e9 THEN 'mid' ELSE 'small' END AS cap
  FROM latest l JOIN sectors s ON l.symbol = s.symbol)"""
add("flt_eligibility", f"""+ {TIERS}
SELECT symbol, liquidity, volatility, cap,
  liquidity IN ('highly_liquid', 'liquid') AND spread < 2e-1 AND cap IN ('mega', 'large') AND dollars >= 20e6 AS gap_fill,
  liquidity <> 'illiquid' AND volatility <> 'extreme' AND dollars >= 5e6 AS momentum,
  liquidity <> 'illiquid' AND volatility IN ('normal', 'high') AND industry IS NOT NULL AS mean_reversion,
  liquidity IN ('highly_liquid', 'liquid') AND industry IS NOT NULL AND dollars >= 10e6 AS pairs,
  liquidity <> 'illiquid' AND volatility IN ('normal', 'high') AND dollars >= 5e6 AS breakout
FROM tiers""", "bars", "sectors")
add("flt_requirements", f"""+ {TIERS},
needs AS (SELECT 'momentum' AS strategy, 450e6 AS least_dollars, 0e0 AS low_vol, 1e3 AS high_vol UNION ALL SELECT 'pairs', 600e6, 0e0, 1e9 UNION ALL SELECT 'breakout', 450e6, 1e2, 1e3)
SELECT strategy, count(*) AS n, round(avg(vol60), 4) AS mean_vol, min(symbol) AS first_symbol
FROM tiers JOIN needs ON dollars >= least_dollars AND vol60 BETWEEN low_vol AND high_vol GROUP BY strategy""", "bars", "sectors")
add("flt_watchlist", f"""+ {LATEST}
SELECT symbol, round(close, 4) AS close, round(sd20 / close, 6) AS volatility FROM latest
WHERE close BETWEEN 5 AND 500 AND volume20 >= 500000 AND sd20 / close BETWEEN 2e-2 AND 10 AND dollars > 5e6
ORDER BY volatility DESC, symbol LIMIT 200""", "bars")
add("flt_metadata_tier", f"""+ {LATEST}
SELECT symbol, round(close, 4) AS price, round(volume20, 2) AS avg_volume, round(sd20, 4) AS atr_fallback,
  CASE WHEN close * volume20 > 200e6 THEN 'large' WHEN close * volume20 > 150e6 THEN 'mid' WHEN close * volume20 > 5e6 THEN 'small' ELSE 'micro' END AS tier FROM latest""", "bars")
add("fn_cost_adjusted", """SELECT p_partkey, round(least(p_size / 10e0 / 5, 1), 6) AS penalty, round(greatest(p_retailprice / 2000 * (1 - 4e-1 * least(p_size / 10e0 / 5, 1)), 0), 6) AS strength FROM {part}""")
SHARPE = "round(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252e0), 6)"
add("met_thresholds", f"""+ s AS (SELECT strategy, {SHARPE} AS sharpe FROM trades GROUP BY strategy),
research AS (SELECT '1-URGENT' AS strategy, 5e-1 AS least, 12e-1 AS found UNION ALL SELECT '2-HIGH', 3e-1, 8e-1 UNION ALL SELECT '3-MEDIUM', 0e0, 5e-1)
SELECT s.strategy, sharpe, coalesce(sharpe >= least, false) AS meets, round(100 * sharpe / found, 4) AS vs_research_pct FROM s LEFT JOIN research r ON s.strategy = r.strategy""", "trades")
GENOMES = """genomes AS (SELECT symbol, count(ret) AS trades, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252e0), 8) AS sharpe, avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) AS win, round(100 * min(ret), 8) AS dd FROM rets WHERE ret IS NOT NULL GROUP BY symbol)"""
add("flt_periods", f"""+ m AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, avg(vix) AS vix, count(*) AS days FROM market GROUP BY CAST(date_trunc('month', ts) AS DATE))
SELECT month, round(vix, 4) AS mean_vix, days, {regime("round(vix, 6)")} AS kind FROM m WHERE vix BETWEEN 10 AND 60 AND days <= 31 AND month BETWEEN DATE '1993-01-01' AND DATE '1997-12-31'""", "market")

# --- sources ----------------------------------------------------------------------------------------------
add("src_priority_merge", """+ base AS (SELECT symbol, ts, close FROM bars WHERE ts < TIMESTAMP '1996-01-01 00:00:00'), newest AS (SELECT symbol, max(CAST(ts AS DATE)) AS day FROM base GROUP BY symbol)
SELECT symbol, ts, close, 'base' AS source FROM base
UNION ALL SELECT b.symbol, b.ts, b.close, 'secondary' FROM bars b JOIN newest n ON b.symbol = n.symbol WHERE CAST(b.ts AS DATE) > n.day""", "bars")
add("src_summary", "SELECT symbol, min(ts) AS first, max(ts) AS last, count(*) AS n, count(*) >= 20 AS usable FROM bars GROUP BY symbol", "bars")
add("src_symbols", "SELECT DISTINCT symbol FROM bars", "bars")
add("src_minute_tail", """+ r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS back FROM ticks)
SELECT symbol, event_id, ts, price, back FROM r WHERE back <= 30""", "ticks")
add("src_weekday_range", "SELECT symbol, day, count(*) AS n, min(ts) AS first, max(ts) AS last FROM ticks WHERE dow(ts) BETWEEN 1 AND 5 GROUP BY symbol, day", "ticks")
add("src_previous_close", """+ d AS (SELECT symbol, day, max_by(price, (ts, event_id)) AS close FROM ticks GROUP BY symbol, day), p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS before, lag(day) OVER (PARTITION BY symbol ORDER BY day) AS since FROM d)
SELECT symbol, day, CASE WHEN days(day, since) <= 5 THEN before END AS previous_close FROM p""", "ticks")
add("src_opening_bar", "SELECT symbol, day, min_by(event_id, (ts, event_id)) AS event_id, min_by(price, (ts, event_id)) AS open, min(ts) AS ts FROM ticks GROUP BY symbol, day", "ticks")
add("src_vix_proxy", f"""+ x AS (SELECT ts, ret, {rolled("stddev_samp", "ret", 20, "")} * sqrt(252e0) * 100 AS sd, avg(ret) {over(5, "")} AS m5 FROM market)
SELECT ts, round(greatest(10, least(80, 7e-1 * coalesce(sd, 20) + coalesce(m5 * 100, 0) + 20)), 4) AS vix_estimate FROM x""", "market")
add("src_vix_regimes", """+ r AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN vix > 35 THEN 'extreme' WHEN vix > 25 THEN 'elevated' WHEN vix < 15 THEN 'low' ELSE 'normal' END AS regime, vix FROM market)
SELECT day, regime, round(max(vix), 4) AS vix FROM r GROUP BY day, regime""", "market")
add("src_sector_universe", "SELECT sector, count(*) AS stocks, min(symbol) AS first_symbol, max(symbol) AS last_symbol FROM sectors GROUP BY sector HAVING count(*) >= 2", "sectors")
add("src_upsert", """+ u AS (SELECT symbol, ts, close, 1 AS batch FROM bars WHERE ts < TIMESTAMP '1997-01-01 00:00:00' UNION ALL SELECT symbol, ts, round(close * 101e-2, 4), 2 FROM bars WHERE ts >= TIMESTAMP '1996-06-01 00:00:00'),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY batch DESC) AS rn FROM u) SELECT symbol, ts, close, batch FROM r WHERE rn = 1""", "bars")

# --- alignment and joins ----------------------------------------------------------------------------------
DAILY = "daily_pnl AS (SELECT strategy, CAST(exit_ts AS DATE) AS day, round(sum(pnl), 2) AS pnl FROM trades GROUP BY strategy, CAST(exit_ts AS DATE))"
ALIGNED = f"""{DAILY}, grid AS (SELECT d.day, s.strategy FROM (SELECT DISTINCT day FROM daily_pnl) d JOIN (SELECT DISTINCT strategy FROM daily_pnl) s ON true),
filled AS (SELECT g.day, g.strategy, known(pnl) OVER (PARTITION BY g.strategy ORDER BY g.day ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS pnl FROM grid g LEFT JOIN daily_pnl p ON g.day = p.day AND g.strategy = p.strategy),
aligned AS (SELECT day, strategy, pnl FROM (SELECT *, count(pnl) OVER (PARTITION BY day) AS have, count(*) OVER (PARTITION BY day) AS want FROM filled) f WHERE have = want)"""
add("join_aligned", f"+ {ALIGNED} SELECT day, strategy, pnl FROM aligned", "trades")
add("join_vix_fill", f"""+ {DAILY}, w AS (SELECT CAST(ts AS DATE) AS day, vix FROM market WHERE dow(ts) = 1), u AS (SELECT strategy, day, pnl, NULL AS vix FROM daily_pnl UNION ALL SELECT s.strategy, w.day, NULL, w.vix FROM w JOIN (SELECT DISTINCT strategy FROM daily_pnl) s ON true),
f AS (SELECT strategy, day, pnl, known(vix) OVER (PARTITION BY strategy ORDER BY day, CASE WHEN pnl IS NULL THEN 0 ELSE 1 END ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vix FROM u)
SELECT strategy, day, pnl, round(vix, 4) AS vix FROM f WHERE pnl IS NOT NULL""", "trades", "market")
add("join_asof_atr", f"""+ t AS (SELECT symbol, ts, close, coalesce(greatest(high - low, abs(high - {lagged("close")}), abs(low - {lagged("close")})), high - low) AS tr FROM bars), a AS (SELECT symbol, ts, close, {rolled("avg", "tr", 14)} AS atr FROM t),
u AS (SELECT symbol, CAST(NULL AS BIGINT) AS trade_id, ts, close, atr FROM a UNION ALL SELECT symbol, trade_id, entry_ts, NULL, NULL FROM trades),
f AS (SELECT symbol, trade_id, ts, known(close) OVER w AS close, known(atr) OVER w AS atr FROM u WINDOW w AS (PARTITION BY symbol ORDER BY ts, CASE WHEN trade_id IS NULL THEN 0 ELSE 1 END, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT trade_id, symbol, ts, close, round(coalesce(atr, 2e-2 * close), 4) AS atr FROM f WHERE trade_id IS NOT NULL""", "bars", "trades")
add("join_shadow_live", f"""+ {DAILY}, x AS (SELECT a.strategy AS shadow, b.strategy AS live, a.pnl AS pa, b.pnl AS pb FROM daily_pnl a JOIN daily_pnl b ON a.day = b.day AND a.strategy < b.strategy)
SELECT shadow, live, count(*) AS days, round(corr(pa, pb), 6) AS correlation, round(stddev_samp(pa - pb), 4) AS tracking_error FROM x GROUP BY shadow, live""", "trades")

# --- indicators and states --------------------------------------------------------------------------------
add("ind_enriched", f"""+ x AS (SELECT *, greatest(high - low, abs(high - {lagged("close")}), abs(low - {lagged("close")})) AS tr, {lagged("close")} AS pc FROM bars)
SELECT symbol, ts, round({rolled("avg", "tr", 14)}, 4) AS atr, round(volume / {rolled("avg", "volume", 20)}, 4) AS relative_volume, round({rolled("avg", "close", 20)}, 4) AS rolling_mean_20,
  round({rolled("stddev_samp", "close", 20)}, 4) AS rolling_std_20, round(ln(close / pc), 6) AS log_return FROM x""", "bars")
VOLS = f"""v AS (SELECT symbol, ts, {rolled("stddev_samp", "ret", 5)} * sqrt(252e0) AS v5, {rolled("stddev_samp", "ret", 20)} * sqrt(252e0) AS v20, {rolled("stddev_samp", "ret", 60)} * sqrt(252e0) AS v60, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM rets WHERE ret IS NOT NULL),
now_v AS (SELECT symbol, v5, v20, v60 FROM v WHERE back = 1)"""
add("port_volatility_state", f"""+ {VOLS}, h AS (SELECT v.symbol, count(*) AS n, count(v.v20) AS have, sum(CASE WHEN round(v.v20, 9) < round(w.v20, 9) THEN 1e0 ELSE 0e0 END) AS under, max(w.v5) AS v5, max(w.v20) AS v20, max(w.v60) AS v60 FROM v JOIN now_v w ON v.symbol = w.symbol GROUP BY v.symbol)
SELECT symbol, round(v5, 5) AS vol_5, round(v20, 5) AS vol_20, round(v60, 5) AS vol_60, round(CASE WHEN n < 60 OR have < 20 THEN 5e-1 ELSE under / have END, 6) AS percentile,
  CASE WHEN v5 > v20 * 12e-1 THEN 'increasing' WHEN v5 < v20 * 8e-1 THEN 'decreasing' ELSE 'stable' END AS trend, round(greatest(25e-2, least(2, 15e-2 / nullif(v20, 0))), 5) AS scalar FROM h""", "rets")
add("port_volatility_history", f"+ {VOLS} SELECT symbol, ts, round(v20, 5) AS vol_20, back FROM v WHERE back <= 10", "rets")
add("ind_intraday", f"""+ x AS (SELECT *, {lagged("price", 1, "symbol, day")} AS pp FROM ticks), g AS (SELECT *, greatest(price - pp, 0) AS gain, greatest(pp - price, 0) AS loss, abs(price - pp) AS tr FROM x)
SELECT symbol, event_id, round(100 * (price / nullif({lagged("price", 5, "symbol, day")}, 0) - 1), 4) AS momentum_5, round(coalesce({rolled("avg", "price", 10, "symbol, day")}, price), 4) AS sma_10,
  round(coalesce(100 - 100 / (1 + {rolled("avg", "gain", 14, "symbol, day")} / greatest({rolled("avg", "loss", 14, "symbol, day")}, 1e-10)), 50), 3) AS rsi_14, round(coalesce({rolled("avg", "tr", 14, "symbol, day")}, 0), 4) AS atr_14,
  round(coalesce(size / {rolled("avg", "size", 20, "symbol, day")}, 1), 4) AS relative_volume FROM g""".replace("ORDER BY ts", "ORDER BY ts, event_id"), "ticks")
ARRAY = "x AS (SELECT symbol, ts, " + ", ".join(f"{lagged('close', 11 - k)} AS c{k}, {lagged('volume', 11 - k)} AS u{k}" for k in range(12)) + " FROM bars)"
add("fn_vector_shapes", f"""+ {ARRAY}
SELECT symbol, ts, c11 > c0 AS momentum, c11 / c8 - 1 > c3 / c0 - 1 AS accelerating, (c6 + c7 + c8 + c9 + c10 + c11) < (c0 + c1 + c2 + c3 + c4 + c5) AS falling, c10 > 40 * u10 AND c11 <= 40 * u11 AS crosses_below,
  abs(c11 - 40 * u11) > abs(c0 - 40 * u0) AS diverging, abs(c11 - 40 * u11) < abs(c0 - 40 * u0) AS converging,
  {" + ".join(f"CASE WHEN u{k} > 25 THEN 1 ELSE 0 END" for k in range(12))} AS above_25, {" + ".join(f"CASE WHEN u{k} < 25 THEN 1 ELSE 0 END" for k in range(12))} AS below_25 FROM x WHERE c0 IS NOT NULL""", "bars")
add("fn_market_hours", """SELECT event_id, dow(ts) BETWEEN 1 AND 5 AS weekday, CAST(extract(HOUR FROM ts) * 60 + extract(MINUTE FROM ts) AS BIGINT) AS minute,
  dow(ts) BETWEEN 1 AND 5 AND extract(HOUR FROM ts) * 60 + extract(MINUTE FROM ts) BETWEEN 570 AND 960 AS market_open,
  CAST(CASE WHEN dow(ts) = 5 THEN 3 WHEN dow(ts) = 6 THEN 2 ELSE 1 END AS BIGINT) AS days_to_next_session FROM {events}""")
add("fn_text", """SELECT p_partkey, replace(upper(p_brand), '#', '_') AS canonical, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, p_type LIKE 'STANDARD%' AS standard, split_part(p_type, ' ', 2) AS finish, lower(p_name) AS plain FROM {part}""")

# --- strategies -------------------------------------------------------------------------------------------
add("strat_industry_signals", f"""+ r AS (SELECT symbol, ts, close, close / {lagged("close", 20)} - 1 AS ret20 FROM bars), z AS (SELECT r.*, s.industry, avg(ret20) OVER w AS mu, stddev_pop(ret20) OVER w AS sd, count(*) OVER w AS peers FROM r JOIN sectors s ON r.symbol = s.symbol WHERE ret20 IS NOT NULL WINDOW w AS (PARTITION BY s.industry, r.ts)),
k AS (SELECT *, round((ret20 - mu) / greatest(sd, 1e-3), 6) AS z FROM z WHERE peers >= 3), t AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY abs(z) DESC, symbol) AS rn FROM k WHERE z <= -1)
SELECT ts, industry, symbol, round(z, 4) AS z, 'LONG' AS side, round(close * (1 - z * sd), 4) AS target, round(close * 92e-2, 4) AS stop, round(close * 112e-2, 4) AS take_profit, 20 AS max_days FROM t WHERE rn <= 5""", "bars", "sectors")
PAIRED = """pr AS (SELECT a.symbol AS a, b.symbol AS b, a.industry FROM sectors a JOIN sectors b ON a.industry = b.industry AND a.symbol < b.symbol),
al AS (SELECT pr.a, pr.b, x.ts, x.close AS ca, y.close AS cb FROM pr JOIN bars x ON x.symbol = pr.a JOIN bars y ON y.symbol = pr.b AND y.ts = x.ts),
hg AS (SELECT a, b, count(*) AS n, corr(ca, cb) AS rho, regr_slope(ca, cb) AS hedge FROM al GROUP BY a, b HAVING count(*) >= 100),
sp AS (SELECT al.a, al.b, al.ts, n, rho, hedge, ln(ca) - hedge * ln(cb) AS spread FROM al JOIN hg ON al.a = hg.a AND al.b = hg.b),
lg AS (SELECT *, lag(spread) OVER (PARTITION BY a, b ORDER BY ts) AS before FROM sp)"""
add("strat_pairs_qualified", f"""+ {PAIRED}, q AS (SELECT a, b, max(n) AS n, max(rho) AS rho, max(hedge) AS hedge, regr_slope(spread - before, before) AS pull FROM lg WHERE before IS NOT NULL GROUP BY a, b)
SELECT a, b, n, round(rho, 6) AS correlation, round(hedge, 6) AS hedge, round(greatest(1e-3, 1 - abs(rho)), 6) AS p_value, round(CASE WHEN pull < 0 THEN -ln(2e0) / pull END, 4) AS half_life,
  coalesce(abs(rho) > 70e-2 AND 1 - abs(rho) < 15e-2 AND -ln(2e0) / pull BETWEEN 3 AND 60, false) AS valid FROM q""".replace("count(*) >= 100", "count(*) >= 20"), "bars", "sectors")
add("strat_pairs_scan", f"""+ {PAIRED}, z AS (SELECT a, b, ts, hedge, spread, CASE WHEN count(spread) OVER w = 20 THEN (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0) END AS z FROM sp WINDOW w AS (PARTITION BY a, b ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, round(z, 6) AS zr, lag(round(z, 6)) OVER (PARTITION BY a, b ORDER BY ts) AS before FROM z)
SELECT a, b, ts, round(z, 4) AS z, CASE WHEN zr > 15e-1 THEN 'short_spread' WHEN zr < -15e-1 THEN 'long_spread' ELSE 'exit' END AS action FROM c
WHERE abs(before) <= 15e-1 AND abs(zr) > 15e-1 OR abs(before) >= 75e-2 AND abs(zr) < 75e-2""".replace("count(*) >= 100", "count(*) >= 20"), "bars", "sectors")
add("strat_factor_momentum", f"""+ d AS (SELECT s.industry AS symbol, b.ts, round(avg(b.close), 4) AS px FROM bars b JOIN sectors s ON b.symbol = s.symbol GROUP BY s.industry, b.ts), r AS (SELECT symbol, ts, px, px / {lagged("px")} - 1 AS ret FROM d),
f AS (SELECT symbol, ts, 7e-1 * ({lagged("px", 5)} / {lagged("px", 257)} - 1) + 2e-1 * ({lagged("px", 5)} / {lagged("px", 131)} - 1) + 1e-1 * ({lagged("px", 5)} / {lagged("px", 26)} - 1) AS signal, {rolled("stddev_samp", "ret", 63)} AS vol, row_number() OVER (PARTITION BY symbol, CAST(date_trunc('month', ts) AS DATE) ORDER BY ts) AS first FROM r),
p AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, symbol, signal, round((1 / vol) / sum(1 / vol) OVER (PARTITION BY CAST(date_trunc('month', ts) AS DATE)), 9) AS w FROM f WHERE first = 1 AND round(signal, 9) > 0 AND vol > 0),
c AS (SELECT *, CASE WHEN w > 35e-2 THEN 35e-2 WHEN w < 8e-2 THEN 0 ELSE w END AS capped, CASE WHEN w > 35e-2 THEN w - 35e-2 WHEN w < 8e-2 THEN w ELSE 0 END AS spare, CASE WHEN w BETWEEN 8e-2 AND 35e-2 THEN 1 ELSE 0 END AS open FROM p),
s AS (SELECT *, CASE WHEN open = 1 AND capped < 35e-2 THEN least(35e-2, capped + sum(spare) OVER m / sum(open) OVER m) ELSE capped END AS shared FROM c WINDOW m AS (PARTITION BY month))
SELECT month, symbol AS factor, round(signal, 6) AS signal, round(shared / sum(shared) OVER (PARTITION BY month), 6) AS weight FROM s WHERE shared > 0""", "bars", "sectors")
add("strat_base_exits", f"""+ e AS (SELECT symbol, ts, close, first_value(close) OVER (PARTITION BY symbol, CAST(date_trunc('year', ts) AS DATE) ORDER BY ts) AS entry, max(close) OVER (PARTITION BY symbol, CAST(date_trunc('year', ts) AS DATE) ORDER BY ts) AS peak, min(close) OVER (PARTITION BY symbol, CAST(date_trunc('year', ts) AS DATE) ORDER BY ts) AS low, CAST(date_trunc('year', ts) AS DATE) AS opened FROM bars),
x AS (SELECT *, CASE WHEN close <= entry * 90e-2 THEN 'stop' WHEN close >= entry * 125e-2 THEN 'target' WHEN close <= peak * 85e-2 THEN 'trailing' END AS long_exit, CASE WHEN close >= entry * 110e-2 THEN 'stop' WHEN close <= entry * 75e-2 THEN 'target' WHEN close >= low * 115e-2 THEN 'trailing' END AS short_exit FROM e)
SELECT symbol, opened, min(CASE WHEN long_exit IS NOT NULL THEN ts END) AS long_exit_ts, min_by(long_exit, CASE WHEN long_exit IS NOT NULL THEN ts END) AS long_reason, min(CASE WHEN short_exit IS NOT NULL THEN ts END) AS short_exit_ts, min_by(short_exit, CASE WHEN short_exit IS NOT NULL THEN ts END) AS short_reason FROM x GROUP BY symbol, opened""", "bars")
add("sim_gap_momentum_day", """+ r AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts, event_id) AS rn FROM ticks), e AS (SELECT symbol, day, max(CASE WHEN rn = 3 THEN price END) AS entry, max(rn) AS n FROM r GROUP BY symbol, day HAVING max(rn) >= 3),
x AS (SELECT e.symbol, e.day, entry, min(CASE WHEN r.rn > 3 AND r.rn <= 123 AND r.price <= entry * 70e-2 THEN r.rn END) AS stopped, least(max(r.rn), 123) AS last FROM e JOIN r ON r.symbol = e.symbol AND r.day = e.day GROUP BY e.symbol, e.day, entry)
SELECT x.symbol, x.day, entry, CASE WHEN stopped IS NULL THEN 'time' ELSE 'stop' END AS reason, CAST(coalesce(stopped, last) AS BIGINT) AS bar, round(100 * (CASE WHEN stopped IS NULL THEN r.price ELSE entry * 70e-2 END / nullif(entry, 0) - 1), 4) AS pnl_pct FROM x JOIN r ON r.symbol = x.symbol AND r.day = x.day AND r.rn = coalesce(stopped, last)""", "ticks")

# --- regimes ----------------------------------------------------------------------------------------------
ASSET = f"""asset AS (SELECT s.sector AS symbol, b.ts, round(avg(b.close), 4) AS px FROM bars b JOIN sectors s ON b.symbol = s.symbol GROUP BY s.sector, b.ts)"""
add("reg_vix_level", "SELECT ts, round(CASE WHEN vix < 12 THEN 1 WHEN vix < 20 THEN 1 - (vix - 12) / 16 WHEN vix < 30 THEN 5e-1 - (vix - 20) / 25 ELSE greatest(0, 1e-1 * exp(-(vix - 30) / 10)) END, 5) AS signal FROM market", "market")
add("reg_term_structure", f"+ x AS (SELECT ts, avg(vix) {over(9, '')} AS short, avg(vix) {over(60, '')} AS long FROM market) SELECT ts, round(100 * (long - short) / nullif(short, 0), 4) AS slope_pct, CASE WHEN long > short THEN 'contango' ELSE 'backwardation' END AS shape FROM x", "market")
add("reg_credit_spread", f"""+ {ASSET}, x AS (SELECT a.ts, a.px / b.px AS ratio FROM asset a JOIN asset b ON a.ts = b.ts WHERE a.symbol = 'ASIA' AND b.symbol = 'EUROPE'), y AS (SELECT ts, ratio, avg(ratio) {over(60, "")} AS mu, stddev_pop(ratio) {over(60, "")} AS sd, {lagged("ratio", 19, "")} AS before FROM x)
SELECT ts, round(ratio, 6) AS ratio, round((ratio - mu) / nullif(round(sd, 9), 0), 3) AS z, round(100 * (ratio / before - 1), 4) AS change_20 FROM y""", "bars", "sectors")
add("reg_sector_signal", f"""+ {ASSET}, x AS (SELECT symbol, ts, px / {lagged("px", 20)} - 1 AS ret FROM asset) SELECT ts, round(avg(CASE WHEN symbol IN ('ASIA', 'AMERICA') THEN ret END) - avg(CASE WHEN symbol IN ('AFRICA', 'EUROPE') THEN ret END), 6) AS cyclical_less_defensive FROM x WHERE ret IS NOT NULL GROUP BY ts""", "bars", "sectors")
add("reg_correlation", f"""+ {ASSET}, x AS (SELECT symbol, ts, px / {lagged("px")} - 1 AS ret FROM asset), y AS (SELECT x.symbol, x.ts, CASE WHEN count(x.ret) {over(20, "x.symbol", "x.ts")} = 20 THEN corr(x.ret, m.ret) {over(20, "x.symbol", "x.ts")} END AS rho FROM x JOIN market m ON x.ts = m.ts WHERE x.ret IS NOT NULL)
SELECT ts, count(rho) AS assets, round(avg(rho), 4) AS mean_correlation, CASE WHEN round(avg(rho), 6) > 7e-1 THEN 'stress' WHEN round(avg(rho), 6) > 4e-1 THEN 'normal' ELSE 'dispersed' END AS state FROM y GROUP BY ts HAVING count(rho) >= 3""", "bars", "sectors", "market")
PRINT = f"""fp AS (SELECT ts, vix, avg(vix) {over(20, "")} AS v20, avg(ret) {over(20, "")} AS mu, stddev_samp(ret) {over(20, "")} AS sd, px / nullif(avg(px) {over(50, "")}, 0) - 1 AS gap FROM market),
prints AS (SELECT ts, least(1, vix / 50) AS f1, least(1, greatest(0, 5e-1 + 5e-1 * (vix - v20) / 10)) AS f2, least(1, greatest(0, 5e-1 + 5 * gap)) AS f3, least(1, 2 * abs(mu) / (sd + 1e-4)) AS f4, CASE WHEN vix < 12 THEN 0 WHEN vix < 20 THEN 33e-2 WHEN vix < 30 THEN 67e-2 ELSE 1 END AS f5 FROM fp)"""
add("reg_fingerprint", f"+ {PRINT} SELECT ts, round(f1, 5) AS vix, round(f2, 5) AS vix_trend, round(f3, 5) AS direction, round(f4, 4) AS strength, f5 AS vol_regime FROM prints WHERE f4 IS NOT NULL", "market")
add("reg_similar_periods", f"""+ {PRINT}, m AS (SELECT CAST(date_trunc('year', ts) AS DATE) AS period, avg(f1) AS f1, avg(f2) AS f2, avg(f3) AS f3, avg(f4) AS f4, avg(f5) AS f5 FROM prints GROUP BY CAST(date_trunc('year', ts) AS DATE)), l AS (SELECT max_by(f1, ts) AS g1, max_by(f2, ts) AS g2, max_by(f3, ts) AS g3, max_by(f4, ts) AS g4, max_by(f5, ts) AS g5 FROM prints)
SELECT period, round(1 - (25e-2 * abs(f1 - g1) + 25e-2 * abs(f2 - g2) + 2e-1 * abs(f3 - g3) + 15e-2 * abs(f4 - g4) + 15e-2 * abs(f5 - g5)), 5) AS similarity FROM m JOIN l ON true""", "market")
add("reg_history", f"""+ r AS (SELECT ts, {regime("vix")} AS regime FROM market), c AS (SELECT *, CASE WHEN regime = lag(regime) OVER (ORDER BY ts) THEN 0 ELSE 1 END AS fresh FROM r), g AS (SELECT *, sum(fresh) OVER (ORDER BY ts) AS run FROM c)
SELECT run, regime, min(ts) AS since, count(*) AS days, CASE regime WHEN 'low' THEN 12e-1 WHEN 'normal' THEN 1e0 WHEN 'high' THEN 6e-1 ELSE 3e-1 END AS multiplier FROM g GROUP BY run, regime""", "market")
add("reg_confirmed", f"""+ r AS (SELECT ts, {regime("vix")} AS regime, row_number() OVER (ORDER BY ts) AS rn FROM market), c AS (SELECT *, CASE WHEN rn = 1 OR regime = lag(regime) OVER (ORDER BY ts) THEN regime END AS sure FROM r)
SELECT ts, regime, known(sure) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS confirmed FROM c""", "market")

# --- fitness ----------------------------------------------------------------------------------------------
EQUITY = """eq AS (SELECT symbol, ts, ret, exp(sum(ln(greatest(1 + 1e-1 * ret, 1e-6))) OVER (PARTITION BY symbol ORDER BY ts)) AS equity FROM rets WHERE ret IS NOT NULL),
dr AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS dd FROM eq),
fit AS (SELECT symbol, count(*) AS n, exp(sum(ln(greatest(1 + 1e-1 * ret, 1e-6)))) - 1 AS total, min(dd) AS dd, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252e0) AS sharpe, avg(ret) * sqrt(252e0) / nullif(sqrt(avg(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END)), 0) AS sortino, avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) AS win FROM dr GROUP BY symbol),
cal AS (SELECT *, CASE WHEN n < 20 OR dd >= 0 THEN 0 ELSE greatest(-5, least(10, (pow(1 + total, 252e0 / n) - 1) / abs(dd))) END AS calmar FROM fit)"""
COMPOSITE = """comp AS (SELECT *, (4e-1 * greatest(0, least(3, sharpe)) + 3e-1 * greatest(0, least(4, sortino)) + 2e-1 * greatest(0, least(3, calmar)) + 1e-1 * greatest(0, least(2, 2 * win)))
    * CASE WHEN n < 30 THEN 1e-1 + 9e-1 * n / 30 ELSE 1 - exp(-n / 30e0) END * CASE WHEN dd < -6e-1 THEN 5e-1 WHEN dd < -4e-1 THEN 8e-1 ELSE 1 END AS fitness FROM cal)"""
add("met_multiscale", f"""+ y AS (SELECT symbol, CAST(date_trunc('year', ts) AS DATE) AS year, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252e0) AS sharpe, count(*) AS n FROM rets WHERE ret IS NOT NULL GROUP BY symbol, CAST(date_trunc('year', ts) AS DATE) HAVING count(*) >= 10)
SELECT symbol, count(*) AS periods, round(avg(sharpe), 4) AS mean_sharpe, round(stddev_pop(sharpe), 4) AS std_sharpe, round(min(sharpe), 4) AS worst, round(max(sharpe), 4) AS best, round(1 - stddev_pop(sharpe) / greatest(avg(sharpe), 1e-1), 4) AS consistency FROM y GROUP BY symbol""", "rets")
add("met_short_samples", """+ q AS (SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS month, ret FROM rets WHERE ret IS NOT NULL)
SELECT symbol, month, count(*) AS n, round(CASE WHEN count(*) < 10 THEN 1 ELSE least(10, greatest(1e-1, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / nullif(-sum(CASE WHEN ret < 0 THEN ret ELSE 0 END), 0))) END, 4) AS omega,
  round(CASE WHEN count(CASE WHEN ret < 0 THEN 1 END) = 0 THEN 5 ELSE sqrt(252e0) * avg(ret) / sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) END, 4) AS sortino FROM q GROUP BY symbol, month""", "rets")
add("met_marginal_sharpe", f"""+ {ALIGNED}, t AS (SELECT day, sum(pnl) AS total FROM aligned GROUP BY day), s AS (SELECT a.strategy, stddev_samp(a.pnl) AS sc, stddev_samp(t.total) AS sp, avg(a.pnl) / nullif(stddev_samp(a.pnl), 0) AS own, covar_samp(a.pnl, t.total) / nullif(var_samp(t.total), 0) AS beta, avg(t.total) / nullif(stddev_samp(t.total), 0) AS whole FROM aligned a JOIN t ON a.day = t.day GROUP BY a.strategy)
SELECT strategy, round(beta, 6) AS beta, round((sc / sp) * own - beta * whole, 6) AS marginal_sharpe, round(sum(sc) OVER () / sp, 5) AS diversification_ratio FROM s""", "trades")

# --- portfolios -------------------------------------------------------------------------------------------
RHO = f"{ALIGNED}, rho AS (SELECT a.strategy AS a, b.strategy AS b, corr(a.pnl, b.pnl) AS rho FROM aligned a JOIN aligned b ON a.day = b.day AND a.strategy <> b.strategy GROUP BY a.strategy, b.strategy)"
add("port_regime_correlation", f"""+ {DAILY}, x AS (SELECT {regime("m.vix", 15, 25, 40)} AS regime, a.strategy AS a, b.strategy AS b, a.pnl AS pa, b.pnl AS pb FROM daily_pnl a JOIN daily_pnl b ON a.day = b.day AND a.strategy < b.strategy JOIN market m ON CAST(m.ts AS DATE) = a.day)
SELECT regime, a, b, count(*) AS days, round(corr(pa, pb), 6) AS rho FROM x GROUP BY regime, a, b HAVING count(*) >= 5""", "trades", "market")
add("port_cluster_exposure", f"""+ {RHO}, m AS (SELECT round(avg(abs(rho)), 9) AS level FROM rho WHERE a < b)
SELECT round(level, 6) AS mean_correlation, CASE WHEN level > 85e-2 THEN 'critical' WHEN level > 75e-2 THEN 'high' WHEN level > 65e-2 THEN 'elevated' ELSE 'none' END AS alert, CASE WHEN level > 85e-2 THEN 4e-1 WHEN level > 75e-2 THEN 6e-1 WHEN level > 65e-2 THEN 8e-1 ELSE 1e0 END AS multiplier FROM m""", "trades")
VOTES = "votes AS (SELECT symbol, CAST(date_trunc('month', exit_ts) AS DATE) AS month, strategy, CASE WHEN exit_reason = 'stop' THEN 'close' ELSE side END AS side, round(abs(pnl_pct) / 20, 6) AS strength FROM trades)"
add("port_conflicts", f"""+ {VOTES}, g AS (SELECT symbol, month, count(*) AS n, count(CASE WHEN side = 'close' THEN 1 END) AS closes, count(CASE WHEN side = 'buy' THEN 1 END) AS buys, count(CASE WHEN side = 'sell' THEN 1 END) AS sells, sum(CASE WHEN side = 'buy' THEN strength ELSE 0 END) AS buy, sum(CASE WHEN side = 'sell' THEN strength ELSE 0 END) AS sell, min_by(side, (strategy, side)) AS first, avg(strength) AS mean FROM votes GROUP BY symbol, month)
SELECT symbol, month, CASE WHEN closes > 0 THEN 'close' WHEN buys > 0 AND sells > 0 THEN 'none' WHEN buys > 0 THEN 'buy' ELSE 'sell' END AS cancel, CASE WHEN closes > 0 THEN 'close' WHEN buys > sells THEN 'buy' WHEN sells > buys THEN 'sell' ELSE 'none' END AS majority,
  CASE WHEN closes > 0 THEN 'close' ELSE first END AS hierarchy, CASE WHEN closes > 0 THEN 'close' WHEN round(buy - sell, 6) > 0 THEN 'buy' WHEN round(sell - buy, 6) > 0 THEN 'sell' ELSE 'none' END AS confidence, round(least(mean + least(1e-1 * n, 3e-1), 1), 5) AS strength FROM g""", "trades")
add("port_agreement", f"""+ {VOTES}, g AS (SELECT symbol, month, count(*) AS n, greatest(count(CASE WHEN side = 'close' THEN 1 END), count(CASE WHEN side = 'buy' THEN 1 END), count(CASE WHEN side = 'sell' THEN 1 END)) AS most FROM votes GROUP BY symbol, month)
SELECT symbol, month, n, round(most * 1e0 / n, 6) AS agreement, CASE WHEN n < 2 THEN 'low' WHEN most * 1e0 / n >= 8e-1 THEN 'high' WHEN most * 1e0 / n >= 6e-1 THEN 'medium' ELSE 'low' END AS confidence FROM g""", "trades")
add("port_multipliers", f"""+ m AS (SELECT strategy, CAST(date_trunc('month', exit_ts) AS DATE) AS month, avg(pnl) / nullif(stddev_samp(pnl), 0) AS sharpe FROM trades GROUP BY strategy, CAST(date_trunc('month', exit_ts) AS DATE)), r AS (SELECT strategy, month, round(avg(sharpe) OVER w, 8) AS mean, count(sharpe) OVER w AS n FROM m WINDOW w AS (PARTITION BY strategy ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT strategy, month, round(mean, 5) AS mean_sharpe, CASE WHEN n < 3 THEN 1e0 WHEN mean > 1 THEN 12e-1 WHEN mean > 5e-1 THEN 1e0 WHEN mean > 0 THEN 8e-1 ELSE 5e-1 END AS multiplier FROM r""", "trades")
KELLY = "k AS (SELECT strategy, avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END) AS win, avg(CASE WHEN pnl > 0 THEN pnl END) AS gain, -avg(CASE WHEN pnl < 0 THEN pnl END) AS loss, avg(pnl) AS mean, stddev_samp(pnl) AS sd, count(*) AS n FROM trades GROUP BY strategy)"
add("port_kelly", f"""+ {KELLY}, f AS (SELECT *, greatest(0, least(25e-2, 25e-2 * (win - (1 - win) / nullif(gain / loss, 0)))) AS kelly FROM k)
SELECT strategy, round(kelly, 6) AS quarter_kelly, CAST(floor(least(least(15000, 100000 * kelly), 95000) / 100) AS BIGINT) AS shares, round(greatest(25e-2, least(15e-1, 5e-1 * (4 * kelly) + 5e-1 * (win / 5e-1) * least(15e-1, mean / nullif(sd, 0) + 1))), 5) AS scalar FROM f""", "trades")
add("port_conviction", f"""+ {KELLY} SELECT strategy, n, round(100 * greatest(0, least(1, win + 5e-2 * CASE WHEN gain > loss THEN 1 ELSE -1 END)), 3) AS score, round(mean - 196e-2 * sd / sqrt(n), 4) AS low, round(mean + 196e-2 * sd / sqrt(n), 4) AS high FROM k""", "trades")
add("port_gates", """SELECT trade_id, symbol, qty, CASE WHEN slippage_bps > 48 THEN 'reject: slippage' WHEN qty * price > 80000 THEN 'reject: size' WHEN pnl_pct < -8 THEN 'reject: edge' WHEN qty < 3 THEN 'route: batch' ELSE 'approve' END AS decision, CAST(CASE WHEN qty * price > 15000 THEN floor(15000 / price) ELSE qty END AS BIGINT) AS sized FROM trades""", "trades")
add("port_gain_trim", """SELECT trade_id, symbol, qty, CAST(CASE WHEN days(exit_ts, entry_ts) <= 30 AND pnl_pct >= 3 AND qty >= 3 THEN least(greatest(1, floor(qty * 33e-2)), qty - 1) ELSE 0 END AS BIGINT) AS trim FROM trades""", "trades")
EQ = "e AS (SELECT CAST(exit_ts AS DATE) AS day, round(sum(pnl), 2) AS pnl FROM trades GROUP BY CAST(exit_ts AS DATE)), c AS (SELECT day, pnl, round(1e5 + sum(pnl) OVER (ORDER BY day), 2) AS equity FROM e), b AS (SELECT *, max(equity) OVER (ORDER BY day) AS peak, lag(equity) OVER (ORDER BY day) AS before FROM c)"
add("risk_breakers", f"+ {EQ} SELECT day, round(100 * pnl / before, 5) AS day_pct, round(100 * (equity / peak - 1), 5) AS drawdown_pct, CASE WHEN pnl / before <= -2e-2 THEN 'halt' WHEN equity / peak - 1 <= -15e-2 THEN 'reduce' WHEN pnl / before <= -1e-2 THEN 'warn' ELSE 'none' END AS action FROM b WHERE before IS NOT NULL", "trades")
add("risk_rapid_loss", f"+ {EQ}, w AS (SELECT day, equity, first_value(equity) OVER (ORDER BY day ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS oldest FROM b) SELECT day, round(100 * (equity / oldest - 1), 5) AS change_pct, equity / oldest - 1 <= -1e-2 AS halted FROM w", "trades")

# --- reports ----------------------------------------------------------------------------------------------
RUNS = "runs AS (SELECT symbol AS run, CAST(date_trunc('month', ts) AS DATE) AS generation, strategy, best FROM (SELECT b.symbol, b.ts, s.sector AS strategy, b.close AS best FROM bars b JOIN sectors s ON b.symbol = s.symbol) q)"
add("rep_generations", f"+ {RUNS}, g AS (SELECT strategy, count(DISTINCT generation) AS generations, max(best) AS best, max(generation) AS updated FROM runs GROUP BY strategy), m AS (SELECT strategy, generation, max(best) AS best FROM runs GROUP BY strategy, generation), t AS (SELECT *, lag(best) OVER (PARTITION BY strategy ORDER BY generation) AS before, row_number() OVER (PARTITION BY strategy ORDER BY generation DESC) AS back FROM m) SELECT g.strategy, generations, g.best, updated, CASE WHEN t.best > before * 101e-2 THEN 'up' WHEN t.best < before * 99e-2 THEN 'down' ELSE 'flat' END AS trend FROM g JOIN t ON g.strategy = t.strategy AND back = 1", "bars", "sectors")
add("rep_best_rows", f"+ {RUNS} SELECT strategy, max(best) AS best, max_by(generation, (best, run, generation)) AS generation, max_by(run, (best, run, generation)) AS run FROM runs GROUP BY strategy HAVING max(best) <> 0", "bars", "sectors")
add("rep_global_best", f"+ {RUNS} SELECT strategy, run, generation, best FROM runs ORDER BY best DESC, run, generation LIMIT 1", "bars", "sectors")
add("rep_run_details", f"+ {RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY best DESC, run, generation) AS rn FROM runs WHERE strategy IN ('ASIA', 'EUROPE', 'AMERICA')) SELECT strategy, run, generation, best FROM k WHERE rn <= 5", "bars", "sectors")
add("rep_improvement", f"+ {RUNS}, m AS (SELECT strategy, generation, max(best) AS best FROM runs GROUP BY strategy, generation) SELECT strategy, count(*) AS generations, min_by(best, generation) AS first_best, max_by(best, generation) AS last_best, round(100 * (max_by(best, generation) / min_by(best, generation) - 1), 4) AS improvement_pct FROM m GROUP BY strategy", "bars", "sectors")
add("rep_stagnation", f"+ {RUNS}, m AS (SELECT strategy, generation, max(best) AS best FROM runs GROUP BY strategy, generation), d AS (SELECT *, abs(best - lag(best, 9) OVER (PARTITION BY strategy ORDER BY generation)) / best AS moved, row_number() OVER (PARTITION BY strategy ORDER BY generation DESC) AS back FROM m) SELECT strategy, count(CASE WHEN moved < 1e-2 THEN 1 END) AS plateaus, max(CASE WHEN back = 1 AND moved < 1e-2 THEN 1 ELSE 0 END) AS stagnant FROM d GROUP BY strategy", "bars", "sectors")
add("rep_history_window", f"+ {RUNS}, m AS (SELECT strategy, generation, max(best) AS best FROM runs GROUP BY strategy, generation) SELECT strategy, generation, best FROM m WHERE generation >= DATE '1998-01-01' ORDER BY strategy, generation", "bars", "sectors")
add("rep_gene_similarity", "+ g AS (SELECT 'price' AS gene, CAST(floor(p_retailprice / 100) AS BIGINT) AS value FROM {part} UNION ALL SELECT 'size', CAST(p_size AS BIGINT) FROM {part}), c AS (SELECT gene, value, count(*) AS n FROM g GROUP BY gene, value), m AS (SELECT gene, max(n) * 1e0 / sum(n) AS mode_share FROM c GROUP BY gene) SELECT round(avg(mode_share), 6) AS similarity, count(*) AS genes FROM m", "sectors")
add("rep_execution_trend", "SELECT CAST(exit_ts AS DATE) AS day, count(*) AS n, round(avg(slippage_bps), 4) AS mean_bps, round(sum(slippage_bps * price * qty / 1e4), 2) AS dollars FROM trades GROUP BY CAST(exit_ts AS DATE)", "trades")
add("rep_execution_alerts", "SELECT trade_id, symbol, exit_ts, slippage_bps, CASE WHEN slippage_bps >= 50 THEN 'severe' ELSE 'high' END AS level FROM trades WHERE abs(slippage_bps) > 45 AND exit_ts >= TIMESTAMP '1998-06-01 00:00:00'", "trades")
add("rep_recent_win_rate", f"+ {DAILY}, k AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY day DESC) AS back FROM daily_pnl) SELECT strategy, count(CASE WHEN pnl > 0 THEN 1 END) AS wins, count(CASE WHEN pnl <= 0 THEN 1 END) AS losses, round(avg(pnl), 4) AS mean FROM k WHERE back <= 10 GROUP BY strategy", "trades")
add("rep_shadow", "SELECT strategy, count(*) AS trades, round(100 * avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END), 4) AS win_pct, round(avg(days(exit_ts, entry_ts)) * 1440, 3) AS hold_minutes, round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(abs(sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END)), 0), 5) AS profit_factor, max(pnl) AS best, min(pnl) AS worst FROM trades GROUP BY strategy", "trades")
add("rep_strategy_table", "SELECT strategy, concat(CAST(count(CASE WHEN pnl > 0 THEN 1 END) AS VARCHAR(20)), '/', CAST(count(*) AS VARCHAR(20))) AS won, round(sum(pnl) / 10000, 5) AS pnl_units FROM trades GROUP BY strategy ORDER BY pnl_units DESC, strategy", "trades")
add("rep_backtests", "SELECT symbol, count(*) AS bars, round(100 * (max_by(close, ts) / min_by(close, ts) - 1), 4) AS return_pct FROM bars GROUP BY symbol ORDER BY return_pct DESC, symbol LIMIT 20", "bars")
add("rep_key_counts", "SELECT p_type, count(CASE WHEN p_brand LIKE 'Brand#1_' THEN 1 END) AS first_maker, count(CASE WHEN p_brand LIKE '%#_5' THEN 1 END) AS fifth_brand, count(DISTINCT p_brand) AS brands FROM {part} GROUP BY p_type")
add("rep_risk", "+ h AS (SELECT s.sector, t.symbol, sum(qty * price) AS held FROM trades t JOIN sectors s ON t.symbol = s.symbol WHERE side = 'buy' GROUP BY s.sector, t.symbol), a AS (SELECT sector, sum(held) AS held, max(held) AS largest FROM h GROUP BY sector) SELECT sector, round(100 * held / sum(held) OVER (), 4) AS exposure_pct, round(100 * largest / sum(held) OVER (), 4) AS largest_pct FROM a", "trades", "sectors")
add("rep_stale_signals", "SELECT o_orderkey, o_orderstatus, CAST(days(TIMESTAMP '1998-12-01 00:00:00', o_orderdate) AS BIGINT) AS age, CASE WHEN o_orderstatus = 'O' AND days(TIMESTAMP '1998-12-01 00:00:00', o_orderdate) > 365 THEN 'expired' WHEN o_orderstatus = 'P' THEN 'cancelled' ELSE o_orderstatus END AS status FROM {orders} WHERE o_orderstatus IN ('O', 'P')")
add("rep_state_log", "+ x AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM {events}) SELECT user_id, event_type AS state, ts AS since FROM x WHERE back = 1".replace("+ x AS", "WITH x AS"))
add("rep_overview", "SELECT count(*) AS trades, count(DISTINCT strategy) AS strategies, round(avg(pnl), 5) AS mean_pnl, max(pnl) AS best, count(CASE WHEN pnl_pct > 5 THEN 1 END) AS strong, round(avg(CASE WHEN side = 'buy' THEN pnl END), 5) AS mean_buy FROM trades", "trades")
add("rep_decisions", "SELECT CAST(date_trunc('month', exit_ts) AS DATE) AS month, count(*) AS decisions, count(CASE WHEN exit_reason = 'target' THEN 1 END) AS approved, count(CASE WHEN exit_reason = 'stop' THEN 1 END) AS rejected FROM trades GROUP BY CAST(date_trunc('month', exit_ts) AS DATE)", "trades")
add("rep_weekly", f"+ {DAILY} SELECT strategy, CAST(date_trunc('week', day) AS DATE) AS week, round(sum(pnl), 2) AS pnl, count(*) AS days, round(avg(pnl), 4) AS mean FROM daily_pnl GROUP BY strategy, CAST(date_trunc('week', day) AS DATE)", "trades")
add("rep_sector_breakdown", "SELECT sector, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM sectors GROUP BY sector", "sectors")
add("rep_cache_ages", "SELECT p_brand AS provider, count(CASE WHEN p_size <= 30 THEN 1 END) AS valid, count(CASE WHEN p_size > 30 THEN 1 END) AS stale, min(p_size) AS youngest, max(p_size) AS oldest FROM {part} GROUP BY p_brand")
add("rob_grid_search", f"""+ g AS (SELECT f.v AS fast, s.v AS slow FROM (SELECT 5 AS v UNION ALL SELECT 10 UNION ALL SELECT 20) f JOIN (SELECT 30 AS v UNION ALL SELECT 50) s ON f.v < s.v), m AS (SELECT symbol, ts, ret, lead(ret) OVER (PARTITION BY symbol ORDER BY ts) AS following, {", ".join(f"avg(close) {over(n)} AS a{n}" for n in (5, 10, 20, 30, 50))} FROM rets),
r AS (SELECT fast, slow, following * CASE WHEN round(CASE fast WHEN 5 THEN a5 WHEN 10 THEN a10 ELSE a20 END - CASE slow WHEN 30 THEN a30 ELSE a50 END, 6) > 0 THEN 1 ELSE 0 END AS x FROM m JOIN g ON true WHERE following IS NOT NULL)
SELECT fast, slow, count(*) AS n, round(avg(x) / nullif(stddev_samp(x), 0) * sqrt(252e0), 4) AS sharpe FROM r GROUP BY fast, slow""", "rets")
