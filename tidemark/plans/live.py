"""Queries that run as streams with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.composed import cut
from tidemark.plans.views import rounded
from tidemark.sources import table
from tidemark.streaming import run_appended
from tidemark.streaming.breakers import Limits, breaker_changes
from tidemark.streaming.marks import marked, newest

#: An event's value less their mean stands for a closed trade's result, its user for the strategy.
MIDDLE, CAPITAL = 50, 2000


def stream_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trip, release and expiry of the strategies' breakers, complete to ten minutes before the newest trade; no account is forgotten."""

    def build(events: DataFrame) -> DataFrame:
        return breaker_changes(events.select("ts", F.col("event_id").alias("trade_id"), F.col("user_id").alias("strategy"), (F.col("value") - MIDDLE).alias("pnl")), Limits(capital=float(CAPITAL), idle=None))

    rows = run_appended(spark, sf_dir, "events.parquet", build)
    time = lambda c: F.when(F.col(c) >= 0, F.timestamp_micros(c).cast("timestamp_ntz"))
    return rows.select("strategy", time("at").alias("changed_at"), "breaker", "action", "change", time("until").alias("until"))


def stream_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as shadow positions of the users whose events are prices: last mark and extremes of each."""
    opened = F.timestamp_add("DAY", F.col("o_orderkey") % 31, F.lit("2024-01-01").cast("timestamp_ntz"))
    positions = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("position_id"), F.col("o_custkey").alias("symbol"), F.when(F.col("o_orderstatus") == "F", "short").otherwise("long").alias("side"), (1 + F.col("o_orderkey") % 50).alias("shares"), (20 + F.col("o_totalprice") % 60).alias("entry_price"),
        opened.alias("opened_at"), F.when(F.col("o_orderstatus") == "P", F.timestamp_add("DAY", F.lit(3), opened)).alias("closed_at"),
    )

    def build(events: DataFrame) -> DataFrame:
        return marked(events.select(F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("tick_id"), F.col("value").alias("price")), positions)

    rows = newest(run_appended(spark, sf_dir, "events.parquet", build, mode="update"))
    return rows.select("position_id", "current_price", *(cut(F.col(c), 2).alias(c) for c in ("unrealized_pnl", "max_profit", "max_drawdown")), "ticks", F.col("marked_at").cast("timestamp_ntz").alias("marked_at"))


QUERIES = {f.__name__: f for f in (stream_breakers, stream_marks)}

#: A fold over each strategy's trades, one recursion a trade.
ORACLE = {
    "stream_breakers": f"""WITH RECURSIVE e AS (SELECT user_id AS strategy, ts AS tm, value - {MIDDLE} AS pnl, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {{events}} WHERE epoch_us(ts) <= 1000 * ((SELECT max(epoch_ms(ts)) FROM {{events}}) - 600000)),
q AS (SELECT *, {CAPITAL} + sum(pnl) OVER w AS equity, CAST(tm AS DATE) AS day, {CAPITAL} + coalesce(sum(pnl) OVER v, 0) AS before FROM e WINDOW w AS (PARTITION BY strategy ORDER BY rn), v AS (PARTITION BY strategy ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, greatest({CAPITAL}, max(equity) OVER (PARTITION BY strategy ORDER BY rn)) AS peak, first(before) OVER (PARTITION BY strategy, day ORDER BY rn) AS day_equity, sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy ORDER BY rn) AS wins FROM q),
s AS MATERIALIZED (SELECT strategy, rn, tm, day, day_equity > 0 AND day_equity - equity >= 2e-2 * day_equity AS loses, (peak - equity) / peak AS fallen, sum(CASE WHEN pnl > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY strategy, wins ORDER BY rn) >= 5 AS streak, {CAPITAL} - equity >= {CAPITAL // 20} AS lost FROM p),
f AS (SELECT strategy, 0::BIGINT AS rn, NULL::TIMESTAMP AS tm, NULL::TIMESTAMP AS halted, NULL::TIMESTAMP AS paused, NULL::TIMESTAMP AS stopped, false AS reduced, false AS h, false AS c, false AS d, 0 AS r FROM s WHERE rn = 1
  UNION ALL SELECT x.strategy, s.rn, s.tm, CASE WHEN hf AND s.loses THEN s.day + INTERVAL '1 day 9 hours 30 minutes' WHEN hf THEN NULL ELSE halted END, CASE WHEN pf AND s.streak THEN s.tm + INTERVAL 4 HOUR WHEN pf THEN NULL ELSE paused END, CASE WHEN sf AND s.lost THEN s.tm + INTERVAL 24 HOUR WHEN sf THEN NULL ELSE stopped END,
    CASE WHEN x.reduced THEN s.fallen >= 75e-3 ELSE s.fallen >= 15e-2 END, hf AND s.loses, pf AND s.streak, sf AND s.lost, CASE WHEN x.reduced AND s.fallen < 75e-3 THEN -1 WHEN NOT x.reduced AND s.fallen >= 15e-2 THEN 1 ELSE 0 END
    FROM (SELECT f.*, g.tm AS now, f.halted IS NULL OR f.halted <= g.tm AS hf, f.paused IS NULL OR f.paused <= g.tm AS pf, f.stopped IS NULL OR f.stopped <= g.tm AS sf FROM f JOIN s g ON g.strategy = f.strategy AND g.rn = f.rn + 1) x JOIN s ON s.strategy = x.strategy AND s.rn = x.rn + 1),
t AS (SELECT strategy, tm, 'daily_loss' AS breaker, 'halt' AS action, halted AS until FROM f WHERE h UNION ALL SELECT strategy, tm, 'consecutive_loss', 'pause', paused FROM f WHERE c UNION ALL SELECT strategy, tm, 'strategy_loss', 'pause', stopped FROM f WHERE d)
SELECT strategy, tm AS changed_at, breaker, action, 'trip' AS change, until FROM t UNION ALL SELECT strategy, until, breaker, action, 'expire', until FROM t WHERE epoch_us(until) <= 1000 * ((SELECT max(epoch_ms(ts)) FROM {{events}}) - 600000)
UNION ALL SELECT strategy, tm, 'drawdown', 'reduce', CASE r WHEN 1 THEN 'trip' ELSE 'release' END, NULL FROM f WHERE r <> 0""",
    "stream_marks": rounded("""WITH p AS (SELECT *, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (o_orderkey % 31) AS opened FROM {orders}),
m AS (SELECT o_orderkey, ts, event_id, value, CASE WHEN o_orderstatus = 'F' THEN 20 + o_totalprice % 60 - value ELSE value - (20 + o_totalprice % 60) END * (1 + o_orderkey % 50) AS pnl FROM p JOIN {events} ON user_id = o_custkey AND ts >= opened AND (o_orderstatus <> 'P' OR ts < opened + INTERVAL 3 DAY)),
l AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY ts DESC, event_id DESC) AS back FROM m)
SELECT o_orderkey AS position_id, any_value(value) FILTER (back = 1) AS current_price, round(any_value(pnl) FILTER (back = 1), 2) AS unrealized_pnl, round(greatest(max(pnl), 0), 2) AS max_profit, round(greatest(max(-pnl), 0), 2) AS max_drawdown, count(*) AS ticks, max(ts) AS marked_at FROM l GROUP BY o_orderkey"""),
}
