"""Rotation and rebalancing dates behind gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.gates import after_change, after_gap, chained
from tidemark.plans.composed import bars, cut
from tidemark.plans.views import over, rounded, with_views


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, state): whether the close is over, under or within a tenth of its mean of 20 bars."""
    mean = F.avg("close").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-19, 0))
    apart = cut(F.col("close") / mean, 6)
    return bars(spark, sf_dir).select("symbol", "ts", F.when(apart > 1.1, "over").when(apart < 0.9, "under").otherwise("near").alias("state"))


def strat_rotation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates on which a symbol's position is rotated: the state is another one than at the last rotation, five days ago at least."""
    rows = _states(spark, sf_dir)
    return chained(after_change(rows, ["symbol"], "ts", "state", 5), ["symbol"], "ts", 5, ("state",))


def strat_rebalance_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates on which a symbol is rebalanced: 28 days after the last time at least."""
    rows = bars(spark, sf_dir).select("symbol", "ts")
    return chained(after_gap(rows, ["symbol"], "ts", 28), ["symbol"], "ts", 28)


QUERIES = {f.__name__: f for f in (strat_rotation_gates, strat_rebalance_gates)}
#: One recursion for each date let through.
ORACLE = {
    "strat_rotation_gates": "WITH RECURSIVE " + with_views(f"""+ q AS MATERIALIZED (SELECT symbol, ts, round(close / avg(close) {over(20)}, 6) AS r FROM bars), s AS MATERIALIZED (SELECT symbol, ts, CASE WHEN r > 1.1 THEN 'over' WHEN r < 0.9 THEN 'under' ELSE 'near' END AS state FROM q),
g AS (SELECT symbol, min(ts) AS ts, arg_min(state, ts) AS state FROM s GROUP BY symbol UNION ALL SELECT g.symbol, min(s.ts), arg_min(s.state, s.ts) FROM g JOIN s ON s.symbol = g.symbol AND s.ts >= g.ts + INTERVAL 5 DAY AND s.state <> g.state GROUP BY g.symbol)
SELECT symbol, ts, state FROM g""", "bars").removeprefix("WITH "),
    "strat_rebalance_gates": "WITH RECURSIVE " + with_views("""+ s AS MATERIALIZED (SELECT symbol, ts FROM bars), g AS (SELECT symbol, min(ts) AS ts FROM s GROUP BY symbol UNION ALL SELECT g.symbol, min(s.ts) FROM g JOIN s ON s.symbol = g.symbol AND s.ts >= g.ts + INTERVAL 28 DAY GROUP BY g.symbol)
SELECT symbol, ts FROM g""", "bars").removeprefix("WITH "),
}
ORACLE = {name: rounded(text) for name, text in ORACLE.items()}
