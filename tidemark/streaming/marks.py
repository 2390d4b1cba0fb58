"""Open positions marked to a stream of prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marked(ticks: DataFrame, positions: DataFrame) -> DataFrame:
    """Each position's last price, open result and extremes so far, from a stream (or table) of ticks.

    ticks: symbol, ts, tick_id, price; positions (a static table): position_id,
    symbol, side (``long`` or ``short``), shares, entry_price, opened_at,
    closed_at (null while open). A tick counts from opened_at on and until
    closed_at. Profit and drawdown are 0 at least; ticks of one time go by
    tick_id, and late ones count towards the extremes. Null prices and times are
    left out. In a stream of update mode a batch gives the positions that it
    changes; the state is a row for each position that has had a tick.
    """
    held = positions.select("position_id", F.col("symbol").alias("_symbol"), "side", F.col("shares").cast("double").alias("shares"), F.col("entry_price").cast("double").alias("entry_price"), F.col("opened_at").cast("timestamp").alias("opened_at"), F.col("closed_at").cast("timestamp").alias("closed_at"))
    open_then = (F.col("symbol") == F.col("_symbol")) & (F.col("ts") >= F.col("opened_at")) & (F.col("closed_at").isNull() | (F.col("ts") < F.col("closed_at")))
    pairs = ticks.where("price is not null and ts is not null").select("symbol", "ts", "tick_id", F.col("price").cast("double").alias("price")).join(held, open_then)
    gain = F.when(F.col("side") == "short", -1.0).otherwise(1.0) * (F.col("price") - F.col("entry_price")) * F.col("shares")
    last = F.struct("ts", "tick_id")
    return pairs.withColumn("pnl", gain).groupBy("position_id").agg(
        F.max_by("price", last).alias("current_price"), F.max_by("pnl", last).alias("unrealized_pnl"), F.greatest(F.max("pnl"), F.lit(0.0)).alias("max_profit"), F.greatest(-F.min("pnl"), F.lit(0.0)).alias("max_drawdown"), F.count("*").alias("ticks"), F.max("ts").alias("marked_at"),
    )


def newest(rows: DataFrame, key: str = "position_id") -> DataFrame:
    """Of an updated result (with ``batch``) each key's last row."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (key, "batch"))), "batch").alias("_row"))
    return last.select(key, "_row.*")
