"""Metrics of equity curves, as aggregates of returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equity_metrics(returns: DataFrame, periods: int = 252) -> DataFrame:
    """(symbol, n, total, drawdown, sharpe, sortino, win, calmar) of returns (symbol, ts, ret), ``periods`` to a year.

    All of one equity curve, the product of 1 + ret from 1; its running high starts
    with the first period's end. Calmar is the yearly growth over the depth of the
    drawdown, within -5 and 10, and 0 for fewer than 20 returns or no drawdown.
    Null returns are left out; ratios without spread are null.
    """
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    known = returns.where("ret is not null").withColumn("_grown", F.log(F.greatest(1 + F.col("ret"), F.lit(1e-12))))
    curve = known.withColumn("_equity", F.sum("_grown").over(w)).withColumn("_fall", F.exp(F.col("_equity") - F.max("_equity").over(w)) - 1)
    year, mean = F.sqrt(F.lit(float(periods))), F.avg("ret")
    spread, below = F.stddev_samp("ret"), F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), F.lit(2.0))))
    told = curve.groupBy("symbol").agg(
        F.count("*").alias("n"), (F.exp(F.sum("_grown")) - 1).alias("total"), F.min("_fall").alias("drawdown"), (year * mean / F.nullif(spread, F.lit(0.0))).alias("sharpe"), (year * mean / F.nullif(below, F.lit(0.0))).alias("sortino"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win"),
    )
    yearly = F.pow(1 + F.col("total"), F.lit(float(periods)) / F.col("n")) - 1
    return told.withColumn("calmar", F.when((F.col("n") < 20) | (F.col("drawdown") >= 0), 0.0).otherwise(F.greatest(F.lit(-5.0), F.least(F.lit(10.0), -yearly / F.col("drawdown")))))


def composite_fitness() -> Column:
    """One number of equity_metrics: clipped ratios by weight, less for few returns and for deep drawdowns."""

    def clipped(c: str, top: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(top), F.coalesce(F.col(c), F.lit(0.0))))

    n = F.col("n")
    raw = 0.4 * clipped("sharpe", 3.0) + 0.3 * clipped("sortino", 4.0) + 0.2 * clipped("calmar", 3.0) + 0.1 * F.least(F.lit(2.0), 2 * F.col("win"))
    trust = F.when(n < 30, 0.1 + 0.9 * n / 30).otherwise(1 - F.exp(-n / 30))
    return raw * trust * F.when(F.col("drawdown") < -0.6, 0.5).when(F.col("drawdown") < -0.4, 0.8).otherwise(1.0)
