"""How a strategy behaves: ten features of its trades and its equity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ["trade_frequency", "avg_hold", "long_short", "autocorrelation", "drawdown", "benchmark_correlation", "volatility", "recovery", "profit_factor", "sharpe"]


def behavior(trades: DataFrame, benchmark: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """(strategy, FEATURES) of trades (strategy, side, entry_ts, exit_ts, pnl) and benchmark returns (day, bench).

    The equity is capital plus the results (to cents) closed by the end of each
    day with a close. Trades a week of five such days; mean days held (negative ones as 0); longs
    (side ``buy``) less shorts over all; the returns' correlation with the day
    before; the deepest drawdown from the running high, at most 1; correlation
    with the benchmark over more than 10 common days; the returns' deviation; days
    from the first deepest point to the first that is within 0.1 % of its high, or to the
    end counted with its own; gains over losses from 0.1 to 5 (3 without losses, 1
    without either); and the yearly Sharpe ratio from -2 to 5 of more than 20
    returns. What can't be told is 0. Rows without strategy or close are left out.
    """
    known = trades.where("strategy is not null and exit_ts is not null").withColumn("day", F.to_date("exit_ts"))
    w, whole = Window.partitionBy("strategy").orderBy("day"), Window.partitionBy("strategy")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    days = known.groupBy("strategy", "day").agg(
        F.sum("pnl").alias("pnl"), F.count("*").alias("trades"), F.sum(F.greatest(F.datediff("exit_ts", "entry_ts"), F.lit(0))).alias("held"), F.count("entry_ts").alias("dated"), F.count(F.when(F.col("side") == "buy", 1)).alias("longs"),
        F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)).alias("won"), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0)).alias("lost"),
    )
    days = days.withColumns({"equity": capital + F.floor(100 * F.sum("pnl").over(so_far) + 0.5) / 100, "at": F.row_number().over(w)})
    days = days.withColumns({"ret": F.col("equity") / F.nullif(F.lag("equity").over(w), F.lit(0.0)) - 1, "fall": F.coalesce((F.col("equity") - F.max("equity").over(so_far)) / F.nullif(F.max("equity").over(so_far), F.lit(0.0)), F.lit(0.0))})
    days = days.withColumns({"before": F.lag("ret").over(w), "trough": F.min(F.struct("fall", "at")).over(whole)["at"]})
    days = days.join(benchmark.select("day", "bench").where("bench is not null"), "day", "left")

    def correlation(x: str, y: str, least: int):  # noqa: ANN202
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
        spread = F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
        return F.when(F.count(F.when(both, 1)) >= least, F.coalesce(F.covar_pop(a, b) / spread, F.lit(0.0))).otherwise(0.0)

    back = F.min(F.when((F.col("at") >= F.col("trough")) & (F.col("fall") >= -0.001), F.col("at")))
    trough, n, spread = F.first("trough"), F.count("*"), F.stddev_samp("ret")
    gains, losses = F.sum("won"), F.sum("lost")
    return days.groupBy("strategy").agg(
        (F.sum("trades") / F.greatest(n / 5, F.lit(1.0))).alias("trade_frequency"), F.coalesce(F.sum("held") / F.nullif(F.sum("dated"), F.lit(0)), F.lit(1.0)).alias("avg_hold"), ((2 * F.sum("longs") - F.sum("trades")) / F.sum("trades")).alias("long_short"),
        correlation("ret", "before", 2).alias("autocorrelation"), F.least(-F.min("fall"), F.lit(1.0)).alias("drawdown"), correlation("ret", "bench", 11).alias("benchmark_correlation"), F.coalesce(spread, F.lit(0.0)).alias("volatility"),
        F.when(F.min("fall") < 0, F.coalesce(back - trough, n - trough + 1)).otherwise(0).cast("double").alias("recovery"),
        F.when(losses > 0, F.greatest(F.lit(0.1), F.least(F.lit(5.0), gains / F.nullif(losses, F.lit(0.0))))).when(gains > 0, 3.0).otherwise(1.0).alias("profit_factor"),
        F.when((F.count("ret") > 20) & (spread > 1e-10), F.greatest(F.lit(-2.0), F.least(F.lit(5.0), F.avg("ret") / F.nullif(spread, F.lit(0.0)) * 252**0.5))).otherwise(0.0).alias("sharpe"),
    )
