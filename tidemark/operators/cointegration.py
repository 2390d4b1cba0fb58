"""Cointegration of pairs: regressions of all pairs at once, from sums of products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidemark.functions import bound, normal_cdf

#: MacKinnon's (1994) response surfaces for two series with a constant: bounds of the statistic,
#: where the polynomial changes, and the polynomials for small and large probabilities, lowest power first.
_LEAST, _TURN, _MOST = -18.86, -2.62, 0.92
_SMALL, _LARGE = (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)


def cointegration_p(t: Column) -> Column:
    """The probability of an Engle-Granger statistic at or below t if two series with a constant aren't cointegrated."""

    def polynomial(x: Column, by: tuple[float, ...]) -> Column:
        out = F.lit(by[-1])
        for c in by[-2::-1]:
            out = out * x + c
        return out

    def of(x: Column) -> Column:
        return F.when(x > _MOST, F.lit(1.0)).when(x < _LEAST, F.lit(0.0)).otherwise(normal_cdf(F.when(x <= _TURN, polynomial(x, _SMALL)).otherwise(polynomial(x, _LARGE))))

    return F.when(t.isNotNull(), bound(t, of))


def gram(y: Column, xs: list[Column]) -> list[Column]:
    """Aggregates that hold a least-squares fit of y on xs: n, y'y, X'y and the upper triangle of X'X."""
    return [F.count("*").cast("double"), F.sum(y * y), *(F.sum(x * y) for x in xs), *(F.sum(xs[i] * xs[j]) for i in range(len(xs)) for j in range(i, len(xs)))]


@F.pandas_udf(ArrayType(DoubleType()))
def _fitted(grams: pd.Series) -> pd.Series:
    """(coefficient, its t statistic) of each regressor in turn from gram's values; null where there is no unique fit."""

    def fit(g: np.ndarray) -> np.ndarray | None:
        k = int((-3 + np.sqrt(9 + 8 * (len(g) - 2))) // 2)
        n, yy, xy = g[0], g[1], np.asarray(g[2 : 2 + k], float)
        xx = np.zeros((k, k))
        xx[np.triu_indices(k)] = g[2 + k :]
        xx = xx + np.triu(xx, 1).T
        scale = np.sqrt(np.diag(xx))
        if n <= k or not np.isfinite(xx).all() or (scale <= 0).any() or np.linalg.cond(xx / np.outer(scale, scale)) > 1e12:
            return None
        inverse = np.linalg.inv(xx)
        beta = inverse @ xy
        rest = max(float(yy - beta @ xy), 0.0) / (n - k)
        error = np.sqrt(rest * np.diag(inverse))
        return np.column_stack([beta, np.divide(beta, error, out=np.full(k, np.nan), where=error > 0)]).ravel()

    return grams.map(lambda g: None if g is None or any(x is None for x in g) else fit(g))


def least_squares(rows: DataFrame, keys: list[str], y: Column, xs: list[Column], name: str = "fit") -> DataFrame:
    """(keys, an array of coefficient and t statistic of each regressor) of a regression without constant in each group.

    A group is summed, never gathered: one row of sums leaves each map task. Rows
    in which a value is null are left out.
    """
    whole = y.isNotNull()
    for x in xs:
        whole = whole & x.isNotNull()
    # At most a handful of sums a group.
    sums = rows.where(whole).groupBy(*keys).agg(F.array(*gram(y, xs)).alias("_g"))
    return sums.select(*keys, _fitted("_g").alias(name))


def engle_granger(series: DataFrame, keys: list[str], lags: int = 1, last: int = 252, least: int = 100) -> DataFrame:
    """(keys, n, correlation, hedge, half_life, statistic, p_value, valid) of pairs of price series (keys, ts, a, b).

    Of the last ``last`` rows of a pair in which both prices are there and
    positive: the level regression a = c + hedge b, the augmented Dickey-Fuller
    statistic of its residuals with ``lags`` lagged differences, its p-value, and
    the half-life of ln a - hedge ln b from its regression on its lag (null where
    it doesn't revert). A constant series has no hedge and no test. A pair is valid with p below 0.15, a half-life of 3 to 60
    rows and a correlation above 0.7; pairs of fewer than ``least`` rows are left out.
    """
    w, whole = Window.partitionBy(*keys).orderBy("ts"), Window.partitionBy(*keys)
    rows = series.where("a > 0 and b > 0").withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts")))).where(F.col("_back") <= last)
    rows = rows.withColumns({"_n": F.count("*").over(whole), "_hedge": F.regr_slope("a", "b").over(whole), "_c": F.regr_intercept("a", "b").over(whole), "_rho": F.covar_pop("a", "b").over(whole) / F.nullif(F.stddev_pop("a").over(whole) * F.stddev_pop("b").over(whole), F.lit(0.0))}).where(F.col("_n") >= least)
    rows = rows.withColumns({"_u": F.col("a") - F.col("_c") - F.col("_hedge") * F.col("b"), "_s": F.log("a") - F.col("_hedge") * F.log("b")})
    rows = rows.withColumns({"_u1": F.lag("_u").over(w), "_s1": F.lag("_s").over(w)}).withColumn("_du", F.col("_u") - F.col("_u1"))
    lagged = {f"_du{k}": F.lag("_du", k).over(w) for k in range(1, lags + 1)}
    rows = rows.withColumns(lagged) if lagged else rows
    told = rows.groupBy(*keys).agg(F.first("_n").alias("n"), F.first("_rho").alias("correlation"), F.first("_hedge").alias("hedge"), F.regr_slope(F.col("_s") - F.col("_s1"), F.col("_s1")).alias("_slope"))
    test = least_squares(rows, keys, F.col("_du"), [F.col("_u1"), *(F.col(c) for c in lagged)])
    out = told.join(test, keys, "left").withColumns({"half_life": F.when(F.col("_slope") < 0, -F.log(F.lit(2.0)) / F.col("_slope")), "statistic": F.nullif(F.col("fit")[1], F.lit(float("nan")))})
    out = out.withColumn("p_value", cointegration_p(F.col("statistic")))
    valid = (F.col("p_value") < 0.15) & F.col("half_life").between(3, 60) & (F.col("correlation") > 0.7)
    return out.select(*keys, "n", "correlation", "hedge", "half_life", "statistic", "p_value", F.coalesce(valid, F.lit(False)).alias("valid"))
