"""Pairs of nations' price indices and their cointegration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.cointegration import engle_granger
from tidemark.operators.pairs import co_movement, crossings, paired, qualified
from tidemark.plans.composed import _cdf, cut, view
from tidemark.plans.views import rounded, with_views
from tidemark.sources import table

#: Weekly indices of nations: the deviations of mean closes from their own mean, in parts. Every third nation walks by itself,
#: the others with their region and a mean-reverting part of their own, the mean of their last twelve deviations.
INDICES = """+ wk AS (SELECT n_nationkey AS nation, n_regionkey AS region, CAST(date_trunc('week', ts) AS DATE) AS ts, avg(close) AS px FROM bars JOIN {supplier} ON symbol = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey, CAST(date_trunc('week', ts) AS DATE)),
dv AS (SELECT nation, region, ts, px / avg(px) OVER (PARTITION BY nation) - 1 AS d FROM wk),
rg AS (SELECT region, ts, avg(d) AS d FROM dv GROUP BY region, ts), rw AS (SELECT region, ts, sum(d) OVER (PARTITION BY region ORDER BY ts) AS walk FROM rg),
ix AS (SELECT nation, dv.region, dv.ts, round(100 * exp(2e-1 * CASE WHEN nation % 3 = 0 THEN sum(d) OVER (PARTITION BY nation ORDER BY dv.ts) ELSE walk END + 3e-1 * avg(d) OVER (PARTITION BY nation ORDER BY dv.ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)), 6) AS price
  FROM dv JOIN rw ON dv.region = rw.region AND dv.ts = rw.ts)"""


def strat_cointegration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of nations of one region: hedge, half-life, Engle-Granger statistic with one lag and its p-value."""
    series = view(spark, sf_dir, INDICES + " SELECT x.nation AS first, y.nation AS second, x.ts, x.price AS a, y.price AS b FROM ix x JOIN ix y ON x.region = y.region AND x.ts = y.ts AND x.nation < y.nation", "bars")
    told = engle_granger(series, ["first", "second"], lags=1)
    return told.select("first", "second", "n", *(cut(F.col(c), 4).alias(c) for c in ("correlation", "hedge", "half_life", "statistic", "p_value")), "valid")


def _paired(spark: SparkSession, sf_dir: str, fold, columns: str) -> DataFrame:  # noqa: ANN001
    """Pairs of one industry that share 20 days at least."""
    sectors = view(spark, sf_dir, "SELECT symbol, industry FROM sectors", "sectors")
    # Dealt by symbol at once, bars and series need no further exchange.
    bars = spark.sql(with_views("SELECT symbol, ts, close FROM bars", "bars"), lineitem=table(spark, sf_dir, "lineitem").repartition("l_suppkey"))
    return paired(bars, sectors, fold, columns, 20)


def join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir, co_movement, "a long, b long, industry string, n long, correlation double, hedge double, spread double")


def strat_pairs_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir, qualified, "a long, b long, n long, correlation double, hedge double, p_value double, half_life double, valid boolean")


def strat_pairs_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir, crossings, "a long, b long, ts timestamp_ntz, z double, action string")


QUERIES = {f.__name__: f for f in (strat_cointegration, join_pairs, strat_pairs_qualified, strat_pairs_scan)}
_P = f"CASE WHEN t > 0.92 THEN 1 WHEN t < -18.86 THEN 0 WHEN t <= -2.62 THEN {_cdf('(2.92 + 1.5012 * t + 0.039796 * t * t)')} ELSE {_cdf('(2.1945 + 0.64695 * t - 0.29198 * t * t - 0.042377 * t * t * t)')} END"
ORACLE = {
    "strat_cointegration": rounded(with_views(INDICES + f""", p AS (SELECT x.nation AS f, y.nation AS s, x.ts, x.price AS a, y.price AS b, row_number() OVER (PARTITION BY x.nation, y.nation ORDER BY x.ts DESC) AS back FROM ix x JOIN ix y ON x.region = y.region AND x.ts = y.ts AND x.nation < y.nation),
k AS (SELECT f, s, count(*) AS n, corr(a, b) AS rho, covar_pop(a, b) / var_pop(b) AS h, avg(a) - covar_pop(a, b) / var_pop(b) * avg(b) AS c FROM p WHERE back <= 252 GROUP BY f, s HAVING count(*) >= 100),
u AS (SELECT p.f, p.s, ts, a - c - h * b AS u, ln(a) - h * ln(b) AS sp FROM p JOIN k ON p.f = k.f AND p.s = k.s WHERE back <= 252),
l AS (SELECT f, s, u - lag(u) OVER w AS y, lag(u) OVER w AS x1, lag(u) OVER w - lag(u, 2) OVER w AS x2, sp - lag(sp) OVER w AS ds, lag(sp) OVER w AS s1 FROM u WINDOW w AS (PARTITION BY f, s ORDER BY ts)),
g AS (SELECT f, s, count(*) AS n, sum(y * y) AS yy, sum(x1 * y) AS p1, sum(x2 * y) AS p2, sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS c FROM l WHERE x2 IS NOT NULL GROUP BY f, s),
e AS (SELECT *, (c * p1 - b * p2) / (a * c - b * b) AS b1, (a * p2 - b * p1) / (a * c - b * b) AS b2 FROM g),
t AS (SELECT f, s, b1 / sqrt((yy - b1 * p1 - b2 * p2) / (n - 2) * c / (a * c - b * b)) AS t FROM e),
v AS (SELECT f, s, covar_pop(ds, s1) / var_pop(s1) AS slope FROM l WHERE s1 IS NOT NULL GROUP BY f, s),
q AS (SELECT k.f, k.s, k.n, rho, h, CASE WHEN slope < 0 THEN -ln(2) / slope END AS hl, t, {_P} AS pv FROM k JOIN t ON k.f = t.f AND k.s = t.s JOIN v ON k.f = v.f AND k.s = v.s)
SELECT f AS first, s AS second, n, round(rho, 4) AS correlation, round(h, 4) AS hedge, round(hl, 4) AS half_life, round(t, 4) AS statistic, round(pv, 4) AS p_value, coalesce(pv < 0.15 AND hl BETWEEN 3 AND 60 AND rho > 0.7, false) AS valid FROM q""", "bars")),
}
