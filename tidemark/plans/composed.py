"""Market queries built from the operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import crosses_above, majority_positive, normal_cdf, normal_ppf, rising
from tidemark.operators.joins import asof_join
from tidemark.operators.names import name_distances
from tidemark.operators.neighbours import novelty
from tidemark.operators.recursive import directional_index, moving_averages, wilder_indicators
from tidemark.operators.robust import bootstrap, cross_validation
from tidemark.operators.simulate import breakout_trades, portfolio_runs
from tidemark.plans.market import POP, SQL
from tidemark.plans.views import rounded, with_views
from tidemark.sources import TABLES, table
from tidemark.streaming import run_to_end, sessions, tumbling_bars


def view(spark: SparkSession, sf_dir: str, body: str, *names: str) -> DataFrame:
    text = rounded(with_views(body, *names))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})


def cut(x, k: int):  # noqa: ANN001, ANN201
    """x to k places, as the portable SQL rounds."""
    return F.floor(x * 10.0**k + 0.5) / 10.0**k


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "SELECT * FROM bars", "bars")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "SELECT * FROM rets", "rets")


def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order, at a minute of the events' month, with the last event of its customer's user number at or before it."""
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.floor(F.col("o_custkey") / 10).alias("user_id"), F.timestamp_add("MINUTE", F.col("o_orderkey") * 37 % 44640, F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"))
    right = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return asof_join(left, right, ["user_id"], "ts", ["event_id", "value"]).select("o_orderkey", "user_id", "event_id", "value")


def join_asof_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trade with the close and average range of its symbol's last bar at or before its entry; its SQL carries them in one window a symbol."""
    w = Window.partitionBy("symbol").orderBy("ts")
    before, last = F.lag("close").over(w), w.rowsBetween(-13, 0)
    rows = bars(spark, sf_dir).withColumn("tr", F.coalesce(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)), F.col("high") - F.col("low")))
    rows = rows.select("symbol", "ts", "close", F.when(F.count("tr").over(last) == 14, F.avg("tr").over(last)).alias("atr"))
    entries = view(spark, sf_dir, "SELECT trade_id, symbol, entry_ts AS ts FROM trades", "trades")
    return asof_join(entries, rows, ["symbol"], "ts", ["close", "atr"]).withColumn("atr", cut(F.coalesce("atr", 0.02 * F.col("close")), 4))


def ind_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moving_averages(bars(spark, sf_dir)).select("symbol", "ts", *[cut(F.col(c), 3).alias(c) for c in ("ema_12", "ema_26", "macd", "macd_signal", "macd_hist")])


def ind_adx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directional_index(bars(spark, sf_dir)).select("symbol", "ts", *[cut(F.col(c), 3).alias(c) for c in ("plus_di", "minus_di", "adx")])


def ind_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moving_averages(bars(spark, sf_dir)).select("symbol", "ts", *[cut(F.col(c), 3).alias(c) for c in ("ema_9", "ema_12", "ema_26", "ema_50")])


def ind_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wilder_indicators(bars(spark, sf_dir)).select("symbol", "ts", *[cut(F.col(c), 3).alias(c) for c in ("rsi", "atr", "bb_middle", "bb_upper", "bb_lower")])


def ind_macd_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes and the MACD line over five rows against the five before: lower lows with higher MACD lows, and the mirror."""
    w = Window.partitionBy("symbol").orderBy("ts")
    five = w.rowsBetween(-4, 0)
    rows = moving_averages(bars(spark, sf_dir)).withColumn("macd", cut(F.col("macd"), 6))
    rows = rows.withColumns({"full": F.count("close").over(five) == 5, "low": F.min("close").over(five), "high": F.max("close").over(five), "mlow": F.min("macd").over(five), "mhigh": F.max("macd").over(five)})
    before = {f"{c}5": F.lag(F.when(F.col("full"), F.col(c)), 5).over(w) for c in ("low", "high", "mlow", "mhigh")}
    rows = rows.withColumns(before)
    told = lambda a, b: F.coalesce(F.col("full") & a & b, F.lit(False))
    return rows.select("symbol", "ts", told(F.col("low") < F.col("low5"), F.col("mlow") > F.col("mlow5")).alias("bullish"), told(F.col("high") > F.col("high5"), F.col("mhigh") < F.col("mhigh5")).alias("bearish"))


def _crossings(rows: DataFrame, gap) -> DataFrame:  # noqa: ANN001
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = rows.withColumn("gap", cut(gap, 6)).withColumn("before", F.lag("gap").over(w))
    up, down = (F.col("before") <= 0) & (F.col("gap") > 0), (F.col("before") >= 0) & (F.col("gap") < 0)
    return rows.where(up | down).withColumn("side", F.when(up, "BUY").otherwise("CLOSE"))


def strat_ema_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crossings(moving_averages(bars(spark, sf_dir)), F.col("ema_9") - F.col("ema_30")).select("symbol", "ts", "side", (F.col("close") * 0.95).alias("stop"), (F.col("close") * 1.10).alias("target"))


def strat_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength = F.least(F.lit(0.8), 0.5 + F.abs("macd_hist") / F.col("close") * 10)
    return _crossings(moving_averages(bars(spark, sf_dir)), F.col("macd_hist")).select("symbol", "ts", "side", cut(strength, 6).alias("strength"))


def join_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each symbol is from its five nearest by mean return, its calm and its volume."""
    near = novelty(view(spark, sf_dir, f"+ {POP} SELECT symbol, gain, calm, liquid FROM pop", "rets"), {"gain": 1e3, "calm": 10.0, "liquid": 1.0}, 5)
    return near.withColumn("novelty", cut(F.col("novelty"), 4))


def win_rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio, z-score, sums and the correlation of close and volume over a symbol's last rows.

    The correlation comes from its parts: Spark's own fails on windows of equal values, also on those that aren't full yet. Over a full one it is NaN.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    rolled = lambda x, c, n: F.when(F.count(c).over(w.rowsBetween(1 - n, 0)) == n, x.over(w.rowsBetween(1 - n, 0)))
    none = lambda x: F.nullif(x, F.lit(0))
    rows = returns(spark, sf_dir).withColumns({
        "sharpe": rolled(F.avg("ret"), "ret", 60) / none(rolled(F.stddev_samp("ret"), "ret", 60)) * F.sqrt(F.lit(252)), "z": (F.col("close") - rolled(F.avg("close"), "close", 60)) / none(rolled(F.stddev_samp("close"), "close", 60)),
        "sum": rolled(F.sum("ret"), "ret", 20), "all": F.sum("ret").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "both": rolled(F.covar_pop("close", "volume"), "close", 20), "apart": rolled(F.stddev_pop("close"), "close", 20) * rolled(F.stddev_pop("volume"), "close", 20),
    })
    corr = F.when(F.col("apart") == 0, F.lit(float("nan"))).otherwise(cut(F.col("both") / none(F.col("apart")), 4))
    return rows.select("symbol", "ts", cut(F.col("sharpe"), 4).alias("sharpe_60"), cut(F.col("z"), 4).alias("z_60"), cut(F.col("sum"), 6).alias("ret_20"), cut(F.col("all"), 6).alias("cumulative"), corr.alias("corr_20"))


def fn_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-9, 0)
    rows = returns(spark, sf_dir).withColumns({"v": F.collect_list("close").over(w), "u": F.collect_list("volume").over(w), "r": F.collect_list("ret").over(w)})
    return rows.where(F.size("v") == 10).select("symbol", "ts", rising(F.col("u")).alias("rising"), majority_positive(F.col("r")).alias("mostly_up"), crosses_above(F.col("v"), F.reverse("v")).alias("crosses"), F.array_max("v").alias("top"))


def fn_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the name of each customer is from those of the suppliers of the same nation."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("key"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("key"))
    return name_distances(customers, suppliers).select(F.col("left").alias("c_name"), F.col("right").alias("s_name"), "distance")


def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.from_json("props", "k long")["k"]
    return events.select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"))).alias("again"))


def sim_breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakout_trades(bars(spark, sf_dir))


def sim_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three exits for the monthly momentum portfolio, each a run of its own."""
    first = view(spark, sf_dir, SQL_MONTH_FIRST, "bars")
    momentum = SQL["strat_momentum_v2"]
    picks = spark.sql(momentum, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in momentum})
    signals = picks.select("month", "symbol").join(first, ["month", "symbol"]).select("ts", "symbol")
    params = spark.createDataFrame([(1, 0.95, 1.10, 0.10), (2, 0.80, 1.50, 0.10), (3, 0.90, 1.20, 0.20)], "run_id long, stop double, target double, size double")
    return portfolio_runs(signals, bars(spark, sf_dir), params)


SQL_MONTH_FIRST = "SELECT CAST(date_trunc('month', ts) AS DATE) AS month, symbol, min(ts) AS ts FROM bars GROUP BY CAST(date_trunc('month', ts) AS DATE), symbol"


def rob_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cross-validated strategy is long while the close is above its mean of 20 rows, else flat."""
    mean = F.avg("close").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-19, 0))
    rows = returns(spark, sf_dir).withColumn("signal", (cut(F.col("close") - mean, 6) > 0).cast("int"))
    told = cross_validation(rows.select("symbol", "ts", "ret", "signal"))
    return told.select(*[cut(F.col(c), 4).alias(c) if c.startswith(("sharpe", "growth")) else c for c in told.columns])


def rob_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap(returns(spark, sf_dir))


def met_probabilistic_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a symbol's true Sharpe ratio is above zero (psr), and above what the best of all symbols has by chance (dsr)."""
    of = returns(spark, sf_dir).where("ret is not null").groupBy("symbol").agg((F.avg("ret") / F.stddev_samp("ret")).alias("sr"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"), F.count("*").alias("n")).where("n > 3")
    # One row: how many symbols were tried, and the deviation of their ratios.
    tried = of.agg(F.count("*").cast("double").alias("trials"), F.stddev_samp("sr").alias("spread"))
    gamma = 0.5772156649015329
    chance = F.col("spread") * ((1 - gamma) * normal_ppf(1 - 1 / F.col("trials")) + gamma * normal_ppf(1 - 1 / (F.col("trials") * F.exp(F.lit(1.0)))))
    z = lambda least: (F.col("sr") - least) * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(F.lit(1e-9), 1 - F.col("skew") * F.col("sr") + (F.col("kurt") + 2) / 4 * F.col("sr") ** 2))
    return of.crossJoin(F.broadcast(tried)).select("symbol", "n", cut(F.col("sr"), 6).alias("sr"), cut(normal_cdf(z(F.lit(0.0))), 5).alias("psr"), cut(normal_cdf(z(chance)), 5).alias("dsr"))


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(spark, sf_dir, "events.parquet", tumbling_bars).withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(spark, sf_dir, "events.parquet", sessions).withColumn("start", F.col("start").cast("timestamp_ntz"))


QUERIES = {f.__name__: f for f in (join_asof, join_asof_atr, ind_macd, ind_adx, ind_ema, ind_wilder, ind_macd_divergence, strat_ema_cross, strat_macd, join_novelty, win_rolling_stats, fn_vectors, fn_trigrams, fn_json, sim_breakout, sim_portfolio, rob_cross_validation, rob_bootstrap, met_probabilistic_sharpe, stream_bars, stream_sessions)}
_EMA = """WITH RECURSIVE """ + with_views("""+ s AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars),
e AS (SELECT symbol, ts, rn, close, close AS e9, close AS e12, close AS e26, close AS e30, 0e0 AS sig FROM s WHERE rn = 1
  UNION ALL SELECT s.symbol, s.ts, s.rn, s.close, 0.2e0 * s.close + 0.8e0 * e9, (2 * s.close + 11 * e12) / 13, (2 * s.close + 25 * e26) / 27, (2 * s.close + 29 * e30) / 31,
    0.2e0 * ((2 * s.close + 11 * e12) / 13 - (2 * s.close + 25 * e26) / 27) + 0.8e0 * sig FROM e JOIN s ON s.symbol = e.symbol AND s.rn = e.rn + 1)
""", "bars").removeprefix("WITH ")
_CROSSED = """, c AS (SELECT symbol, ts, close, {gap} AS gap, sig, e12 - e26 - sig AS hist FROM e), d AS (SELECT *, lag(round(gap, 6)) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM c)
SELECT symbol, ts, CASE WHEN gap > 0 THEN 'BUY' ELSE 'CLOSE' END AS side, {more} FROM d WHERE before <= 0 AND round(gap, 6) > 0 OR before >= 0 AND round(gap, 6) < 0"""
_CHAIN = """WITH RECURSIVE """ + with_views("""+ s AS (SELECT symbol, ts, high, low, close, lag(close) OVER w AS pc, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down, row_number() OVER w AS rn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
m AS MATERIALIZED (SELECT symbol, ts, rn, close, coalesce(greatest(high - low, abs(high - pc), abs(low - pc)), high - low) AS tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0e0 END AS plus, CASE WHEN down > up AND down > 0 THEN down ELSE 0e0 END AS minus,
  CASE WHEN close > pc THEN close - pc ELSE 0e0 END AS gain, CASE WHEN close < pc THEN pc - close ELSE 0e0 END AS loss FROM s)
""", "bars").removeprefix("WITH ")
_PDF = "(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()))"


def _cdf(x: str) -> str:
    t = f"(1 / (1 + 0.2316419e0 * abs({x})))"
    tail = f"{_PDF.format(x=x)} * {t} * (0.319381530e0 + {t} * (-0.356563782e0 + {t} * (1.781477937e0 + {t} * (-1.821255978e0 + {t} * 1.330274429e0))))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


#: The quantile by bisection, apart from how the query has it.
_QUANTILE = """q AS (SELECT 0 AS k, p, -9e0 AS lo, 9e0 AS hi FROM targets UNION ALL SELECT k + 1, p, CASE WHEN {cdf} < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {cdf} < p THEN hi ELSE (lo + hi) / 2 END FROM q WHERE k < 60)""".format(cdf=_cdf("((lo + hi) / 2)"))
ORACLE = {
    "join_asof": "SELECT o_orderkey, o_custkey // 10 AS user_id, event_id, value FROM (SELECT *, o_custkey // 10 AS u, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (o_orderkey * 37 % 44640) AS tm FROM {orders}) o ASOF LEFT JOIN {events} e ON o.u = e.user_id AND o.tm >= e.ts",
    "ind_macd": _EMA + "SELECT symbol, ts, round(e12, 3) AS ema_12, round(e26, 3) AS ema_26, round(e12 - e26, 3) AS macd, round(sig, 3) AS macd_signal, round(e12 - e26 - sig, 3) AS macd_hist FROM e",
    "strat_ema_cross": _EMA + _CROSSED.format(gap="e9 - e30", more="close * 0.95e0 AS stop, close * 1.10e0 AS target"),
    "strat_macd": _EMA + _CROSSED.format(gap="e12 - e26 - sig", more="round(least(0.8e0, 0.5e0 + abs(hist) / close * 10), 6) AS strength"),
    "ind_ema": _EMA.replace("close AS e30", "close AS e30, close AS e50").replace("(2 * s.close + 29 * e30) / 31,", "(2 * s.close + 29 * e30) / 31, (2 * s.close + 49 * e50) / 51,") + "SELECT symbol, ts, round(e9, 3) AS ema_9, round(e12, 3) AS ema_12, round(e26, 3) AS ema_26, round(e50, 3) AS ema_50 FROM e",
    "ind_macd_divergence": _EMA + """, m AS (SELECT symbol, ts, rn, close, round(e12 - e26, 6) AS macd FROM e), l AS MATERIALIZED (SELECT *, min(close) OVER w AS low, max(close) OVER w AS high, min(macd) OVER w AS mlow, max(macd) OVER w AS mhigh FROM m WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING))
SELECT a.symbol, a.ts, coalesce(a.low < b.low AND a.mlow > b.mlow, false) AS bullish, coalesce(a.high > b.high AND a.mhigh < b.mhigh, false) AS bearish FROM l a LEFT JOIN l b ON b.symbol = a.symbol AND b.rn = a.rn - 5 AND b.rn >= 5""",
    "ind_adx": _CHAIN + """, e AS (SELECT symbol, ts, rn, tr AS atr, plus AS p, minus AS m FROM m WHERE rn = 1 UNION ALL SELECT m.symbol, m.ts, m.rn, (2 * m.tr + 13 * e.atr) / 15, (2 * m.plus + 13 * e.p) / 15, (2 * m.minus + 13 * e.m) / 15 FROM e JOIN m ON m.symbol = e.symbol AND m.rn = e.rn + 1),
d AS MATERIALIZED (SELECT symbol, ts, rn, 100 * p / nullif(atr, 0) AS plus_di, 100 * m / nullif(atr, 0) AS minus_di, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM e),
f AS (SELECT symbol, min(rn) AS start FROM d WHERE dx IS NOT NULL GROUP BY symbol),
a AS (SELECT d.symbol, rn, dx AS adx FROM d JOIN f ON d.symbol = f.symbol AND rn = start UNION ALL SELECT d.symbol, d.rn, (2 * d.dx + 13 * a.adx) / 15 FROM a JOIN d ON d.symbol = a.symbol AND d.rn = a.rn + 1)
SELECT d.symbol, d.ts, round(plus_di, 3) AS plus_di, round(minus_di, 3) AS minus_di, round(adx, 3) AS adx FROM d LEFT JOIN a ON a.symbol = d.symbol AND a.rn = d.rn""",
    "ind_wilder": _CHAIN + """, e AS (SELECT symbol, ts, rn, tr AS atr, gain AS g, loss AS l FROM m WHERE rn = 1 UNION ALL SELECT m.symbol, m.ts, m.rn, (m.tr + 13 * e.atr) / 14, (m.gain + 13 * e.g) / 14, (m.loss + 13 * e.l) / 14 FROM e JOIN m ON m.symbol = e.symbol AND m.rn = e.rn + 1),
b AS (SELECT symbol, ts, CASE WHEN rn >= 20 THEN avg(close) OVER w END AS mid, CASE WHEN rn >= 20 THEN stddev_pop(close) OVER w END AS sd FROM m WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))
SELECT e.symbol, e.ts, round(CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) END, 3) AS rsi, round(atr, 3) AS atr, round(mid, 3) AS bb_middle, round(mid + 2 * sd, 3) AS bb_upper, round(mid - 2 * sd, 3) AS bb_lower FROM e JOIN b ON b.symbol = e.symbol AND b.ts = e.ts""",
    "met_probabilistic_sharpe": "WITH RECURSIVE " + with_views(f"""+ a AS (SELECT symbol, count(*) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd FROM rets WHERE ret IS NOT NULL GROUP BY symbol HAVING count(*) > 3),
c AS (SELECT a.symbol, n, mu / sd AS sr, avg(pow(ret - mu, 3)) / pow(avg(pow(ret - mu, 2)), 1.5) AS skew, avg(pow(ret - mu, 4)) / pow(avg(pow(ret - mu, 2)), 2) - 3 AS kurt FROM rets r JOIN a ON r.symbol = a.symbol WHERE ret IS NOT NULL GROUP BY a.symbol, n, mu, sd),
t AS MATERIALIZED (SELECT count(*) AS trials, stddev_samp(sr) AS spread FROM c), targets AS MATERIALIZED (SELECT 1 - 1e0 / trials AS p FROM t UNION SELECT 1 - 1e0 / (trials * exp(1)) FROM t), {_QUANTILE},
b AS (SELECT max(spread) * (0.4227843350984671e0 * min(lo) + 0.5772156649015329e0 * max(lo)) AS chance FROM q CROSS JOIN t WHERE k = 60),
z AS (SELECT symbol, n, sr, sr * sqrt(n - 1) / sqrt(greatest(1e-9, 1 - skew * sr + (kurt + 2) / 4 * sr * sr)) AS z0, (sr - chance) * sqrt(n - 1) / sqrt(greatest(1e-9, 1 - skew * sr + (kurt + 2) / 4 * sr * sr)) AS z1 FROM c CROSS JOIN b)
SELECT symbol, n, round(sr, 6) AS sr, round({_cdf("z0")}, 5) AS psr, round({_cdf("z1")}, 5) AS dsr FROM z""", "rets").removeprefix("WITH "),
    "fn_vectors": with_views("""+ w AS (SELECT symbol, ts, list(close) OVER x AS v, list(volume) OVER x AS u, list(ret) OVER x AS r FROM rets WINDOW x AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT symbol, ts, list_sum(u[6:10]) > list_sum(u[1:5]) AS rising, len(list_filter(r, lambda q: q > 0)) * 2 > len(list_filter(r, lambda q: q IS NOT NULL)) AS mostly_up, v[9] < v[2] AND v[10] >= v[1] AS crosses, list_max(v) AS top FROM w WHERE len(v) = 10""", "rets"),
    "fn_trigrams": """WITH p AS (SELECT c_name AS p, s_name AS q FROM {customer} JOIN {supplier} ON c_nationkey = s_nationkey), g AS (SELECT *, list_distinct([substr(p, i, 3) for i in range(1, greatest(length(p) - 1, 2))]) AS a, list_distinct([substr(q, i, 3) for i in range(1, greatest(length(q) - 1, 2))]) AS b FROM p)
SELECT p AS c_name, q AS s_name, round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS distance FROM g""",
    "fn_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{{\"k\":' || json_extract_string(props, '$.k') || '}}' AS again FROM {events}",
    "rob_cross_validation": with_views("""+ g AS (SELECT symbol, ts, ret, CASE WHEN round(close - avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), 6) > 0 THEN 1 ELSE 0 END AS sig FROM rets),
i AS (SELECT symbol, ret, sig, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM g WHERE ret IS NOT NULL),
b AS (SELECT *, n // 16 AS size, least(i // (n // 16), 15) AS own FROM i WHERE n // 16 > 5),
m AS (SELECT m, row_number() OVER (ORDER BY (m * 40503) % 65536, m) AS split FROM range(1, 65536) t(m) WHERE bit_count(m) <= 4),
h AS MATERIALIZED (SELECT split, m, min(k) AS lo, max(k) AS hi FROM m JOIN range(16) r(k) ON (m >> k) & 1 = 1 WHERE split <= 1000 GROUP BY split, m),
c AS (SELECT symbol, split, i, n, ret, sig, lo, (m >> own) & 1 = 1 AS test, lo * size AS a, CASE WHEN hi = 15 THEN n - 1 ELSE (hi + 1) * size - 1 END AS z FROM b CROSS JOIN h),
r AS (SELECT * FROM c WHERE CASE WHEN test THEN lo = 0 OR i > a - 6 + floor(n * 0.01e0) ELSE NOT (i BETWEEN a - 5 AND a OR i BETWEEN z AND z + 5) END),
w AS (SELECT symbol, split, test, ret * coalesce(lag(sig) OVER v, 0) AS x, coalesce(sig <> lag(sig) OVER v, false) AS moved FROM r WINDOW v AS (PARTITION BY symbol, split, test ORDER BY i))
SELECT symbol, split, count(CASE WHEN NOT test THEN 1 END) AS n_train, round(CASE WHEN count(CASE WHEN NOT test THEN 1 END) < 20 OR coalesce(var_samp(CASE WHEN NOT test THEN x END), 0) < 1e-15 THEN 0e0 ELSE sqrt(252) * avg(CASE WHEN NOT test THEN x END) / stddev_samp(CASE WHEN NOT test THEN x END) END, 4) AS sharpe_train,
  round(sum(CASE WHEN NOT test THEN ln(1 + x) END), 4) AS growth_train, count(CASE WHEN NOT test AND moved THEN 1 END) AS trades_train,
  count(CASE WHEN test THEN 1 END) AS n_test, round(CASE WHEN count(CASE WHEN test THEN 1 END) < 20 OR coalesce(var_samp(CASE WHEN test THEN x END), 0) < 1e-15 THEN 0e0 ELSE sqrt(252) * avg(CASE WHEN test THEN x END) / stddev_samp(CASE WHEN test THEN x END) END, 4) AS sharpe_test,
  round(sum(CASE WHEN test THEN ln(1 + x) END), 4) AS growth_test, count(CASE WHEN test AND moved THEN 1 END) AS trades_test FROM w GROUP BY symbol, split HAVING count(CASE WHEN NOT test THEN 1 END) >= 252 AND count(CASE WHEN test THEN 1 END) >= 63""", "rets"),
    "rob_walk_forward": with_views("""+ x AS MATERIALIZED (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM rets WHERE ret IS NOT NULL),
f AS (SELECT symbol, unnest(range(252, count(*) - 62, 21)) AS start FROM x GROUP BY symbol), w AS (SELECT f.symbol, start, avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe FROM f JOIN x ON x.symbol = f.symbol AND i BETWEEN start AND start + 62 GROUP BY f.symbol, start)
SELECT symbol, count(*) AS folds, round(avg(CASE WHEN sharpe > 0 THEN 1e0 ELSE 0e0 END), 6) AS efficiency, round(avg(sharpe), 5) AS mean_sharpe FROM w GROUP BY symbol""", "rets"),
    "stream_bars": "SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM {events} GROUP BY event_type, time_bucket(INTERVAL 1 HOUR, ts)",
    "stream_sessions": "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM {events}), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, max(value) AS best FROM i GROUP BY user_id, k",
}
ORACLE = {name: rounded(text).replace("{{", "{").replace("}}", "}") if name == "fn_json" else rounded(text) for name, text in ORACLE.items()}
