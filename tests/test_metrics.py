"""Cointegration and equity metrics against plain numpy."""

import math
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.behavior import FEATURES, behavior
from tidemark.operators.cointegration import cointegration_p, engle_granger, least_squares
from tidemark.operators.metrics import composite_fitness, equity_metrics
from tidemark.operators.robust import draws, monte_carlo
from tidemark.plans import portfolio
from tidemark.plans.registry import ORACLE


@pytest.mark.parametrize("lags", [0, 1, 3])
def test_pairs_equal_numpy_and_planted_ones_are_found(spark, lags):
    rng, frames = np.random.default_rng(5), []
    for pair in range(8):
        b = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))
        noise = np.zeros(300)
        for k in range(1, 300):
            noise[k] = 0.85 * noise[k - 1] + rng.normal(0, 1.5)
        a = 5 + 1.2 * b + noise if pair < 4 else 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))
        frames.append(pd.DataFrame({"pair": pair, "ts": range(300), "a": a, "b": b}))
    frames.append(pd.DataFrame({"pair": 8, "ts": range(99), "a": 1.0 + np.arange(99), "b": 2.0}))
    frames.append(pd.DataFrame({"pair": 9, "ts": range(120), "a": 3.0 + 2 * np.arange(120), "b": 1.0 + np.arange(120)}))
    got = {r["pair"]: r for r in engle_granger(spark.createDataFrame(pd.concat(frames)), ["pair"], lags).collect()}
    assert sorted(got) == [*range(8), 9], "too short a pair is left out"
    for pair, f in enumerate(frames[:8]):
        a, b = f["a"].to_numpy()[-252:], f["b"].to_numpy()[-252:]
        (c, h), *_ = np.linalg.lstsq(np.column_stack([np.ones(252), b]), a, rcond=None)
        u = a - c - h * b
        du = np.diff(u)
        y, x = du[lags:], np.column_stack([u[lags:-1], *(du[lags - k : len(du) - k] for k in range(1, lags + 1))])
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        error = np.sqrt(((y - x @ beta) ** 2).sum() / (len(y) - lags - 1) * np.linalg.inv(x.T @ x)[0, 0])
        s = np.log(a) - h * np.log(b)
        slope = np.polyfit(s[:-1], np.diff(s), 1)[0]
        r = got[pair]
        assert r["statistic"] == pytest.approx(beta[0] / error, rel=1e-6) and r["hedge"] == pytest.approx(h, rel=1e-9)
        assert r["half_life"] == (pytest.approx(-math.log(2) / slope, rel=1e-6) if slope < 0 else None)
    assert sum(got[p]["p_value"] < 0.15 for p in range(4)) == 4 and sum(got[p]["valid"] for p in range(4, 8)) <= 1
    assert got[9]["statistic"] is None or got[9]["valid"] is False, "residuals of nothing have no test"


def test_p_values_at_the_critical_values(spark):
    """The tables' asymptotic 1, 5 and 10 % points for two series with a constant."""
    rows = spark.createDataFrame([(-3.90,), (-3.34,), (-3.04,), (-25.0,), (2.0,), (None,)], "t double").select(cointegration_p(F.col("t"))).collect()
    got = [r[0] for r in rows]
    assert got[:3] == pytest.approx([0.01, 0.05, 0.10], abs=2e-3) and got[3:] == [0.0, 1.0, None]


def test_least_squares_leaves_out_nulls_and_says_when_there_is_no_fit(spark):
    rows = [("a", 2.0 * k + 3.0 * (k % 3), float(k), float(k % 3)) for k in range(1, 9)] + [("a", None, 1.0, 1.0), ("b", 1.0, 1.0, 1.0), ("c", 1.0, 2.0, 4.0), ("c", 2.0, 1.0, 2.0), ("c", 3.0, 5.0, 10.0)]
    got = {r["g"]: r["fit"] for r in least_squares(spark.createDataFrame(rows, "g string, y double, p double, q double"), ["g"], F.col("y"), [F.col("p"), F.col("q")]).collect()}
    assert got["a"][0] == pytest.approx(2) and got["a"][2] == pytest.approx(3) and got["b"] is None and got["c"] is None


def test_equity_metrics_equal_pandas(spark):
    rng = np.random.default_rng(1)
    rows = [(s, k, float(r)) for s in range(4) for k, r in enumerate(rng.normal(0.01 * (s - 1), 0.05, 19 if s == 3 else 60))] + [(9, k, 0.01) for k in range(40)] + [(0, 99, None)]
    got = {r["symbol"]: r for r in equity_metrics(spark.createDataFrame(rows, "symbol int, ts int, ret double"), 12).withColumn("fitness", composite_fitness()).collect()}
    for s in (0, 1, 2, 3):
        r = pd.Series([x for t, _, x in rows if t == s and x is not None])
        equity = (1 + r).cumprod()
        fall, total = (equity / equity.cummax() - 1).min(), equity.iloc[-1] - 1
        assert got[s]["drawdown"] == pytest.approx(fall) and got[s]["total"] == pytest.approx(total)
        want = 0.0 if len(r) < 20 else max(-5, min(10, ((1 + total) ** (12 / len(r)) - 1) / -fall))
        assert got[s]["calmar"] == pytest.approx(want) and got[s]["sharpe"] == pytest.approx(r.mean() / r.std() * 12**0.5)
        assert got[s]["sortino"] == pytest.approx(r.mean() / np.sqrt((r.clip(upper=0) ** 2).mean()) * 12**0.5)
    assert got[9]["calmar"] == 0.0 and got[9]["sortino"] is None, "no drawdown, no loss"


def test_monte_carlo_equals_plain_paths(spark):
    rng = np.random.default_rng(2)
    series = {7: rng.normal(0.002, 0.02, 90), 8: rng.normal(-0.001, 0.05, 30), 9: np.full(5, 0.01)}
    rows = [(s, k, float(x)) for s, xs in series.items() for k, x in enumerate(xs)] + [(7, 500, None), (10, 1, 0.5)]
    df = spark.createDataFrame(rows, "symbol int, ts int, ret double")
    got = {r["symbol"]: r for r in monte_carlo(df, 400, seed=3, block=64).collect()}
    assert sorted(got) == [7, 8, 9] and got[9]["sharpe_median"] == 0.0 and got[9]["gain_low"] == pytest.approx(100 * (1.01**5 - 1))
    for s in (7, 8):
        paths = series[s][draws(3, s, np.arange(400), len(series[s]))]
        equity = np.column_stack([np.ones(400), np.cumprod(1 + paths, axis=1)])
        figures = {"sharpe": paths.mean(axis=1) / paths.std(axis=1, ddof=1) * 252**0.5, "gain": 100 * (equity[:, -1] - 1), "fall": 100 * (1 - equity / np.maximum.accumulate(equity, axis=1)).max(axis=1)}
        for name, x in figures.items():
            for at, q in (("low", 0.025), ("median", 0.5), ("high", 0.975)):
                near = np.sort(x)[[max(0, math.ceil(q * 400) - 2), min(399, math.ceil(q * 400))]]
                assert near[0] - 1e-9 <= got[s][f"{name}_{at}"] <= near[1] + 1e-9
        assert got[s]["p_gain"] == pytest.approx((figures["gain"] > 0).mean()) and got[s]["p_drawdown_20"] == pytest.approx((figures["fall"] < 20).mean())
    assert monte_carlo(df, 400, seed=3, block=7).where("symbol = 7").first() == got[7], "runs don't depend on their blocks"


def test_draws_are_uniform_and_apart():
    at = draws(1, 5, np.arange(2000), 50)
    counts = np.bincount(at.ravel(), minlength=50)
    assert ((counts - 2000) ** 2 / 2000).sum() < 100, "chi-square of 49 degrees"
    assert abs(np.corrcoef(at[:-1].ravel(), at[1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(at[:, :-1].ravel(), at[:, 1:].ravel())[0, 1]) < 0.01
    assert (draws(1, 5, np.array([1234]), 50)[0] == at[1234]).all() and (draws(2, 5, np.arange(3), 50) != at[:3]).any()


def plain_behavior(trades, bench, capital):
    days = sorted({x.date() for _, _, _, x, _ in trades})
    equity, total = [], capital
    for d in days:
        total += sum(p for *_, x, p in trades if x.date() == d)
        equity.append(total)
    e = pd.Series(equity)
    ret, fall = e.pct_change(), (e - e.cummax()) / e.cummax()
    low = int(fall.idxmin())
    back = next((k for k in range(low, len(e)) if fall[k] >= -0.001), None)
    won, lost = sum(p for *_, p in trades if p > 0), -sum(p for *_, p in trades if p < 0)
    aligned = pd.DataFrame({"r": ret, "b": [bench.get(d) for d in days]}).astype(float).dropna()
    known = ret.dropna()
    fine = lambda x: 0.0 if x is None or np.isnan(x) else x
    return [
        len(trades) / max(len(e) / 5, 1), np.mean([max((x.date() - n.date()).days, 0) for _, _, n, x, _ in trades]), sum(1 if s == "buy" else -1 for _, s, *_ in trades) / len(trades), fine(known.autocorr(1)) if len(known) > 1 else 0.0, min(-fall.min(), 1),
        fine(aligned["r"].corr(aligned["b"])) if len(aligned) > 10 else 0.0, fine(known.std()) if len(known) > 1 else 0.0, 0.0 if fall.min() == 0 else back - low if back is not None else len(e) - low,
        max(0.1, min(5, won / lost)) if lost > 0 else 3.0 if won > 0 else 1.0, max(-2, min(5, known.mean() / known.std() * 252**0.5)) if len(known) > 20 and known.std() > 1e-10 else 0.0,
    ]


def test_behavior_equals_pandas(spark):
    rng, start = np.random.default_rng(9), datetime(2024, 1, 1)
    trades = []
    for s in range(5):
        for _ in range([200, 40, 3, 60, 1][s]):
            exit_ts = start + timedelta(days=int(rng.integers(0, 60)), hours=int(rng.integers(0, 20)))
            pnl = float(rng.integers(-900, 1000)) if s != 3 else float(rng.integers(1, 50))
            trades.append((s, "buy" if rng.random() < 0.7 else "sell", exit_ts - timedelta(hours=int(rng.integers(-30, 200))), exit_ts, pnl))
    bench = {(start + timedelta(days=k)).date(): float(x) for k, x in enumerate(rng.normal(0, 0.01, 50))}
    df = spark.createDataFrame([*trades, (None, "buy", start, start, 1.0), (0, "buy", start, None, 1.0)], "strategy long, side string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, pnl double")
    got = {r["strategy"]: [r[c] for c in FEATURES] for r in behavior(df, spark.createDataFrame(list(bench.items()), "day date, bench double"), 10_000.0).collect()}
    assert sorted(got) == list(range(5))
    for s in range(5):
        assert got[s] == pytest.approx(plain_behavior([t for t in trades if t[0] == s], bench, 10_000.0), abs=1e-9), s


def test_adjusted_weights_take_daily_results(spark, tmp_path):
    """Two of three strategies move together day by day; two years say nothing of it. Days are missing."""
    rng, rows = np.random.default_rng(7), []
    for d in range(400):
        shared = rng.normal()
        for k, name in enumerate("ABC"):
            if rng.random() < (0.6 if 150 < d < 190 and k == 2 else 0.03):
                continue
            tax = round(0.5 + 0.1 * (shared + 0.2 * rng.normal() if k < 2 else rng.normal()), 4)
            rows.append((len(rows), name, datetime(1995, 6, 1) + timedelta(days=d), tax))
    t = pd.DataFrame(rows, columns=["id", "strategy", "day", "tax"])
    day = t["day"].astype("datetime64[us]")
    pd.DataFrame({"l_orderkey": t["id"], "l_suppkey": 1, "l_shipdate": day, "l_linestatus": "O", "l_returnflag": "A", "l_quantity": 1.0, "l_extendedprice": 1000.0, "l_tax": t["tax"], "l_discount": 0.5}).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"o_orderkey": t["id"], "o_orderpriority": t["strategy"], "o_orderdate": day}).to_parquet(tmp_path / "orders.parquet")
    daily = t.assign(pnl=(1000 * (t["tax"] - 0.5)).round(2)).pivot(index="day", columns="strategy", values="pnl").ffill(limit=5).dropna()
    rho = daily.corr().abs()
    mean = (rho.sum() - 1) / 2
    weight = 1 - 0.5 * ((mean - 0.3) / 0.7).clip(lower=0)
    weight /= weight.sum()
    assert (mean[["A", "B"]] > 0.3).all() and mean["C"] < 0.3
    got = {r["strategy"]: r for r in portfolio.port_adjusted_weights(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for name in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    told = {r[0]: r for r in con.execute(ORACLE["port_adjusted_weights"]).fetchall()}
    for s in "ABC":
        for row in (got[s], told[s]):
            assert row[1] == pytest.approx(mean[s], abs=2e-6) and row[2] == pytest.approx(weight[s], abs=2e-6)
