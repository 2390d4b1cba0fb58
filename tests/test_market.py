"""The market queries against DuckDB on the same SQL, and the folds against small brute force."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql.functions import col
from pyspark.sql.functions import round as spark_round

import __spark_entry__ as entry
from tidemark.functions import trigram_distance
from tidemark.operators import joins, names, neighbours, pairs
from tidemark.operators.joins import asof_join
from tidemark.operators.names import name_distances
from tidemark.operators.recursive import moving_averages
from tidemark.operators.robust import bootstrap
from tidemark.operators.simulate import breakout_trades, portfolio_runs
from tidemark.plans import registry
from tidemark.plans.views import rounded
from tidemark.sources import TABLES

DATA = "/root/testdata/sf0.001"
SLOW = {"sim_portfolio"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, duck, name):
    rows = registry.QUERIES[name](spark, DATA)
    columns = sorted(rows.columns)
    got = sorted((tuple(plain(v) for v in r) for r in rows.select(*columns).collect()), key=str)
    want = sorted((tuple(plain(v) for v in r) for r in duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE[name]}) q").fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE) - SLOW))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def _lineitem(spark, folder, rows):
    """Tables of which lineitem has (supplier, day, price, quantity) as given, one line an order."""
    lines = [(k, 1, symbol, 1, float(quantity), price * quantity, 0.0, 0.0, "N", "O", datetime(2024, 1, 1) + timedelta(days=day)) for k, (symbol, day, price, quantity) in enumerate(rows)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, columns).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'").fetchall()
    return con


def _equal_to_sql(spark, con, folder, name):
    """The query's rows, held against its SQL."""
    rows = registry.QUERIES[name](spark, str(folder))
    columns = sorted(rows.columns)
    got = sorted((tuple(plain(v) for v in r) for r in rows.select(*columns).collect()), key=str)
    assert got == sorted((tuple(plain(v) for v in r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE[name]}) q").fetchall()), key=str)
    return got


def test_rolling_stats_of_equal_volumes(spark, tmp_path):
    """Symbol 1 begins with two equal volumes, symbol 2 has a full window of them."""
    rng = random.Random(3)
    rows = [(1, k, 10.0 + rng.randrange(9), [7, 7, 9][min(k, 2)] + k % 4 * (k > 2)) for k in range(70)] + [(2, k, 10.0 + rng.randrange(9), 5 if k < 25 else 5 + k % 3) for k in range(40)]
    got = _equal_to_sql(spark, _lineitem(spark, tmp_path, rows), tmp_path, "win_rolling_stats")
    assert sum(r[0] == "nan" for r in got) == 6 and sum(r[0] is None for r in got) == 38


def _pair_tables(spark, folder, moved):
    """Eight symbols of one industry, one of another: walks, a copy of a walk, a constant one, one with few days."""
    rng, rows = random.Random(2), []
    for s in range(9):
        price = 10.0
        for d in range(90):
            price = 7.0 if s == 4 else max(1.0, price + rng.choice([-1.0, -0.5, 0.25, 0.5, 1.0]))
            if s != 3 and rng.random() < (0.2 if s == 6 else 0.85):
                rows.append((s, d, price, 1 + d % 5))
    # An equal copy has a spread of 0: its noise, in another engine, has a half-life.
    rows += [(3, d, price + moved * (d % 7), q) for s, d, price, q in rows if s == 1]
    con = _lineitem(spark, folder, rows)
    for name, data, columns in (("supplier", [(s, f"S{s}", 0 if s < 8 else 1, 0.0) for s in range(9)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"), ("nation", [(0, "A", 0), (1, "B", 0)], "n_nationkey int, n_name string, n_regionkey int"), ("region", [(0, "R")], "r_regionkey int, r_name string")):
        spark.createDataFrame(data, columns).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'").fetchall()
    return con


@pytest.mark.parametrize("name", ["join_pairs", "strat_pairs_qualified", "strat_pairs_scan"])
def test_pairs_over_blocks_equal_sql_and_join_no_bars(spark, tmp_path, monkeypatch, name):
    """Blocks of three symbols: pairs within and across them, equal series and one that doesn't vary; no row for a pair and day is shuffled."""
    monkeypatch.setattr(pairs, "BLOCK", 3)
    con = _pair_tables(spark, tmp_path, 0.0 if name == "join_pairs" else 0.25)
    got = _equal_to_sql(spark, con, tmp_path, name)
    assert len(got) > 15
    if name == "join_pairs":
        assert sum("nan" in r for r in got) >= 5 and len({r[:2] for r in got}) == len(got)
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max_by") <= 1 and "FlatMapGroupsInArrow" in plan


def test_novelty_over_blocks_equals_sql(spark, tmp_path, monkeypatch):
    """Blocks of a few symbols, equal points, and one of a single bar, which is near to none; no join of all pairs."""
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    rng = random.Random(5)
    rows = [(s, d, 10.0 + rng.randrange(20), 1 + rng.randrange(9)) for s in range(15) for d in range(12)] + [(20, 3, 10.0, 2)]
    rows += [(30 + k, d, price, q) for k in range(7) for s, d, price, q in rows if s == 1]
    con = _lineitem(spark, tmp_path, rows)
    got = _equal_to_sql(spark, con, tmp_path, "join_novelty")
    assert len(got) == 23 and sum(r[0] is None for r in got) == 1 and sum(r[0] == 0 for r in got) == 8
    assert "Join" not in registry.QUERIES["join_novelty"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_name_distances_over_blocks_equal_the_column(spark, monkeypatch):
    """Short, empty, null and repeated names, pairs across blocks; names aren't taken apart for each pair."""
    monkeypatch.setattr(names, "LEFT", 3)
    monkeypatch.setattr(names, "RIGHT", 2)
    some = ["", "a", "ab", "abc", "abcabc", "abcd", None, "Customer#1", "Customer#12", "Cüstomer", "abc"]
    left = spark.createDataFrame([(k, s, k % 2 if k != 3 else None) for k, s in enumerate(some * 2)], "id int, name string, key int")
    right = spark.createDataFrame([(k, s, k % 3) for k, s in enumerate(some)], "id int, name string, key int")
    got = name_distances(left, right)
    want = left.alias("l").join(right.alias("r"), "key").select("l.name", "r.name", spark_round(trigram_distance(col("l.name"), col("r.name")), 6))
    # The column takes two null names for equal; the SQL has no number for them.
    none = "left is null and right is null"
    assert sorted(map(tuple, got.where(f"not ({none})").collect()), key=str) == sorted(map(tuple, want.toDF("left", "right", "d").where(f"not ({none})").collect()), key=str)
    assert {str(r["distance"]) for r in got.where(none).collect()} == {"nan"} and want.count() > 60
    assert "array_intersect" not in registry.QUERIES["fn_trigrams"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_entry(spark):
    assert entry.entry(spark).columns == ["month", "symbol", "close", "momentum", "place", "weight", "stop", "target"]


def test_rounded_nests():
    assert duckdb.sql("SELECT " + rounded("round(round(1.26e0, 1) + 0.004e0, 2)")).fetchall()[0][0] == 1.3


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 2, 10.0), (1, 5, 11.0), (1, 6, 12.0)], "k int, t int, v double")
    got = {r["x"]: r["v"] for r in asof_join(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {"a": 11.0, "b": None, "c": None}


@pytest.mark.parametrize("bucket", [None, 1, 7, 10**6])
def test_asof_over_buckets_equals_a_plain_search(spark, bucket):
    rng = random.Random(6)
    left = [(k, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([*range(60), None]), f"x{k}") for k in range(300)]
    right = [(rng.choice([1, 1, 1, 2, None]), rng.choice([*range(5, 60, 3), None]), rng.randrange(9)) for _ in range(90)]
    got = asof_join(spark.createDataFrame(left, "id int, k int, t int, x string"), spark.createDataFrame(right, "k int, t int, v int"), ["k"], "t", ["v"], bucket).collect()
    want = {i: max(((u, v) for j, u, v in right if None not in (j, u, k, t) and j == k and u <= t), default=(None, None))[1] for i, k, t, _ in left}
    assert {r["id"]: r["v"] for r in got} == want and len(got) == 300 and {(r["id"], r["k"], r["t"], r["x"]) for r in got} == set(left)


def test_asof_deals_a_hot_key_to_many_buckets(spark, monkeypatch):
    """All rows have one key: no (key, bucket) has more than a part of them, and almost all find a value."""
    monkeypatch.setattr(joins, "BUCKET_ROWS", 100)
    left, right = spark.range(2000).selectExpr("1 k", "id t", "id i"), spark.range(0, 2000, 3).selectExpr("1 k", "id t", "id v")
    joined = asof_join(left, right, ["k"], "t", ["v"])
    assert [r["v"] for r in joined.orderBy("i").collect()] == [3 * (i // 3) for i in range(2000)]
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan.split("Window [last(_value")[1].split("\n")[0]


def test_asof_queries_find_values(spark):
    for name, column in (("join_asof", "event_id"), ("join_asof_atr", "close")):
        row = registry.QUERIES[name](spark, DATA).agg({column: "count", "*": "count"}).first()
        assert row[f"count({column})"] > 0.3 * row["count(1)"], name


def _bars(spark, closes, volume=None):
    ts = pd.date_range("2024-01-01", periods=len(closes))
    rows = pd.DataFrame({"symbol": 1, "ts": ts, "open": closes, "high": [c * 1.01 for c in closes], "low": [c * 0.99 for c in closes], "close": closes, "volume": volume or [100.0] * len(closes)})
    return spark.createDataFrame(rows).selectExpr("cast(symbol as bigint) symbol", "cast(ts as timestamp_ntz) ts", "open", "high", "low", "close", "volume")


def test_ema_is_the_recursion(spark):
    closes = [10.0, 11.0, 9.0, 12.0, 15.0]
    got = moving_averages(_bars(spark, closes)).orderBy("ts").toPandas()["ema_9"].tolist()
    want = [closes[0]]
    for c in closes[1:]:
        want.append(0.2 * c + 0.8 * want[-1])
    assert got == pytest.approx(want)


def test_breakout_takes_target(spark):
    closes = [20.0] * 21 + [24.0, 40.0]
    got = breakout_trades(_bars(spark, closes, [100.0] * 21 + [400.0, 100.0])).collect()
    assert [(r["reason"], r["entry"]) for r in got] == [("target", 24.0)]


def test_portfolio_conserves_cash(spark):
    bars = _bars(spark, [10.0, 10.0, 12.0, 12.0])
    signals = bars.where("close = 10").limit(1).select("ts", "symbol")
    params = spark.createDataFrame([(1, 0.9, 1.1, 0.5)], "run_id long, stop double, target double, size double")
    rows = portfolio_runs(signals, bars, params, cash=1000.0).orderBy("ts").collect()
    assert [r["equity"] for r in rows][-1] == pytest.approx(1000 + 50 * 2)
    assert rows[-1]["positions"] == 0


def test_portfolio_equals_a_plain_fold_and_holds_no_bars(spark):
    """All runs against a loop over days; what one task folds are signals with their exits."""
    rng, start = random.Random(8), datetime(2024, 1, 1)
    rows = [(s, start + timedelta(days=d), rng.choice([8.0, 9.5, 10.0, 12.0, 15.5]) * (1 + s % 3)) for s in range(12) for d in range(60) if rng.random() < 0.7]
    wanted = {(s, ts) for s, ts, _ in rows if s < 10 and rng.random() < 0.15}
    settings = [(1, 0.9, 1.2, 0.3), (2, 0.5, 1.5, 0.1), (3, 0.99, 1.01, 0.6)]
    want = {}
    for run, stop, target, size in settings:
        money, held, last = 1000.0, {}, {}
        for day in sorted({ts for s, ts, _ in rows if s < 10}):
            today = sorted(r for r in rows if r[1] == day and r[0] < 10)
            for s, _, close in today:
                last[s] = close
                if s in held and not stop < close / held[s][1] < target:
                    money += held.pop(s)[0] * close
            for s, ts, close in today:
                shares = int(min(size * money, 0.95 * money) / close) if (s, ts) in wanted and s not in held else 0
                if shares > 0:
                    held[s] = shares, close
                    money -= shares * close
            want[run, day] = (money + sum(q * last[s] for s, (q, _) in held.items()), money, len(held))
    bars = spark.createDataFrame(rows, "symbol long, ts timestamp_ntz, close double")
    signals = spark.createDataFrame(sorted(wanted), "symbol long, ts timestamp_ntz")
    got = portfolio_runs(signals, bars, spark.createDataFrame(settings, "run_id long, stop double, target double, size double"), cash=1000.0)
    assert {(r["run_id"], r["ts"]): (r["equity"], r["cash"], r["positions"]) for r in got.collect()} == {k: (pytest.approx(v[0]), pytest.approx(v[1]), v[2]) for k, v in want.items()}
    assert max(v[2] for v in want.values()) > 2
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_bootstrap_agrees_with_itself(spark):
    rows = spark.createDataFrame([(1, i, 0.01 + 0.001 * (i % 7)) for i in range(60)], "symbol long, ts int, ret double")
    a, b = (bootstrap(rows, runs=50).first() for _ in range(2))
    assert a == b and a["low"] <= a["mean_sharpe"] <= a["high"] and a["p_positive"] == 1.0


def test_normal_functions_and_vectors(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import crosses_below, falling, normal_cdf, normal_ppf, padded

    row = spark.createDataFrame([([3.0, 2.0, 1.0], [1.0, 1.5, 1.0])], "a array<double>, b array<double>").select(
        normal_cdf(F.lit(1.0)), normal_ppf(F.lit(0.975)), normal_ppf(F.lit(0.01)), normal_ppf(F.lit(1.0)), falling(F.col("a")), crosses_below(F.col("a"), F.col("b")), padded(F.col("a"), 5, 0.0), padded(F.col("a"), 2, 0.0)
    ).first()
    assert row[0] == pytest.approx(0.8413447, abs=1e-6) and row[1] == pytest.approx(1.959964, abs=1e-4) and row[2] == pytest.approx(-2.326348, abs=1e-4) and row[3] is None
    assert row[4] is True and row[5] is True and row[6] == [0.0, 0.0, 3.0, 2.0, 1.0] and row[7] == [2.0, 1.0]


@pytest.mark.parametrize("name", ["met_calmar", "met_composite", "set_portfolio_equality", "strat_cointegration", "strat_universe_scan", "met_behavior", "fn_trigrams", "stream_breakers", "stream_marks", "fn_sessions", "join_asof"])
def test_answers_vary(spark, name):
    """A column that says the same in every row proves nothing; n counts rows of equal calendars."""
    rows = registry.QUERIES[name](spark, DATA).drop("n").toPandas().astype(str)
    assert len(rows) > 5 and [c for c in rows.columns if rows[c].nunique() < 2] == []
