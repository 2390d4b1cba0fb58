"""Streams with state against plain folds, whatever the micro-batches."""

import random
from datetime import UTC, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.plans import live
from tidemark.streaming import ROCKS, run_appended
from tidemark.streaming.breakers import DAY, HOUR, MINUTE, Limits, breaker_changes
from tidemark.streaming.marks import marked, newest

START = int(datetime(2024, 3, 4, tzinfo=UTC).timestamp()) * 1_000_000
LIMITS = Limits(capital=1000.0, losses=3, idle=6 * DAY)


def plain(trades, upto):
    """A strategy's changes: minute by minute rules, written out."""
    out, equity, peak, start, day, streak, reduced, last, until = [], 1000.0, 1000.0, 0.0, None, 0, False, None, {}

    def pass_time(now):
        nonlocal equity, peak, start, day, streak, reduced, last
        for name in [n for n in until if until[n] <= now]:
            out.append((until[name], name, "expire", until[name]))
            del until[name]
        if last is not None and now - last > 6 * DAY:
            if reduced:
                out.append((last + 6 * DAY, "drawdown", "release", -1))
            equity, peak, start, day, streak, reduced, last = 1000.0, 1000.0, 0.0, None, 0, False, None

    for at, _, pnl in sorted(t for t in trades if t[0] <= upto):
        pass_time(at)
        if day != at // DAY:
            day, start = at // DAY, equity
        equity, last = equity + pnl, at
        peak, streak = max(peak, equity), 0 if pnl > 0 else streak + 1
        trips = {"daily_loss": (start - equity >= 0.02 * start and start > 0, (day + 1) * DAY + 9 * HOUR + 30 * MINUTE), "consecutive_loss": (streak >= 3, at + 4 * HOUR), "strategy_loss": (1000 - equity >= 50, at + 24 * HOUR)}
        for name, (hit, end) in trips.items():
            if hit and name not in until:
                until[name] = end
                out.append((at, name, "trip", end))
        fallen = 1 - equity / peak
        if (not reduced and fallen >= 0.15) or (reduced and fallen < 0.075):
            reduced = not reduced
            out.append((at, "drawdown", "trip" if reduced else "release", -1))
    pass_time(upto)
    return out


def write(spark, folder, batches, columns):
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, columns).withColumn("ts", F.timestamp_micros("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.parquet(f"{folder}/{k}")
        part = next((folder / str(k)).glob("part-*"))
        part.rename(folder / f"t-{k:03}.parquet")


@pytest.mark.parametrize("files", [1, 100])
def test_breakers_equal_a_plain_fold(spark, tmp_path, files):
    rng = random.Random(12)
    trades = []
    for k in range(400):
        # Strategy 2 rests for ten days in the middle; times are whole minutes, so many tie.
        strategy = rng.randrange(3)
        day = rng.randrange(20)
        if strategy == 2 and 5 <= day < 15:
            continue
        trades.append((k, START + day * DAY + rng.randrange(24 * 60) * MINUTE, strategy, rng.choice([30.0, 12.5, -11.25, -20.0, 55.0, -70.0])))
    trades.sort(key=lambda t: t[1] + rng.randrange(9) * MINUTE)
    trades.append((9999, START + 40 * DAY, 77, 1.0))
    write(spark, tmp_path, [trades[k : k + 60] for k in range(0, len(trades), 60)] + [[(10_000, None, 1, 5.0), (10_001, START + 41 * DAY, None, 5.0)]], "trade_id long, ts long, strategy long, pnl double")
    got = run_appended(spark, str(tmp_path), "t-*.parquet", lambda s: breaker_changes(s, LIMITS), files).collect()
    upto = START + 40 * DAY - 10 * MINUTE
    want = [(s, *x) for s in range(3) for x in plain([(at, k, pnl) for k, at, t, pnl in trades if t == s], upto)]
    assert sorted((r["strategy"], r["at"], r["breaker"], r["change"], r["until"]) for r in got) == sorted(want)
    assert {(b, c) for _, _, b, c, _ in want} == {("daily_loss", "trip"), ("daily_loss", "expire"), ("consecutive_loss", "trip"), ("consecutive_loss", "expire"), ("strategy_loss", "trip"), ("strategy_loss", "expire"), ("drawdown", "trip"), ("drawdown", "release")}


def test_breakers_of_an_idle_strategy_equal_sql(spark, tmp_path):
    """A strategy that fell by more than 15 % and rests for 50 days is still reduced when it comes back, and after."""
    values = [(0, 300.0), (1, -500.0), (2, 49.0), (51, 49.0), (52, 20.0), (53, 900.0), (54, -300.0), (120, 51.0)]
    rows = [(k, START + day * DAY, 1, value) for k, (day, value) in enumerate(values)] + [(100 + k, START + k * DAY, 2, 45.0) for k in range(121)]
    write(spark, tmp_path, [rows], "event_id long, ts long, user_id long, value double")
    (tmp_path / "t-000.parquet").rename(tmp_path / "events.parquet")
    got = live.stream_breakers(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'").fetchall()
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({live.ORACLE['stream_breakers'].replace('{events}', 'events')}) q").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r["change"] for r in got.where("strategy = 1 and breaker = 'drawdown'").collect()} == {"trip", "release"}


def test_state_shrinks(spark, tmp_path):
    rows = [[(k, START + k * MINUTE, k % 50, -5.0) for k in range(500)], [(900, START + 30 * DAY, 99, 1.0)]]
    write(spark, tmp_path, rows, "trade_id long, ts long, strategy long, pnl double")
    stream = spark.readStream.schema("trade_id long, ts timestamp_ntz, strategy long, pnl double").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "t-*").parquet(str(tmp_path)).withColumn("ts", F.col("ts").cast("timestamp"))
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        query = breaker_changes(stream, LIMITS).writeStream.outputMode("append").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k in ROCKS:
            spark.conf.unset(k)
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(totals) >= 50 and totals[-1] < 10, totals


def test_marks_equal_a_plain_fold_over_batches(spark, tmp_path):
    rng = random.Random(4)
    ticks = [(k, START + rng.randrange(900) * MINUTE, rng.randrange(4), rng.choice([None, 8.0, 10.0, 11.5, 14.0])) for k in range(240)]
    write(spark, tmp_path, [ticks[k : k + 50] for k in range(0, 240, 50)], "tick_id long, ts long, symbol long, price double")
    held = [(k, k % 5, rng.choice(["long", "short"]), 1 + k % 3, 10.0, START + rng.randrange(600) * MINUTE, rng.choice([None, START + 700 * MINUTE])) for k in range(30)]
    positions = spark.createDataFrame(held, "position_id long, symbol long, side string, shares int, entry_price double, a long, b long")
    positions = positions.withColumn("opened_at", F.timestamp_micros("a")).withColumn("closed_at", F.timestamp_micros("b")).drop("a", "b")
    rows = run_appended(spark, str(tmp_path), "t-*.parquet", lambda s: marked(s, positions), 1, "update")
    assert rows.select("batch").distinct().count() > 3
    got = {r["position_id"]: (r["current_price"], r["unrealized_pnl"], r["max_profit"], r["max_drawdown"], r["ticks"]) for r in newest(rows).collect()}
    want = {}
    for k, symbol, side, shares, entry, opened, closed in held:
        top = low = n = 0
        for tick_id, at, s, price in sorted(ticks, key=lambda t: (t[1], t[0])):
            if s == symbol and price is not None and at >= opened and (closed is None or at < closed):
                pnl = (price - entry) * shares * (1 if side == "long" else -1)
                top, low, n = max(top, pnl), max(low, -pnl), n + 1
                want[k] = (price, pnl, top, low, n)
    assert got == want and len(want) > 15
