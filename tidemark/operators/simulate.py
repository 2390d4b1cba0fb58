"""Trade simulations that depend on their own past, in parallel over independent runs or symbols."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import stored


def breakout_trades(bars: DataFrame, volume: float = 1.5, gap: float = 0.02, days: int = 5) -> DataFrame:
    """(symbol, entry_ts, exit_ts, entry, exit, reason, ret): long breakouts on volume, one position a symbol at a time.

    Exits come within a bar, the stop (yesterday's low less the range's mean)
    first, then the target, then the close after ``days`` calendar days.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    span = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.lag("close").over(w)), F.abs(F.col("low") - F.lag("close").over(w)))
    ready = bars.withColumn("tr", span).withColumns({
        "rv": F.col("volume") / F.avg("volume").over(w.rowsBetween(-19, 0)), "ph": F.lag("high").over(w), "pl": F.lag("low").over(w), "pc": F.lag("close").over(w),
        "atr": F.avg("tr").over(w.rowsBetween(-13, 0)), "n": F.row_number().over(w),
    }).withColumn("enter", (F.col("n") > 20) & (F.col("rv") >= volume) & (F.col("close") > F.col("ph")) & (F.abs(F.col("open") / F.col("pc") - 1) >= gap) & (F.col("close") >= 10))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        trades, held = [], None
        for r in rows.sort_values("ts").itertuples(index=False):
            if held is None:
                if r.enter:
                    held = r.ts, r.close, r.pl - r.atr, r.close + 2 * r.atr
                continue
            since, entry, stop, target = held
            out = (stop, "stop") if r.low <= stop else (target, "target") if r.high >= target else (r.close, "time") if (r.ts - since).days >= days else None
            if out:
                trades.append((r.symbol, since, r.ts, entry, out[0], out[1], out[0] / entry - 1))
                held = None
        return pd.DataFrame(trades, columns=["symbol", "entry_ts", "exit_ts", "entry", "exit", "reason", "ret"])

    columns = ["symbol", "ts", "low", "high", "close", "pl", "atr", "enter"]
    return ready.select(*columns).groupBy("symbol").applyInPandas(one, "symbol long, entry_ts timestamp_ntz, exit_ts timestamp_ntz, entry double, exit double, reason string, ret double")


def _exits(bars: DataFrame, signals: DataFrame, params: DataFrame) -> DataFrame:
    """(run_id, symbol, ts, close, size, exit_ts, exit) of each run's signals: the first later close that meets stop or target, if any."""
    later = bars.select("symbol", F.col("ts").alias("_at"), F.col("close").alias("_price"))
    pairs = signals.join(bars, ["symbol", "ts"]).join(later, "symbol").where("_at >= ts").crossJoin(F.broadcast(params))
    gain = F.col("_price") / F.col("close")
    gone = (F.col("_at") > F.col("ts")) & ~((F.col("stop") < gain) & (gain < F.col("target")))
    first = F.min(F.when(gone, F.struct(F.col("_at").alias("ts"), F.col("_price").alias("price"))))
    return pairs.groupBy("run_id", "symbol", "ts", "close", "size").agg(first.alias("_exit")).select("run_id", "symbol", "ts", "close", "size", F.col("_exit.ts").alias("exit_ts"), F.col("_exit.price").alias("exit"))


def _bought(orders: DataFrame, cash: float) -> DataFrame:
    """(run_id, ts, step, money, symbol, exit_ts, shares): a run's purchases as far as its cash goes, and its exits (shares are null).

    A run's signals pass in order of time and symbol; held are only its open
    positions. A day's exits, in order of symbol, come before its purchases.
    money is what is left after the step.
    """
    columns = ["run_id", "ts", "step", "money", "symbol", "exit_ts", "shares"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, money, due, held, out = None, cash, [], set(), []

        def leave(upto) -> None:  # noqa: ANN001
            nonlocal money
            while due and (upto is None or due[0][0] <= upto):
                at, symbol, shares, price = heapq.heappop(due)
                held.remove(symbol)
                money += shares * price
                out.append((run, at, len(out) + before, money, symbol, None, None))

        def told(kind: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind, strict=True)] if out else [pa.array([], t) for t in kind], columns)

        kind, before = None, 0
        for batch in batches:
            field = batch.schema.field
            kind = [pa.int64(), field("ts").type, pa.int64(), pa.float64(), field("symbol").type, field("exit_ts").type, pa.float64()]
            for one, ts, symbol, close, size, exit_ts, price in zip(*(batch.column(c).to_pylist() for c in ("run_id", "ts", "symbol", "close", "size", "exit_ts", "exit")), strict=True):
                if one != run:
                    leave(None)
                    run, money = one, cash
                    held.clear()
                leave(ts)
                # Whole shares as a double: what returns multiply can outgrow a long.
                shares = float(int(min(size * money, 0.95 * money) / close)) if symbol not in held else 0.0
                if shares > 0:
                    held.add(symbol)
                    money -= shares * close
                    out.append((run, ts, len(out) + before, money, symbol, exit_ts, shares))
                    if exit_ts is not None:
                        heapq.heappush(due, (exit_ts, symbol, shares, price))
            yield told(kind)
            before += len(out)
            out.clear()
        if kind:
            leave(None)
            yield told(kind)

    kinds = dict(orders.dtypes)
    ordered = orders.repartition("run_id").sortWithinPartitions("run_id", "ts", "symbol")
    return ordered.mapInArrow(walk, f"run_id long, ts {kinds['ts']}, step long, money double, symbol {kinds['symbol']}, exit_ts {kinds['ts']}, shares double")


def portfolio_runs(signals: DataFrame, bars: DataFrame, params: DataFrame, cash: float = 100_000.0) -> DataFrame:
    """(run_id, ts, equity, cash, positions) of every parameter row (run_id, stop, target, size), run apart from each other.

    signals (ts, symbol) buy at the close. Each day stops and targets are
    checked at the close, stop first; then signals are bought in order of
    symbol while cash lasts. When a position would be sold follows from its
    symbol alone, so that is found symbol by symbol. Only what a run can pay
    for depends on its past: a fold over its signals, not over the bars. The
    days' values then come from the bars of the positions it took.
    """
    # Stored: read several times, and what they come from may be costly.
    bars, signals = stored(bars.select("symbol", "ts", "close"), "bars"), stored(signals.select("symbol", "ts").distinct(), "signals")
    steps = stored(_bought(_exits(bars, signals, params), cash), "steps")
    days = stored(bars.join(signals.select("symbol").distinct(), "symbol", "left_semi").select("ts").distinct(), "days")
    held = steps.where("shares is not null").select("run_id", "symbol", F.col("ts").alias("since"), "exit_ts", "shares")
    # A row for each position and day on which it is held, with the symbol's last close.
    spans = held.join(F.broadcast(days), (F.col("ts") >= F.col("since")) & (F.col("exit_ts").isNull() | (F.col("ts") < F.col("exit_ts"))))
    closes = bars.join(held.select("symbol").distinct(), "symbol", "left_semi")
    last = F.last("close", ignorenulls=True).over(Window.partitionBy("run_id", "symbol", "since").orderBy("ts"))
    worth = spans.join(closes, ["symbol", "ts"], "left").withColumn("worth", F.col("shares") * last).groupBy("run_id", "ts").agg(F.sum("worth").alias("worth"), F.count("*").alias("positions"))
    left = steps.groupBy("run_id", "ts").agg(F.max_by("money", "step").alias("money"))
    # One row a run and day.
    told = days.crossJoin(F.broadcast(params.select("run_id"))).join(left, ["run_id", "ts"], "left").join(worth, ["run_id", "ts"], "left")
    money = F.coalesce(F.last("money", ignorenulls=True).over(Window.partitionBy("run_id").orderBy("ts")), F.lit(cash))
    return told.select(F.col("run_id").cast("long").alias("run_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), (money + F.coalesce("worth", F.lit(0.0))).alias("equity"), money.alias("cash"), F.coalesce("positions", F.lit(0)).cast("long").alias("positions"))
