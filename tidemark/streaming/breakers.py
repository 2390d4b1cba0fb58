"""Trading breakers as a stream: keyed state that trips, releases with hysteresis and expires.

Each strategy has an account. A closed trade changes its equity, after which
four breakers are looked at: a day's loss halts until the next day's open, a
drawdown reduces until it has halved, losses in a row pause for hours, and a
loss of the strategy's allocation pauses for a day. Trades may arrive out of
order: they wait in state until the watermark has passed them and are then
folded in order, so the result doesn't depend on how they came in batches.
Timers at the next waiting trade and the next expiry drive this. An account that
is idle for longer than ``idle`` is forgotten, and starts afresh with its next
trade; without that limit the state keeps an account for each strategy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE = 60_000_000
HOUR, DAY = 60 * MINUTE, 24 * 60 * MINUTE
#: Actions of the breakers.
ACTIONS = {"daily_loss": "halt", "drawdown": "reduce", "consecutive_loss": "pause", "strategy_loss": "pause"}
CHANGES = "strategy long, at long, breaker string, action string, change string, until long"


@dataclass(frozen=True)
class Limits:
    """Shares of the equity or allocation; times in microseconds. ``idle`` None: accounts are never forgotten."""

    capital: float = 10_000.0
    daily_loss: float = 0.02
    drawdown: float = 0.15
    losses: int = 5
    loss_pause: int = 4 * HOUR
    strategy_loss: float = 0.05
    strategy_pause: int = 24 * HOUR
    open_at: int = 9 * HOUR + 30 * MINUTE
    idle: int | None = 30 * DAY


@dataclass
class Account:
    """Times are microseconds, -1 for none."""

    equity: float
    peak: float
    day: int = -1
    day_equity: float = 0.0
    streak: int = 0
    last: int = -1
    reduced: bool = False
    halted: int = -1
    paused: int = -1
    stopped: int = -1

    def expiries(self) -> list[tuple[int, str, str]]:
        held = [(self.halted, "daily_loss", "halted"), (self.paused, "consecutive_loss", "paused"), (self.stopped, "strategy_loss", "stopped")]
        return sorted(x for x in held if x[0] >= 0)


ACCOUNT = "equity double, peak double, day long, day_equity double, streak long, last long, reduced boolean, halted long, paused long, stopped long"


def expire(account: Account, upto: int, limits: Limits) -> tuple[Account, list[tuple]]:
    """What ends by a time: halts, pauses, and the account itself if it has been idle."""
    out = []
    for until, breaker, name in account.expiries():
        if until <= upto:
            setattr(account, name, -1)
            out.append((until, breaker, ACTIONS[breaker], "expire", until))
    if limits.idle is not None and 0 <= account.last < upto - limits.idle:
        if account.reduced:
            out.append((account.last + limits.idle, "drawdown", "reduce", "release", -1))
        account = Account(limits.capital, limits.capital)
    return account, out


def trade(account: Account, at: int, pnl: float, limits: Limits) -> list[tuple]:
    """Changes of the breakers that a trade brings; the account is updated."""
    if at // DAY != account.day:
        account.day, account.day_equity = at // DAY, account.equity
    account.equity += pnl
    account.peak, account.last = max(account.peak, account.equity), at
    account.streak = 0 if pnl > 0 else account.streak + 1
    out = []

    def trip(breaker: str, until: int) -> int:
        out.append((at, breaker, ACTIONS[breaker], "trip", until))
        return until

    if account.halted < 0 and account.day_equity > 0 and account.day_equity - account.equity >= limits.daily_loss * account.day_equity:
        account.halted = trip("daily_loss", (account.day + 1) * DAY + limits.open_at)
    fallen = (account.peak - account.equity) / account.peak
    if not account.reduced and fallen >= limits.drawdown:
        account.reduced = trip("drawdown", -1) == -1
    elif account.reduced and fallen < limits.drawdown / 2:
        account.reduced = False
        out.append((at, "drawdown", "reduce", "release", -1))
    if account.paused < 0 and account.streak >= limits.losses:
        account.paused = trip("consecutive_loss", at + limits.loss_pause)
    if account.stopped < 0 and limits.capital - account.equity >= limits.strategy_loss * limits.capital:
        account.stopped = trip("strategy_loss", at + limits.strategy_pause)
    return out


class Breakers(StatefulProcessor):
    """State of a strategy: its account, and the trades that the watermark hasn't passed."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", ACCOUNT)
        self.waiting = handle.getListState("waiting", "at long, trade_id long, pnl double")

    def _advance(self, key: tuple, new: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        held = self.account.exists()
        account = Account(*self.account.get()) if held else Account(self.limits.capital, self.limits.capital)
        waiting = sorted([*(tuple(x) for x in self.waiting.get()), *new]) if self.waiting.exists() else sorted(new)
        upto, out = watermark_ms * 1000, []
        ready = [x for x in waiting if x[0] <= upto]
        for at, _, pnl in ready:
            account, ended = expire(account, at, self.limits)
            out += ended + trade(account, at, float(pnl), self.limits)
        account, ended = expire(account, upto, self.limits)
        out += ended
        rest = waiting[len(ready) :]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        if account.last >= 0:
            self.account.update(astuple(account))
        elif held:
            self.account.clear()
        due = [x for x, _, _ in rest[:1]] + [x for x, _, _ in account.expiries()[:1]] + ([account.last + self.limits.idle + 1] if self.limits.idle is not None and account.last >= 0 else [])
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["strategy", "at", "breaker", "action", "change", "until"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        new = [x for batch in rows for x in zip(batch["at"].tolist(), batch["trade_id"].tolist(), batch["pnl"].tolist(), strict=True)]
        yield from self._advance(key, new, max(0, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self._advance(key, [], max(0, timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


assert [f.name for f in fields(Account)] == [c.split()[0] for c in ACCOUNT.split(", ")]


def breaker_changes(trades: DataFrame, limits: Limits = Limits(), late: str = "10 minutes") -> DataFrame:  # noqa: B008
    """(strategy, at, breaker, action, change, until) of a stream of trades (trade_id, ts, strategy, pnl); times in microseconds.

    Complete up to the watermark, ``late`` behind the newest trade; later trades
    are dropped. Null times, strategies or results are left out; trades of one
    time go by trade_id. The state store has to be RocksDB's.
    """
    rows = trades.where("ts is not null and strategy is not null and pnl is not null").withWatermark("ts", late)
    slim = rows.select("ts", F.unix_micros("ts").alias("at"), F.col("trade_id").cast("long").alias("trade_id"), F.col("strategy").cast("long").alias("strategy"), F.col("pnl").cast("double").alias("pnl"))
    return slim.groupBy("strategy").transformWithStateInPandas(Breakers(limits), CHANGES, "append", "eventtime")
