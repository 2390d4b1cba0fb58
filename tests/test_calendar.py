"""Zones and sessions on planted instants."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.functions.calendar import from_market, in_hours, sessions, to_market, utc_naive, with_sessions
from tidemark.plans.times import CLOSED, EARLY


def stamps(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))


def test_both_changes_of_the_clocks(spark):
    utc = ["2025-03-09 06:59:59", "2025-03-09 07:00:00", "2025-11-02 05:59:59", "2025-11-02 06:00:00", "2025-07-01 12:00:00.25"]
    got = [str(r[0]) for r in stamps(spark, *utc).select(to_market(F.col("ts"))).collect()]
    assert got == ["2025-03-09 01:59:59", "2025-03-09 03:00:00", "2025-11-02 01:59:59", "2025-11-02 01:00:00", "2025-07-01 08:00:00.250000"]
    wall = ["2025-03-09 01:59:00", "2025-03-09 02:30:00", "2025-03-09 03:00:00", "2025-11-02 00:59:00", "2025-11-02 01:30:00", "2025-11-02 02:00:00"]
    back = [str(r[0])[5:16] for r in stamps(spark, *wall).select(from_market(F.col("ts"))).collect()]
    # The skipped half hour moves on, the repeated hour is its first.
    assert back == ["03-09 06:59", "03-09 07:30", "03-09 07:00", "11-02 04:59", "11-02 05:30", "11-02 07:00"]


def test_texts_with_offsets(spark):
    texts = ["2025-01-01T10:00:00Z", "2025-01-01T10:00:00+02:00", "2025-01-01T10:00:00.5-0530", "2025-01-01 10:00:00", "2025-01-01", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(utc_naive(F.col("t"))).collect()]
    assert got == [datetime(2025, 1, 1, 10), datetime(2025, 1, 1, 8), datetime(2025, 1, 1, 15, 30, 0, 500_000), datetime(2025, 1, 1, 10), datetime(2025, 1, 1), None, None]


def test_rules_give_the_listed_days(spark):
    days = {str(r["day"]): r for r in sessions(spark, 2025, 2026).collect()}
    assert len(days) == 730
    assert sorted(d for d, r in days.items() if r["holiday"]) == [d for d in CLOSED if d < "2027"]
    assert sorted(d for d, r in days.items() if r["early_close"]) == EARLY
    assert days["2025-12-24"]["close_utc"] == datetime(2025, 12, 24, 18) and days["2026-07-01"]["open_utc"] == datetime(2026, 7, 1, 13, 30)
    assert days["2025-04-17"]["next_session"] == date(2025, 4, 21) and days["2025-04-21"]["previous_session"] == date(2025, 4, 17)


def test_other_years_by_rule(spark):
    """New Year's Day on a Saturday isn't kept in the old year; Sundays move on; Easter moves."""
    closed = {str(r["day"]) for r in sessions(spark, 2021, 2024).where("holiday").collect()}
    assert {"2022-12-26", "2023-01-02", "2022-06-20", "2022-04-15", "2023-04-07", "2024-03-29", "2021-07-05"} <= closed


def test_hours_and_next_open(spark):
    rows = stamps(spark, "2025-07-03 13:29:59", "2025-07-03 13:30:00", "2025-07-03 17:00:00", "2025-07-04 15:00:00", "2025-12-31 21:00:00", "2031-01-01 00:00:00", None)
    got = {r["t"]: (r["is_open"], r["next_open_utc"]) for r in with_sessions(rows, "ts", 2025, 2025).collect()}
    assert got["2025-07-03 13:29:59"] == (False, datetime(2025, 7, 3, 13, 30)) and got["2025-07-03 13:30:00"] == (True, datetime(2025, 7, 7, 13, 30))
    assert got["2025-07-03 17:00:00"][0] is False and got["2025-07-04 15:00:00"] == (False, datetime(2025, 7, 7, 13, 30))
    assert got["2031-01-01 00:00:00"] == (None, None) == got[None]
    walls = stamps(spark, "2025-07-03 09:29:59", "2025-07-03 09:30:00", "2025-07-03 16:00:00", "2025-07-03 16:00:00.1", "2025-07-05 12:00:00")
    assert [tuple(r) for r in walls.select(in_hours(F.col("ts")), in_hours(F.col("ts"), False)).collect()] == [(False, False), (True, True), (True, False), (False, False), (False, False)]
