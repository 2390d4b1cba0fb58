"""Market time: zones, and the exchange's sessions by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZONE = "America/New_York"


def to_market(utc: Column, zone: str = ZONE) -> Column:
    """A naive UTC time as the zone's wall clock, also naive."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz"))


def from_market(wall: Column, zone: str = ZONE) -> Column:
    """A zone's wall clock as naive UTC. A wall time that a change of the clocks repeats is its first; one that it skips moves on by the gap."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall.cast("timestamp_ntz"))


def utc_naive(text: Column) -> Column:
    """An ISO time with or without an offset as naive UTC; without one it is UTC already. Null for what is no time."""
    offset = F.regexp_extract(text, r"([+-])(\d\d):?(\d\d)$", 0)
    minutes = F.when(F.length(offset) > 0, F.concat(F.substring(offset, 1, 1), F.lit("1")).cast("int") * (F.substring(offset, 2, 2).cast("int") * 60 + F.right(offset, F.lit(2)).cast("int"))).otherwise(0)
    bare = F.regexp_replace(text, r"(?<=\d\d:\d\d.{0,16})([+-]\d\d:?\d\d|Z)$", "")
    return F.timestamp_add("MINUTE", -minutes, F.try_to_timestamp(bare).cast("timestamp_ntz"))


def in_hours(wall: Column, closed_end: bool = True) -> Column:
    """Monday to Friday, 09:30 to 16:00, the end included or not."""
    minute = F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall) + F.extract(F.lit("SECOND"), wall) % 1
    until = minute <= 57_600 if closed_end else minute < 57_600
    return (F.weekday(wall) < 5) & (minute >= 34_200) & until


def _easter(y: str) -> str:
    """Easter Sunday of a year by the Gregorian reckoning."""
    h = f"((19 * ({y} % 19) + {y} div 100 - {y} div 400 - ({y} div 100 - ({y} div 100 + 8) div 25 + 1) div 3 + 15) % 30)"
    el = f"((32 + 2 * ({y} div 100 % 4) + 2 * ({y} % 100 div 4) - {h} - {y} % 100 % 4) % 7)"
    m = f"(({y} % 19 + 11 * {h} + 22 * {el}) div 451)"
    n = f"({h} + {el} - 7 * {m} + 114)"
    return f"make_date({y}, CAST({n} div 31 AS INT), CAST({n} % 31 + 1 AS INT))"


def sessions(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """A row for each day: holiday, session, early_close, open_utc, close_utc (null without a session), previous_session, next_session.

    Holidays by the exchange's rules since 2022: fixed days move from Saturday to
    Friday and from Sunday to Monday (New Year's not to the old year), the others are the
    n-th weekdays and Good Friday. It closes at 13:00 on weekdays before Independence Day as kept, after
    Thanksgiving and on Christmas Eve. The table grows with the years alone.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(f"{first_year - 1}-12-01").cast("date"), F.lit(f"{last_year + 1}-01-31").cast("date"))).alias("day"))
    days = days.selectExpr("day", "year(day) y", "month(day) m", "day(day) d", "weekday(day) w")

    def kept(month: int, day: int, at: str = "{}") -> str:
        """Whether a day (or one at some distance) is the one on which a fixed holiday is kept."""
        x = at.format("day")
        fixed = f"make_date(year({x}), {month}, {day})"
        return f"({x} = {fixed} AND weekday({fixed}) < 5 OR {x} = date_sub({fixed}, 1) AND weekday({fixed}) = 5 OR {x} = date_add({fixed}, 1) AND weekday({fixed}) = 6)"

    nth = "m = {} AND w = {} AND (d - 1) div 7 = {}".format
    rules = [kept(1, 1), nth(1, 0, 2), nth(2, 0, 2), f"day = date_sub({_easter('y')}, 2)", "m = 5 AND w = 0 AND d > 24", kept(6, 19), kept(7, 4), nth(9, 0, 0), nth(11, 3, 3), kept(12, 25)]
    days = days.withColumn("holiday", F.expr(" OR ".join(f"({r})" for r in rules))).withColumn("session", ~F.col("holiday") & (F.col("w") < 5))
    early = f"session AND ({kept(7, 4, 'date_add({}, 1)')} OR m = 11 AND w = 4 AND d BETWEEN 23 AND 29 OR m = 12 AND d = 24)"
    days = days.withColumn("early_close", F.expr(early))
    # One task over the calendar: some 365 rows a year, whatever the data.
    w = Window.orderBy("day")
    open_day = F.when(F.col("session"), F.col("day"))
    at = lambda hours: F.timestamp_add("MINUTE", hours, F.col("day").cast("timestamp_ntz"))
    days = days.withColumns({
        "previous_session": F.max(open_day).over(w.rowsBetween(Window.unboundedPreceding, -1)), "next_session": F.min(open_day).over(w.rowsBetween(1, Window.unboundedFollowing)),
        "open_utc": F.when(F.col("session"), from_market(at(F.lit(570)))), "close_utc": F.when(F.col("session"), from_market(at(F.when(F.col("early_close"), 780).otherwise(960)))),
    })
    return days.where(F.col("y").between(first_year, last_year)).drop("y", "m", "d", "w")


def with_sessions(rows: DataFrame, utc: str, first_year: int, last_year: int) -> DataFrame:
    """rows with market_time, is_open (by the calendar, its close excluded) and next_open_utc: the first opening after the time in ``utc``.

    An equi-join on the market's date; times outside the years, and null ones, get nulls.
    """
    days = sessions(rows.sparkSession, first_year, last_year)
    opens = days.select(F.col("day").alias("_next"), F.col("open_utc").alias("_next_open")).where("_next_open is not null")
    days = days.join(opens, days["next_session"] == opens["_next"], "left").select("day", "open_utc", "close_utc", "_next_open")
    # Under 400 rows for each year asked for.
    out = rows.withColumn("market_time", to_market(F.col(utc))).withColumn("_day", F.to_date("market_time")).join(F.broadcast(days), F.col("_day") == F.col("day"), "left")
    time = F.col(utc).cast("timestamp_ntz")
    is_open = F.when(F.col("day").isNotNull(), F.coalesce((time >= F.col("open_utc")) & (time < F.col("close_utc")), F.lit(False)))
    return out.withColumns({"is_open": is_open, "next_open_utc": F.when(time < F.col("open_utc"), F.col("open_utc")).otherwise(F.col("_next_open"))}).drop("_day", "day", "open_utc", "close_utc", "_next_open")
