"""Queries over market time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import from_market, in_hours, utc_naive, with_sessions
from tidemark.sources import table


def fn_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt over 2025 and 2026 in steps of 53 minutes and some seconds, as instants in UTC: market time, hours, sessions."""
    events = table(spark, sf_dir, "events").select("event_id", F.timestamp_add("SECOND", (F.col("event_id") * 3187 % 63_000_000).cast("int"), F.lit("2025-01-01").cast("timestamp_ntz")).alias("instant"))
    told = with_sessions(events, "instant", 2024, 2026)
    offset = F.element_at(F.array(F.lit("Z"), F.lit("-05:00"), F.lit("+05:30"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat(F.date_format("instant", "yyyy-MM-dd'T'HH:mm:ss"), offset)
    return told.select("event_id", "instant", "market_time", utc_naive(text).alias("from_text"), from_market(F.col("instant")).alias("as_market"), in_hours(F.col("market_time")).alias("in_hours"), in_hours(F.col("market_time"), False).alias("before_close"), "is_open", "next_open_utc")


QUERIES = {f.__name__: f for f in (fn_sessions,)}
#: The days on which the exchange is closed, and closes early, in 2025 and 2026.
CLOSED = ["2025-01-01", "2025-01-20", "2025-02-17", "2025-04-18", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-11-27", "2025-12-25", "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25", "2027-01-01"]
EARLY = ["2025-07-03", "2025-11-28", "2025-12-24", "2026-07-02", "2026-11-27", "2026-12-24"]
#: A wall time that is there twice is its first, as the query has it.
ORACLE = {
    "fn_sessions": f"""WITH e AS (SELECT event_id, TIMESTAMP '2025-01-01' + INTERVAL 1 SECOND * (event_id * 3187 % 63000000) AS t FROM {{events}}),
w AS (SELECT *, timezone('America/New_York', timezone('UTC', t)) AS ny, timezone('UTC', timezone('America/New_York', t)) AS u FROM e),
d AS (SELECT CAST(x AS DATE) AS day FROM range(DATE '2025-01-01', DATE '2027-01-10', INTERVAL 1 DAY) r(x) WHERE isodow(x) < 6 AND CAST(x AS DATE) NOT IN ({", ".join(f"DATE '{x}'" for x in CLOSED)})),
s AS (SELECT day, timezone('UTC', timezone('America/New_York', day + INTERVAL '9 hours 30 minutes')) AS opens, timezone('UTC', timezone('America/New_York', day + CASE WHEN day IN ({", ".join(f"DATE '{x}'" for x in EARLY)}) THEN INTERVAL 13 HOUR ELSE INTERVAL 16 HOUR END)) AS closes FROM d)
SELECT event_id, t AS instant, ny AS market_time, CASE event_id % 4 WHEN 1 THEN t + INTERVAL 5 HOUR WHEN 2 THEN t - INTERVAL '5 hours 30 minutes' ELSE t END AS from_text, CASE WHEN timezone('America/New_York', timezone('UTC', u - INTERVAL 1 HOUR)) = t THEN u - INTERVAL 1 HOUR ELSE u END AS as_market,
  isodow(ny) < 6 AND CAST(ny AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00' AS in_hours, isodow(ny) < 6 AND CAST(ny AS TIME) >= TIME '09:30:00' AND CAST(ny AS TIME) < TIME '16:00:00' AS before_close,
  EXISTS (SELECT 1 FROM s WHERE t >= opens AND t < closes) AS is_open, (SELECT min(opens) FROM s WHERE opens > t) AS next_open_utc FROM w""",
}
