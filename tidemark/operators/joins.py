"""As-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

#: Rows of the most frequent key that a bucket of time holds on average.
BUCKET_ROWS = 100_000


def _number(c: Column, kind: str) -> Column:
    """A time or number as a long, in order."""
    return F.unix_micros(c.cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else F.floor(c).cast("long")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], bucket: int | None = None) -> DataFrame:
    """left with the values of the last right row of the same key at or before its time; null where there is none.

    Both sides are stacked and dealt to buckets of a key and a span of time, so
    that no task holds all of a frequent key. Inside a bucket the last right row
    is carried forward; what came in earlier buckets comes from a second, small
    pass over the last row of each bucket. ``bucket`` is its span (microseconds
    for times); without it, it is chosen so that the most frequent key has some
    BUCKET_ROWS rows in one. Right rows of equal time are taken in order of
    their values; null keys and times match nothing.
    """
    kind = dict(left.dtypes)[at]
    right = right.select(*by, at, F.struct(*values).alias("_value")).where(" and ".join(f"`{c}` is not null" for c in (*by, at)))
    mine = left.select(*by, F.col(at), F.struct(*(F.col(c) for c in left.columns)).alias("_left"), F.lit(None).cast(right.schema["_value"].dataType).alias("_value"), F.lit(1).alias("_own"))
    both = mine.unionByName(right.select(*by, at, F.lit(None).cast(mine.schema["_left"].dataType).alias("_left"), "_value", F.lit(0).alias("_own"))).withColumn("_n", _number(F.col(at), kind))
    # Stored: three passes read it, and what it comes from may be costly.
    both = stored(both, "asof")
    if bucket is None:
        # A key's row count and span; one row reaches the driver.
        most = both.groupBy(*by).agg(F.count("*").alias("c"), F.min("_n").alias("lo"), F.max("_n").alias("hi")).agg(F.max_by(F.struct("c", "lo", "hi"), "c")).first()[0]
        bucket = 1 if most is None or most["lo"] is None else max(1, -(-(most["hi"] - most["lo"] + 1) // -(-most["c"] // BUCKET_ROWS)))
    both = both.withColumn("_bucket", F.floor(F.col("_n") / F.lit(bucket)).cast("long") if bucket > 1 else F.col("_n")).drop("_n")
    here = Window.partitionBy(*by, "_bucket").orderBy(at, "_own", "_value").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_here", F.last("_value", ignorenulls=True).over(here)).where("_own = 1")
    # One row for each key and bucket that has right rows, or left rows to be served.
    ends = both.groupBy(*by, "_bucket").agg(F.max(F.when(F.col("_own") == 0, F.struct(at, "_value"))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.where("_bucket is not null").select(*by, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_end"))
    out = found.join(carried, [*by, "_bucket"], "left").withColumn("_value", F.coalesce("_here", F.col("_end._value")))
    return out.select(*(F.col("_left").getField(c).alias(c) for c in left.columns), *(F.col("_value").getField(v).alias(v) for v in values))
