"""A stored table of bars: batches merged in, only the partitions that change rewritten.

The store is Parquet partitioned by year. Each row carries the number of the
batch that wrote it; of one symbol and time the row of the highest batch stays,
so that a batch can be replayed at any time: it changes nothing that it or a
later batch wrote, and a run that was cut short is mended by running it again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

KEYS = ["symbol", "ts"]
VALUES = ["open", "high", "low", "close", "volume"]


def _store(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _write(rows: DataFrame, path: str) -> None:
    spread = rows.repartitionByRange("year", "symbol", "ts").sortWithinPartitions("year", "symbol", "ts")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def upsert(spark: SparkSession, path: str, rows: DataFrame, batch: int, newest: str | None = None) -> list[int]:
    """Merge a batch of bars (KEYS and VALUES) into the store at path; gives the years that were rewritten.

    Of several rows of one symbol and time in the batch the one with the largest
    ``newest`` stays, and of equals the largest by its values. Rows without symbol
    or time are left out. A year is rewritten only if a row of it is new or
    different; the years' numbers are all that reaches the driver.
    """
    order = F.struct(*([newest] if newest else []), *VALUES)
    fresh = rows.where("symbol is not null and ts is not null").groupBy(*KEYS).agg(F.max_by(F.struct(*VALUES), order).alias("_v")).select(*KEYS, "_v.*", F.lit(batch).cast("long").alias("batch"), F.year("ts").alias("year"))
    held = _store(spark, path)
    if held is None:
        _write(fresh, path)
        return sorted(r["year"] for r in fresh.select("year").distinct().collect())
    fresh = stored(fresh, "batch")
    years = [r["year"] for r in fresh.select("year").distinct().collect()]
    # The years outside are never read.
    old = held.where(F.col("year").isin(years))
    before = old.select(*KEYS, *(F.col(c).alias(f"_{c}") for c in (*VALUES, "batch")))
    differs = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in VALUES))
    changes = fresh.join(before, KEYS, "left").where(F.col("_batch").isNull() | (F.col("_batch") <= batch) & differs)
    touched = sorted(r["year"] for r in changes.select("year").distinct().collect())
    if touched:
        # Of one key the highest batch wins, of equal batches the new row.
        sides = old.select(*fresh.columns).withColumn("_side", F.lit(0)).unionByName(fresh.withColumn("_side", F.lit(1))).where(F.col("year").isin(touched))
        merged = sides.groupBy(*KEYS).agg(F.max_by(F.struct(*fresh.columns[len(KEYS) :]), F.struct("batch", "_side")).alias("_v")).select(*KEYS, "_v.*")
        # Stored elsewhere first: a table can't be read while it is overwritten, and a lost executor mustn't lose old rows.
        _write(stored(merged, "merged"), path)
    return touched


def refresh(spark: SparkSession, path: str, source: DataFrame, batch: int, today: str, fresh_days: int = 1) -> list[int]:
    """Append what a source has after each symbol's last stored bar; symbols up to date within ``fresh_days`` are left alone.

    Symbols that the store doesn't know come whole. The store's last times are
    one row a symbol; nothing else of it is read before the merge.
    """
    held = _store(spark, path)
    rows = source.select(*KEYS, *VALUES)
    if held is not None:
        last = held.groupBy("symbol").agg(F.max("ts").alias("_last"))
        limit = F.date_sub(F.lit(today).cast("date"), fresh_days)
        rows = rows.join(last, "symbol", "left").where(F.col("_last").isNull() | (F.col("ts") > F.col("_last")) & (F.col("_last") < limit)).drop("_last")
    return upsert(spark, path, rows, batch)


def bars_between(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """The store's bars between two dates, the end's midnight included; the years outside are never read."""
    years = F.col("year").between(int(start[:4]), int(end[:4]))
    return spark.read.parquet(path).where(years & F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).select(*KEYS, *VALUES)
