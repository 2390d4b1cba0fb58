"""Queries over a stored table that batches are merged into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.composed import bars
from tidemark.plans.views import with_views
from tidemark.sources.shared import new_folder, stored
from tidemark.sources.store import bars_between, refresh, upsert


def _correction(rows: DataFrame) -> DataFrame:
    """What a second vendor says of a third of the symbols in three years: closes a tenth higher, volumes one more."""
    return rows.where("symbol % 3 = 0 and year(ts) between 1995 and 1997").withColumns({"close": F.col("close") * 1.1, "volume": F.col("volume") + 1})


def src_store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the store after three batches and a replay of the first: what there is, a correction, a correction of that."""
    path, rows = new_folder(spark, "store"), stored(bars(spark, sf_dir).drop("n"), "bars")
    corrected = _correction(rows)
    again = corrected.where("symbol % 2 = 0").withColumn("volume", -F.col("volume"))
    upsert(spark, path, rows, 1)
    upsert(spark, path, corrected, 2)
    upsert(spark, path, again.withColumn("seq", F.lit(2)).unionByName(corrected.where("symbol % 2 = 0").withColumn("seq", F.lit(1))), 3, "seq")
    upsert(spark, path, rows, 1)
    return bars_between(spark, path, "1994-06-01", "1997-06-30")


def src_store_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after an incremental append: even symbols stop in 1996, symbols that 5 divides are unknown, the others are up to date."""
    path, rows = new_folder(spark, "store"), stored(bars(spark, sf_dir).drop("n"), "bars")
    upsert(spark, path, rows.where("symbol % 5 <> 0 and (symbol % 2 = 1 and ts < timestamp_ntz'1998-06-01' or ts < timestamp_ntz'1996-01-01')"), 1)
    refresh(spark, path, rows.withColumn("volume", F.col("volume") + 0.5), 2, "1998-06-02", 31)
    return spark.read.parquet(path).groupBy("symbol", "year").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.max("batch").alias("batch"))


QUERIES = {f.__name__: f for f in (src_store_upsert, src_store_refresh)}
ORACLE = {
    "src_store_upsert": with_views("""SELECT symbol, ts, open, high, low, CASE WHEN symbol % 3 = 0 AND year(ts) BETWEEN 1995 AND 1997 THEN close * 1.1e0 ELSE close END AS close,
  CASE WHEN symbol % 6 = 0 AND year(ts) BETWEEN 1995 AND 1997 THEN -volume - 1 WHEN symbol % 3 = 0 AND year(ts) BETWEEN 1995 AND 1997 THEN volume + 1 ELSE volume END AS volume FROM bars WHERE ts BETWEEN TIMESTAMP '1994-06-01' AND TIMESTAMP '1997-06-30'""", "bars"),
    "src_store_refresh": with_views("""+ h AS (SELECT symbol, max(ts) AS last FROM bars WHERE symbol % 5 <> 0 AND (symbol % 2 = 1 AND ts < TIMESTAMP '1998-06-01' OR ts < TIMESTAMP '1996-01-01') GROUP BY symbol),
s AS (SELECT b.symbol, ts, volume, CASE WHEN last IS NULL OR ts > last THEN 2 ELSE 1 END AS batch FROM bars b LEFT JOIN h ON h.symbol = b.symbol WHERE last IS NULL OR ts <= last OR last < TIMESTAMP '1998-06-02' - INTERVAL 31 DAY)
SELECT symbol, year(ts) AS year, count(*) AS n, sum(CASE batch WHEN 2 THEN volume + 5e-1 ELSE volume END) AS volume, max(batch) AS batch FROM s GROUP BY symbol, year(ts)""", "bars"),
}
