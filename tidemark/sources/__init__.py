"""Readers and the market views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_bars(bars: DataFrame, path: str) -> None:
    """A bar store: Parquet partitioned by year, so that date filters prune files."""
    bars.selectExpr("*", "year(ts) AS year").write.mode("overwrite").partitionBy("year").parquet(path)


def read_bars(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Bars between two dates; the years outside are never read."""
    years = f"year BETWEEN {int(start[:4])} AND {int(end[:4])}"
    return spark.read.parquet(path).where(years).where(f"ts BETWEEN timestamp_ntz'{start}' AND timestamp_ntz'{end}'").drop("year")
