"""Structured Streaming twins of the batch bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.sources.shared import new_folder


def tumbling_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(symbol, start, open, high, low, close, n, value) of ticks (event_id, ts, event_type, value), batch or stream.

    Ticks later than ``late`` behind the newest are dropped by a stream's watermark.
    """
    order = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("symbol"))
    return bars.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n")).select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "n")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n, value) of each user's runs of events less than ``gap`` apart, batch or stream."""
    return ticks.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("value").alias("best")).select("user_id", F.col("session_window.start").alias("start"), "n", "best")


def run_to_end(spark: SparkSession, source: str, pattern: str, build) -> DataFrame:  # noqa: ANN001
    """All rows that a streaming aggregate over the Parquet files of a folder has when what is there is read.

    Every micro-batch rewrites the result table (complete mode), so a rerun of a batch changes nothing.
    """
    place = new_folder(spark, "stream")
    stream = spark.readStream.schema(spark.read.parquet(f"{source}/{pattern}").schema).option("pathGlobFilter", pattern).parquet(source)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    aggregated = build(stream)
    query = aggregated.writeStream.outputMode("complete").option("checkpointLocation", f"{place}/checkpoint").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{place}/table")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(aggregated.schema).parquet(f"{place}/table")


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_appended(spark: SparkSession, source: str, pattern: str, build, files: int | None = None, mode: str = "append") -> DataFrame:  # noqa: ANN001
    """All rows that a stream over the Parquet files of a folder appends until what is there is read.

    ``files`` bounds the files of a micro-batch. Each micro-batch has a folder of
    its own, which a rerun of that batch overwrites: no row is lost or doubled.
    In update mode rows come with their ``batch``, the later one the newer.
    """
    place = new_folder(spark, "stream")
    reader = spark.readStream.schema(spark.read.parquet(f"{source}/{pattern}").schema).option("pathGlobFilter", pattern)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    built = build(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        query = built.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(f"{place}/table/batch={k}")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.schema(StructType([*built.schema.fields, StructField("batch", IntegerType())])).option("basePath", f"{place}/table").parquet(f"{place}/table")
    return rows if mode == "update" else rows.drop("batch")
