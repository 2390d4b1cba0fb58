"""What several operators share: reading, shared storage, row numbers, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset,
    as in local tests, a temporary folder stands in.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def stored_at(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """As ``stored``, with the table's folder, for ``removed``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    return stored_at(df, name)[0]


def removed(spark: SparkSession, *folders: str) -> None:
    """Delete tables of ``stored_at``. Only once what was made of them is stored, so that no lost task needs them again."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def widened(df: DataFrame, more: str) -> StructType:
    """The schema of df with further columns, given as DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def number_rows(df: DataFrame, order: list[Column | str], name: str = "row_number") -> DataFrame:
    """Add a gapless global row number from 0 in the given order.

    Range-partitions and sorts the rows (pass slim rows, without texts), stores
    them with their place in the partition, and adds each partition's offset.
    Only one row per partition goes through one task. Equal order keys get an
    arbitrary but stored, hence stable, order: pass a full key where reruns must agree.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    placed = stored(
        df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_at", at).withColumns({"_part": F.shiftright("_at", 33), "_pos": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at"),
        "numbered",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition: its size is the number of partitions, whatever the data.
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_first") + F.col("_pos")).drop("_part", "_pos", "_first")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in undirected edges (src, dst); component is its least node.

    Alternating large-star and small-star rounds: every node points its larger,
    then its smaller neighbours at its least neighbour, until nothing changes.
    A node's neighbours never meet in one row: minima are aggregates, joined back.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(least(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = stored(small, "edges")
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as make it new to df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
