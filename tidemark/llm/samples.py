"""Bounded samples of labelled texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, column: str, fold: int, held: int, bound: int) -> DataFrame:
    """(text, n_chars, label) of about ``bound`` labelled rows a class outside the held-out fold, all if fewer.

    A row is held out if crc32(doc_id) mod ``fold`` is ``held``. Rows are taken
    by a hash of doc_id. Rows without doc_id or label are left out; of several
    labels of one doc_id the least counts.
    """
    slim = labels.select("doc_id", F.col(column).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    slim = slim.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != held)
    # Two counts reach the driver.
    sizes = {r["label"]: r["count"] for r in slim.groupBy("label").count().collect()}
    share = F.lit(1.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, bound / n))).otherwise(share)
    taken = slim.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.length("text").cast("long")
    # At most about 2 * bound rows of (doc_id, label), so broadcast: the texts stay where they are.
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), n_chars.alias("n_chars")).join(F.broadcast(taken), "doc_id").select("text", "n_chars", "label")
