"""Trigram distances of all names of one side to those of the other side with the same key.

Names are gathered in blocks; a row holds a block of each side and the distances
of its pairs, and only the last step has a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of a block on the left and on the right.
LEFT, RIGHT = 100, 400


def _trigrams(s: str | None) -> set[str]:
    return set() if s is None else {s[i : i + 3] for i in range(max(len(s) - 2, 1))}


def _distances(left: list[str | None], right: list[str | None]) -> np.ndarray:
    """1 - Jaccard similarity to six places, a row for each left name. A null name has no trigrams; two of them have a distance of NaN."""
    number: dict[str, int] = {}
    theirs = [[number.setdefault(g, len(number)) for g in _trigrams(s)] for s in right]
    held = np.zeros((len(number) + 1, len(right)), dtype=np.int32)
    for k, grams in enumerate(theirs):
        held[grams, k] = 1
    sizes, out = np.array([len(g) for g in theirs]), np.empty((len(left), len(right)))
    for k, s in enumerate(left):
        grams = _trigrams(s)
        both = held[[number[g] for g in grams if g in number]].sum(axis=0)
        with np.errstate(invalid="ignore"):
            out[k] = np.floor((1 - both / (len(grams) + sizes - both)) * 1e6 + 0.5) / 1e6
    return out


def _blocks(names: DataFrame, by: str, size: int, side: str) -> DataFrame:
    """(by, side): arrays of some ``size`` names of a key; a null name is a struct that holds null."""
    counts = names.groupBy("key").agg(F.ceil(F.count("*") / size).alias("_blocks"))
    dealt = names.join(F.broadcast(counts), "key").withColumn("_block", F.pmod(F.xxhash64(by), F.col("_blocks")))
    return dealt.groupBy("key", "_block").agg(F.collect_list(F.struct("name")).alias(side)).drop("_block")


def name_distances(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right, distance) of every pair of one key; both sides: id, name, key. Null keys match nothing."""
    pairs = _blocks(left.where("key is not null"), "id", LEFT, "l").join(_blocks(right.where("key is not null"), "id", RIGHT, "r"), "key").select("l", "r")
    # Short rows, much work: a number of tasks that isn't brought down to what their bytes ask for.
    pairs = pairs.repartition(4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("l"), F.xxhash64("r"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for l, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):  # noqa: E741
                l, r = ([x["name"] for x in side] for side in (l, r))  # noqa: E741
                d = pa.array(_distances(l, r).ravel())
                # One row a batch: its distances are many.
                yield pa.RecordBatch.from_arrays([pa.array([l], pa.list_(pa.string())), pa.array([r], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array([0, len(d)], pa.int32()), d)], ["l", "r", "d"])

    each = pairs.mapInArrow(told, "l array<string>, r array<string>, d array<double>").select("l", "r", F.posexplode("d").alias("k", "distance"))
    n = F.size("r")
    return each.select(F.get("l", F.floor(F.col("k") / n).cast("int")).alias("left"), F.get("r", F.col("k") % n).alias("right"), "distance")
