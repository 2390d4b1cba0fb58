"""Pareto fronts by distributed skylines.

A point dominates another if it is at least as good in every objective and
better in one; front 0 holds the points that none dominates, front k those that
only earlier fronts do. Each round takes the skyline of every partition, checks
these candidates against one another in pairs of bounded blocks, and peels the
front off. What fits one block is peeled to its end in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

BLOCK = 4096


def skyline(points: np.ndarray) -> np.ndarray:
    """Which distinct points no other one dominates; larger is better."""
    order = np.lexsort([*points.T, points.sum(axis=1)])[::-1]
    kept, left = np.zeros(len(points), bool), order
    while len(left):
        # Of the largest sum: none left dominates it.
        best = points[left[0]]
        kept[left[0]] = True
        left = left[(points[left] > best).any(axis=1)]
    # Rounded sums can tie: points that came too early go.
    at = np.flatnonzero(kept)
    return kept if not len(at) else _without(kept, at, dominated(points[at], points[at]))


def _without(kept: np.ndarray, at: np.ndarray, gone: np.ndarray) -> np.ndarray:
    kept[at[gone]] = False
    return kept


def dominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points some point of ``by`` dominates."""
    out = np.zeros(len(points), bool)
    for start in range(0, len(points), 256):
        some = points[start : start + 256, None, :]
        out[start : start + 256] = ((by >= some).all(axis=2) & (by > some).any(axis=2)).any(axis=1)
    return out


def pareto_fronts(points: DataFrame, objectives: list[str], block: int = BLOCK, most: int | None = None) -> DataFrame:
    """points with ``front``: 0 for those that none dominates, and so on; larger objectives are better.

    Equal points share a front. A null or NaN objective gives a null front, as do
    fronts from ``most`` on, if given. An empty table stays empty. A round costs
    one pass over the points left and, of c candidates, (c / block)^2 bounded
    pairs of blocks; there are as many rounds as fronts until one block holds the rest.
    """
    if "front" in {c.lower() for c in points.columns}:
        raise ValueError("points have a column front")
    spark, names = points.sparkSession, [f"_o{k}" for k in range(len(objectives))]
    schema = ", ".join(f"{n} double" for n in names)
    told = F.lit(True)
    for n in names:
        told = told & F.col(n).isNotNull() & ~F.isnan(n)
    left = stored(points.select(*(F.col(o).cast("double").alias(n) for o, n in zip(objectives, names, strict=True))).where(told).distinct(), "points")
    fronts: DataFrame = spark.createDataFrame([], f"{schema}, front int")

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(columns=names, dtype=float)
        for batch in batches:
            held = pd.concat([held, batch]) if len(held) else batch
            held = held[skyline(held.to_numpy(float))]
        yield held

    def check(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        return mine.loc[dominated(mine[names].to_numpy(float), theirs[names].to_numpy(float)), names]

    def peel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, front = pd.concat([pd.DataFrame(columns=names, dtype=float), *batches]), first
        while len(rest) and (most is None or front < most):
            top = skyline(rest.to_numpy(float))
            yield rest[top].assign(front=front)
            rest, front = rest[~top], front + 1

    first = 0
    while left.count() > block and (most is None or first < most):
        candidates = stored(left.mapInPandas(local, schema), "candidates")
        blocks = -(-candidates.count() // block)
        own = candidates.withColumn("_own", F.pmod(F.xxhash64(*names), F.lit(blocks)))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        mine, theirs = own.withColumn("_other", every), own.withColumnRenamed("_own", "_other").withColumn("_own", every)
        beaten = mine.groupBy("_own", "_other").cogroup(theirs.groupBy("_own", "_other")).applyInPandas(check, schema).distinct()
        front = stored(candidates.join(beaten, names, "left_anti").withColumn("front", F.lit(first)), "front")
        fronts, first = fronts.unionByName(front), first + 1
        left = stored(left.join(front, names, "left_anti"), "points")
    # At most one block of points, unless only the first fronts are asked for.
    if most is None or first < most:
        fronts = fronts.unionByName(left.coalesce(1).mapInPandas(peel, f"{schema}, front int"))
    fronts = stored(fronts, "fronts")
    return points.join(fronts, [F.col(o).cast("double") == fronts[n] for o, n in zip(objectives, names, strict=True)], "left").drop(*names)
