"""The mean distance of each point to its nearest others.

All pairs are compared, block by block: a task takes two blocks of points, and
only each point's nearest few in the other block leave it. The work grows with
the square of the number of points, rows and memory don't.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

#: Points of a block.
BLOCK = 2000


def novelty(points: DataFrame, scales: dict[str, float], k: int) -> DataFrame:
    """(symbol, novelty): each point's mean distance to its k nearest others; coordinates' differences are multiplied by ``scales``.

    points: symbol and coordinates, one row for each symbol. One with a null coordinate is near to none and has a null novelty; a single point has no row.
    """
    points = stored(points.where("symbol is not null").select("symbol", *(F.col(c).cast("double").alias(c) for c in scales)), "points")
    n = points.count()
    blocks = math.ceil(n / BLOCK) if n > 1 else 0
    dealt = points.withColumn("_own", F.pmod(F.hash("symbol"), F.lit(max(blocks, 1))))
    each = F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1)))
    rows = dealt.select("*", F.col("_own").alias("_i"), each.alias("_j"), F.lit(True).alias("_asks")).unionByName(dealt.select("*", each.alias("_i"), F.col("_own").alias("_j"), F.lit(False).alias("_asks")))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows[rows["_asks"]]
        told = rows[~rows["_asks"]].dropna()
        b, names, found = told[list(scales)].to_numpy(), told["symbol"].to_numpy(), []
        for start in range(0, len(asks), 250):
            some = asks.iloc[start : start + 250]
            a, same = some[list(scales)].to_numpy(), some["symbol"].to_numpy()[:, None] == names[None, :]
            d = sum((s * (a[:, None, c] - b[None, :, c])) ** 2 for c, s in enumerate(scales.values()))
            d[same | np.isnan(d)] = np.inf
            d = np.pad(d, ((0, 0), (0, max(0, k - d.shape[1]))), constant_values=np.inf)
            found.extend(np.sqrt(np.partition(d, k - 1, axis=1)[:, :k]).tolist())
        return pd.DataFrame({"symbol": asks["symbol"].to_numpy(), "near": found})

    kind = dict(points.dtypes)["symbol"]
    near = rows.groupBy("_i", "_j").applyInPandas(one, f"symbol {kind}, near array<double>")
    all_near = near.groupBy("symbol").agg(F.flatten(F.collect_list("near")).alias("near"))
    finite = F.slice(F.sort_array(F.filter("near", lambda x: x < float("inf"))), 1, k)
    told = all_near.withColumn("near", finite).select("symbol", F.when(F.size("near") > 0, F.aggregate("near", F.lit(0.0), lambda s, x: s + x) / F.size("near")).alias("novelty"))
    return told if n > 1 else told.where("false")
